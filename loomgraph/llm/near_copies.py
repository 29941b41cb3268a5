"""Near copies by long SimHash fingerprints in several tries; exact similarity of word shingles decides.

Each word of a fingerprint has a trie of its own, whose traversal gives a spanning forest of the candidates within a small budget of differing bits; their
shingles are compared. What a group of candidates leaves apart is searched again, whole: a text stands there for the shingles by which it differs from most
texts of the group. Two near texts have few such differences or share many, so rare differences lead to the pairs, and their shingles are compared too.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, bit_set, connect, connected_components, in_set, may_hold, slices
from .simhash import FRONTIER, LEAF

WORDS, TRIES = 8, 4  # 64-bit words of a long fingerprint, and those that have a trie of their own
# Differing bits that a pair may have among the first bits of a trie: a budget that opens with the depth. A pair of similarity .8 differs in 15 % of
# its bits and keeps within it in one of four tries nearly always.
OPENING = ((4, 1), (10, 2), (64, 3))
SLACK = 0.08  # of similarity that the fingerprints of candidates may fall short by; their standard error at .8 is .035
FAR = 22  # bits of 64 that candidates may differ in; two texts of similarity .8 differ in ten, standard deviation three
CUT, CELL = 4, 1 << 19  # bits at which tries are cut into tasks at least; fingerprints of a cut node
ROWS, BYTES = 256, 1 << 20  # texts whose shingles a task holds at once
FEW = 8  # texts of a group up to which all its pairs of different labels are compared
EVEN = 1e-6  # by which sums of differences may seem larger than they are


def opened(level: int) -> int:
    return next(budget for depth, budget in OPENING if level <= depth)


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """Hashes of the word shingles of a text, repeats included; of all its words if they are fewer."""
    words = text.lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, 42)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    return [digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def long_fingerprint(hashes: list[int]) -> np.ndarray:
    """WORDS 64-bit SimHash words of shingle hashes, each from its own mixing of them."""
    ones = np.zeros(64 * WORDS, np.int64)
    odd = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for k in range(0, len(hashes), 255):  # sums of up to 255 bits fit a byte
        h = np.array(hashes[k : k + 255], np.uint64)[:, None] * odd
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def shape(hashes: list[int]) -> int:
    """64-bit hash of the set of shingles: texts of one shape have similarity 1."""
    return xxhash.xxh64_intdigest(np.unique(np.array(hashes, np.uint64)).tobytes())


def most_bits(similarity: float) -> int:
    """Differing bits of long fingerprints at a Jaccard similarity of shingles: the angle between two sets' indicator vectors."""
    return int(64 * WORDS * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def node_pairs(a: np.ndarray, b: np.ndarray | None, depth: int, deepest: int):
    """Ranges (al, ah, bl, bh) of node pairs of two sorted lists of words (``b`` None: of one with itself) within the opening budget.

    A pair comes out where it holds up to LEAF pairs of words, or at ``deepest`` bits.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    start = 0 if own or not depth else int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - depth)))
    stack = [(depth, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), start)))]
    while stack:
        level, al, ah, bl, bh, d = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(level, *(x[:half] for x in (al, ah, bl, bh, d))), (level, *(x[half:] for x in (al, ah, bl, bh, d)))]
            continue
        leaf = ((ah - al) * (bh - bl) <= LEAF) | (level >= deepest)
        if leaf.any():
            yield tuple(x[leaf] for x in (al, ah, bl, bh))
        if leaf.all():
            continue
        al, ah, bl, bh, d = (x[~leaf] for x in (al, ah, bl, bh, d))
        bit = np.uint64(1) << np.uint64(63 - level)
        am = np.clip(np.searchsorted(a, (a[al] & ~(bit | (bit - np.uint64(1)))) | bit), al, ah)
        bm = np.clip(np.searchsorted(b, (b[bl] & ~(bit | (bit - np.uint64(1)))) | bit), bl, bh)
        apart = al != bl if own else np.ones(len(al), bool)
        parts = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1), tuple(x[apart] for x in (am, ah, bl, bm, d + 1))]
        al, ah, bl, bh, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (d <= opened(level + 1)) & (ah > al) & (bh > bl)
        if keep.any():
            stack.append((level + 1, *(x[keep] for x in (al, ah, bl, bh, d))))


def forest(i: np.ndarray, j: np.ndarray, far: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of the pairs i-j those that connect what is not connected, nearest first; ``labels`` takes the smaller label of each two that meet."""
    taken = []
    while True:
        a, b = labels[i], labels[j]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return np.concatenate(taken) if taken else np.zeros(0, np.int64)
        both, pair = np.concatenate([a[open_], b[open_]]), np.concatenate([open_, open_])
        order = np.lexsort((pair, far[pair], both))
        pick = np.unique(pair[order[np.append(True, both[order][1:] != both[order][:-1])]])
        new = np.arange(labels.max() + 1)
        connect(new, labels[i[pick]], labels[j[pick]])
        labels[:] = new[labels]
        taken.append(pick)


def _compare(bits: np.ndarray, i: np.ndarray, j: np.ndarray, most: int, labels: np.ndarray):
    """Near pairs of rows i and j of ``bits`` whose labels differ; labels of what is found meet at once."""
    own = len(i) == len(j) and i[0] == j[0]
    out = []
    for p, row in enumerate(i):
        others = j[p + 1 :] if own else j
        others = others[labels[others] != labels[row]]
        if not len(others):
            continue
        far = np.bitwise_count(bits[others] ^ bits[row]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(far <= most)
        if len(near):
            _, first = np.unique(labels[others[near]], return_index=True)
            near = near[first]
            met = np.append(labels[others[near]], labels[row])
            labels[np.isin(labels, met)] = met.min()
            if (labels[i] == met.min()).all() and (own or (labels[j] == met.min()).all()):
                out.append((np.full(len(near), row), others[near], far[near]))
                break
        out.append((np.full(len(near), row), others[near], far[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def proposals(classes: DataFrame, n: int, most: int) -> DataFrame:
    """(a, b) of ``classes(shape, bits)``: a spanning forest of each task's pairs of shapes whose fingerprints differ in ``most`` bits or fewer."""
    depth, deepest = max(CUT, (n // CELL).bit_length()), max(n.bit_length(), CUT)
    masks = [sum(1 << x for x in bits) for k in range(min(opened(depth), depth) + 1) for bits in combinations(range(depth), k)]
    node = F.shiftrightunsigned(F.element_at("bits", F.col("trie") + 1), 64 - depth)
    dealt = classes.select("bits", "shape", F.explode(F.array(*map(F.lit, range(TRIES)))).alias("trie")).withColumn("node", node)
    dealt = dealt.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).withColumn("other", F.col("node").bitwiseXOR(F.col("mask")))
    dealt = dealt.select("trie", F.least("node", "other").alias("left"), F.greatest("node", "other").alias("right"), (F.col("node") > F.col("other")).alias("second"), "bits", "shape")

    def traverse(key, table):
        table = table.combine_chunks()
        bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        word = bits[:, key[0].as_py()]
        order = np.argsort(word, kind="stable")
        word, bits, name, second = word[order], bits[order], table.column("shape").to_numpy()[order], table.column("second").to_numpy(zero_copy_only=False)[order]
        labels = np.unique(name, return_inverse=True)[1]
        own = key[1].as_py() == key[2].as_py()
        a = np.arange(len(word)) if own else np.flatnonzero(~second)
        b = a if own else np.flatnonzero(second)
        kept = (np.zeros(0, np.int64),) * 3
        for al, ah, bl, bh in node_pairs(word[a], None if own else word[b], depth, deepest):
            na, nb = ah - al, bh - bl
            big = na * nb > LEAF
            found = [_compare(bits, a[al[k] : ah[k]], b[bl[k] : bh[k]], most, labels) for k in np.flatnonzero(big)]
            la, lb, wb, count = al[~big], bl[~big], nb[~big], (na * nb)[~big]
            pair = np.repeat(np.arange(len(la)), count)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            i, j = a[la[pair] + k // wb[pair]], b[lb[pair] + k % wb[pair]]
            near = (labels[i] != labels[j]) & (np.bitwise_count(word[i] ^ word[j]) <= FAR)
            i, j = i[near], j[near]
            far = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            close = far <= most
            i, j, far = i[close], j[close], far[close]
            pick = forest(i, j, far, labels)
            found.append((i[pick], j[pick], far[pick]))
            kept = tuple(np.concatenate(x) for x in zip(kept, *found, strict=True))
        return pa.table({"a": name[kept[0]], "b": name[kept[1]]})

    return dealt.groupBy("trie", "left", "right").applyInArrow(traverse, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(shape, shingles) of the classes, each from one of its texts."""

    def run(batches):
        for b in slices(batches, 1, ROWS, BYTES):
            sets = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)).view(np.int64) for t in as_bytes(b.column(1))]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["shape", "shingles"])

    pages, bits = bit_set(classes.select(F.col("rid").alias("key")), classes.count())
    texts = may_hold(docs.select("rid", "text"), F.col("rid"), pages, bits).join(classes.select("rid", "shape"), "rid").dropDuplicates(["rid"])
    return texts.select("shape", "text").mapInArrow(run, "shape long, shingles array<long>")


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingles have the similarity."""
    left, right = (sets.select(F.col("shape").alias(x), F.col("shingles").alias(f"{x}s")) for x in "ab")
    both = F.size(F.array_intersect("as", "bs"))
    return pairs.join(left, "a").join(right, "b").where(both >= F.lit(similarity) * (F.size("as") + F.size("bs") - both)).select("a", "b")


def _labelled(rows: DataFrame, roots: DataFrame | None, name: str) -> DataFrame:
    """``rows(shape)`` with the component of its shape as ``name``, itself where it has no other."""
    if roots is None:
        return rows.withColumn(name, F.col("shape"))
    return rows.join(roots.select(F.col("node").alias("shape"), F.col("component").alias("_root")), "shape", "left").withColumn(name, F.coalesce("_root", "shape")).drop("_root")


def differences(members: DataFrame, similarity: float) -> DataFrame:
    """(g, shape, diff, over, inner, center, other) of ``members(g, n, shape, shingles)``.

    ``diff`` has the shingles by which a text differs from those that more than half of the n texts of its group have. x and y have the similarity if
    and only if they share (over(x) + over(y)) / 2 of their differences. The text of smallest ``over`` is the center; ``inner`` texts are near to it whatever they
    share, and two that need not share any are both inner. ``other`` is the smallest ``over`` among the texts that a text is compared with.
    """
    shingles = members.select("g", "n", F.explode("shingles").alias("shingle")).groupBy("g", "shingle").agg(F.count("*").alias("df"), F.first("n").alias("n"))
    common = shingles.where("2 * df > n").groupBy("g").agg(F.collect_list("shingle").alias("common"))
    both = members.join(common, "g", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
    apart = F.concat(F.array_except("shingles", "common"), F.array_except("common", "shingles"))
    over = F.size("diff") - F.lit((1 - similarity) / (1 + similarity)) * F.size("shingles")
    rows = both.withColumn("diff", apart).select("g", "shape", "diff", over.alias("over"))
    center = rows.groupBy("g").agg(F.min(F.struct("over", "shape")).alias("x")).select("g", F.col("x.over").alias("least"), F.col("x.shape").alias("center"))
    inner = F.col("over") + F.col("least") <= EVEN
    outer = rows.join(center, "g").where(~inner).groupBy("g").agg(F.min("over").alias("outer"))
    return rows.join(center.join(outer, "g", "left"), "g").withColumn("inner", inner).withColumn("other", F.when(inner, F.col("outer")).otherwise(F.col("least"))).drop("least", "outer")


def sharing(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``differences`` with ``label``: those of different labels, one of them not inner, that share enough differences.

    Differences that occur under one label are shared by no such pair. Of the others, rare ones first, a pair's first shared one leaves as many as the two must share;
    pairs that meet there have all of theirs counted where they meet, so that only near ones come out.
    """
    rows = rows.where("other is not null")
    each = rows.select("g", "shape", "label", F.explode("diff").alias("token"))
    shared = each.groupBy("g", "token").agg(F.count("*").alias("df"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("g", "token", "df")
    listed = each.join(shared, ["g", "token"]).groupBy("g", "shape").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    placed = rows.drop("diff").join(listed, ["g", "shape"]).select("*", F.posexplode("shared").alias("place", "x")).withColumn("left", F.size("shared") - F.col("place"))
    least = lambda x, y: F.ceil((x + y) / 2 - F.lit(EVEN))
    placed = placed.where(F.col("left") >= least(F.col("over"), F.col("other"))).select("g", F.col("x.token").alias("token"), "shape", "label", "over", "inner", "left", F.col("shared.token").alias("all"))
    x, y = (placed.select("g", "token", *[F.col(c).alias(f"{c}_{k}") for c in ("shape", "label", "over", "inner", "left", "all")]) for k in "xy")
    once = F.col("inner_y") | (F.col("shape_x") < F.col("shape_y"))
    most = F.when(least(F.col("over_x"), F.col("over_y")) <= F.least("left_x", "left_y"), F.size(F.array_intersect("all_x", "all_y")))
    enough = least(F.col("over_x"), F.col("over_y")) <= most
    met = x.where("not inner_x").join(y, ["g", "token"]).where((F.col("label_x") != F.col("label_y")) & once & enough)
    return met.select(F.least("shape_x", "shape_y").alias("a"), F.greatest("shape_x", "shape_y").alias("b")).distinct()


def _with_groups(docs: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(rid, doc_id, label) of ``docs(rid, doc_id, text)``: texts of a label are connected by pairs of ``similarity`` or more."""
    most = most_bits(similarity - SLACK)

    def run(batches):
        for b in slices(batches, 2, ROWS, BYTES):
            hashes = [shingle_hashes(t, shingle) for t in as_bytes(b.column(2))]
            bits = [long_fingerprint(h).view(np.int64) for h in hashes]
            ends = pa.array(np.arange(0, WORDS * len(bits) + 1, WORDS, dtype=np.int32))
            shapes = np.array([shape(h) for h in hashes], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(shapes), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))], names=["rid", "doc_id", "shape", "bits"])

    marks = scratch.save(docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, shape long, bits array<long>"), "marks")
    classes = scratch.save(marks.groupBy("shape").agg(F.min(F.struct("rid", "bits")).alias("x")).select("shape", "x.*"), "classes")
    pairs = scratch.save(proposals(classes, classes.count(), most), "proposed").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = pairs.select(F.explode(F.array("a", "b")).alias("shape")).distinct()
    sets = scratch.save(_sets(docs, classes.join(near, "shape"), shingle), "sets")
    edges, roots, k = None, None, 0

    def compare(pairs: DataFrame) -> None:
        nonlocal edges, roots, k
        true = scratch.save(_near(pairs, sets, similarity), f"true{k}")
        if not true.isEmpty():
            edges = true if edges is None else edges.unionByName(true)
            roots = connected_components(edges, scratch, f"cc{k}")
        k += 1

    compare(pairs)
    members = _labelled(_labelled(sets, connected_components(pairs, scratch, "candidates"), "g"), roots, "label")
    apart = members.groupBy("g").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("n > 2 and x <> y").select("g", "n")
    members = scratch.save(members.join(apart, "g"), "apart")
    x, y = (members.where(F.col("n") <= FEW).select("g", F.col("shape").alias(a), F.col("label").alias(f"{a}_label")) for a in "ab")
    rows = scratch.save(differences(members.where(F.col("n") > FEW), similarity), "differences")
    inner = rows.where("inner and shape <> center").select(F.least("shape", "center").alias("a"), F.greatest("shape", "center").alias("b"))
    compare(x.join(y, "g").where("a < b and a_label <> b_label").select("a", "b").unionByName(inner))
    compare(scratch.save(sharing(_labelled(rows, roots, "label")), "sharing"))
    if roots is None:
        return marks.select("rid", "doc_id", F.col("shape").alias("label"))
    return marks.join(roots, marks.shape == roots.node, "left").select("rid", "doc_id", F.coalesce("component", "shape").alias("label"))


def _rows(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.xxhash64(doc_id, text).alias("rid"), doc_id.alias("doc_id"), text.alias("text"))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): documents connected by pairs whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Candidates come from the tries and may miss a pair; none below the similarity is taken. Null and blank texts are one group. The component is the
    smallest doc_id of its rows, null if none has one. Repeated rows come back as often as they came in. Very long texts are read whole. An empty table
    gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = scratch.save(_with_groups(_rows(docs), shingle, similarity, scratch), "labels")
    return rows.join(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of ``similar_groups``: the one of smallest doc_id, null last, and of several texts under that id any one.

    Of rows that repeat it in id and text one stays. Rows that go are few or many, but only those and a few others are shuffled with their texts. Null and
    blank texts are one group; an empty table gives an empty result; all columns stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = scratch.save(_with_groups(_rows(docs), shingle, similarity, scratch), "labels")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "rid")).alias("x")).select("label", F.col("x.rid").alias("first"))
    marked = rows.join(first, "label").groupBy("rid").agg(F.max((F.col("rid") == F.col("first")).cast("int")).alias("stays"), F.count("*").alias("n"))
    touched = scratch.save(marked.where("stays = 0 or n > 1"), "touched")
    pages, bits = bit_set(touched.select(F.col("rid").alias("key")), touched.count())
    told = in_set(docs.withColumn("_near_rid", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))), F.col("_near_rid"), pages, bits, "_near_touched")
    some = told.where("_near_touched").join(touched.where("stays = 0").select(F.col("rid").alias("_near_rid")), "_near_rid", "left_anti").dropDuplicates(["_near_rid"])
    return told.where("not _near_touched").unionByName(some.select(*told.columns)).drop("_near_rid", "_near_touched")
