"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are made in Arrow batches; equal ones are one trie leaf. The trie is cut below its first bits: two cut
nodes whose prefixes differ in no more bits than the budget form a task, which traverses node pairs of the two
subtries together, adds up differing bits, and prunes a pair as soon as the budget is exceeded. A task returns a
spanning forest of the links it found, never the pairs themselves.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, connect, connected_components

LEAF = 32  # pairs below which two trie nodes are compared outright
FRONTIER = 1 << 18  # node pairs traversed at once


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; zero without a word."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of whole texts; null and blank texts have fingerprint zero. Other columns are not read."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def near_pairs(a: np.ndarray, b: np.ndarray | None, depth: int, budget: int):
    """Index pairs of sorted distinct fingerprints within ``budget`` bits, in chunks.

    ``b`` None joins ``a`` with itself. All of ``a`` share their first ``depth`` bits, and so do all of ``b``.
    """
    if not len(a) or b is not None and not len(b):
        return
    own = b is None
    b = a if own else b
    start = 0 if own or not depth else int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - depth)))
    stack = [(depth, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), start)))]
    while stack:
        level, al, ah, bl, bh, d = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(level, *(x[:half] for x in (al, ah, bl, bh, d))), (level, *(x[half:] for x in (al, ah, bl, bh, d)))]
            continue
        na, nb = ah - al, bh - bl
        leaf = (na * nb <= LEAF) if level < 64 else np.ones(len(al), bool)
        if leaf.any():
            la, lb, wa, wb = al[leaf], bl[leaf], na[leaf], nb[leaf]
            count = wa * wb
            pair = np.repeat(np.arange(len(la)), count)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            i, j = la[pair] + k // wb[pair], lb[pair] + k % wb[pair]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if own:
                near &= i < j
            yield i[near], j[near]
        if leaf.all():
            continue
        al, ah, bl, bh, d = (x[~leaf] for x in (al, ah, bl, bh, d))
        bit = np.uint64(1) << np.uint64(63 - level)
        am = np.clip(np.searchsorted(a, (a[al] & ~(bit | (bit - np.uint64(1)))) | bit), al, ah)
        bm = np.clip(np.searchsorted(b, (b[bl] & ~(bit | (bit - np.uint64(1)))) | bit), bl, bh)
        apart = np.ones(len(al), bool) if not own else al != bl
        parts = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1), tuple(x[apart] for x in (am, ah, bl, bm, d + 1))]
        al, ah, bl, bh, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (d <= budget) & (ah > al) & (bh > bl)
        if keep.any():
            stack.append((level + 1, *(x[keep] for x in (al, ah, bl, bh, d))))


def trie_links(classes: DataFrame, n: int, budget: int = 3, node_rows: int = 1 << 19) -> DataFrame:
    """Spanning links (a, b) between the ``rep`` ids of ``classes(fp, rep)``, whose fingerprints are distinct.

    The trie is cut at five bits (26 copies of a fingerprint for a budget of 3) up to 32 ``node_rows`` fingerprints; beyond that the cut goes deeper
    by one bit for each doubling, so that a node holds about ``node_rows``, and copies grow as the cube of the depth (176 at 10 bits, 10**9 fingerprints).
    """
    depth = max(5, min(24, (max(n, 1) // node_rows).bit_length()))
    masks = [sum(1 << x for x in bits) for k in range(min(budget, depth) + 1) for bits in combinations(range(depth), k)]
    node = F.shiftrightunsigned("fp", 64 - depth)
    dealt = (
        classes.where("rep is not null")
        .select("fp", "rep", node.alias("node"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
        .withColumn("other", F.col("node").bitwiseXOR(F.col("mask")))
        .select("fp", "rep", F.least("node", "other").alias("left"), F.greatest("node", "other").alias("right"), (F.col("node") > F.col("other")).alias("second"))
    )

    def traverse(key, table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        rep, second = table.column("rep").to_numpy(), table.column("second").to_numpy(zero_copy_only=False)
        order = np.argsort(fp, kind="stable")
        fp, rep, second = fp[order], rep[order], second[order]
        own = key[0].as_py() == key[1].as_py()
        a = np.arange(len(fp)) if own else np.flatnonzero(~second)
        b = np.flatnonzero(second)
        labels = np.arange(len(fp))
        for i, j in near_pairs(fp[a], None if own else fp[b], depth, budget):
            connect(labels, a[i], a[j] if own else b[j])
        moved = np.flatnonzero(labels != np.arange(len(fp)))
        return pa.table({"a": rep[moved], "b": rep[labels[moved]]})

    return dealt.groupBy("left", "right").applyInArrow(traverse, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked at ``budget`` or fewer differing bits.

    Null or blank text: fingerprint zero, linked like any other. Repeated rows come back as often as they came in. A row
    with null doc_id keeps its fingerprint and gets the component of that fingerprint (null if no other row has an id
    there). Very long texts are read whole. An empty table gives an empty result; columns besides doc_id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marks = scratch.save(fingerprints(docs, shingle), "fingerprints")
    classes = scratch.save(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = scratch.save(trie_links(classes, classes.count(), budget), "links")
    roots = connected_components(links, scratch)
    named = classes.join(roots, classes.rep == roots.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marks.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
