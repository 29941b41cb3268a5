"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of about the same number of distinct terms form a block. A block is a matrix of bits with a row for each bit of a signature and a column
for each document; a term that occurs often enough sets further bits, one set for each level of LEVELS. For a query the rows of its terms are
combined with AND, which overestimates what a document holds and how often, so that the sum of the terms' weights at those levels is an upper
bound of its score. The best bounds give seeds, whose exact scores give a floor for each query; every document whose bound reaches the floor
is scored exactly from its text.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, bit_set, may_hold, shipped

LEVELS = np.array([1, 2, 3] + [x << s for s in range(38) for x in (4, 6)], np.int64)  # term frequencies that set further bits
PROBES, BITS = 3, 10  # bits that an entry sets, and bits of a signature for each entry of the block's longest document
COLUMNS, CELLS = 4096, 1 << 25  # documents of a block, and bits of one
LOT_ROWS, LOT_ENTRIES = 8192, 1 << 21  # documents, and their distinct terms, from which a task makes blocks
SEEDS = 2  # times the wanted rows that are scored first
QUERIES, PAIRS = 512, 1 << 15  # queries of a block of queries, and (query, term) pairs
_APART = bytes([32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 65 <= b <= 90 else b for b in range(256)])


def terms(text: bytes) -> list[bytes]:
    """Runs of digits, ASCII letters in lower case, and bytes of other characters."""
    return text.translate(_APART).split()


def places(hashes: np.ndarray, level: np.ndarray | int, size: int) -> list[np.ndarray]:
    """The signature bits of terms at a level."""
    h = hashes + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((first + np.uint64(k) * step) % np.uint64(size)).astype(np.int64) for k in range(PROBES)]


class _Lot:
    """Documents of a task until they are cut into blocks."""

    def __init__(self):
        self.vocabulary = defaultdict(count().__next__)
        self.ids, self.rids, self.sizes, self.texts, self.terms, self.tfs = [], [], [], [], [], []
        self.entries = 0

    def add(self, doc_id, rid, text):
        words = terms(text)
        if not words:
            return
        found = Counter(words)
        self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int32, len(found)))
        self.tfs.append(np.fromiter(found.values(), np.int64, len(found)))
        self.ids.append(doc_id)
        self.rids.append(rid)
        self.sizes.append(len(words))
        self.texts.append(xxhash.xxh3_128_digest(text))
        self.entries += len(found)

    def full(self):
        return len(self.ids) >= LOT_ROWS or self.entries >= LOT_ENTRIES

    def reachable(self, k):
        """Documents without those of which k copies with smaller ids are here: these take the places before them in every list."""
        copies = defaultdict(list)
        for d, text in enumerate(self.texts):
            copies[text].append(d)
        best = lambda d: (self.ids[d] is None, self.ids[d] or 0)
        return [d for same in copies.values() for d in (same if len(same) <= k else sorted(same, key=best)[:k])]

    def batches(self, k):
        if not self.ids:
            return
        words = list(self.vocabulary)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        df = np.bincount(np.concatenate(self.terms), minlength=len(words))
        yield _record(kind=[1] * len(words), term=pa.array(words, pa.binary()), df=df)
        yield _record(kind=[2], df=[len(self.ids)], total=[sum(self.sizes)])
        levels = [np.searchsorted(LEVELS, tf, "right") for tf in self.tfs]
        entries = np.array([x.sum() for x in levels])
        left = sorted(self.reachable(k), key=lambda d: (-entries[d], d))
        while left:
            most = int(entries[left[0]])
            size = -(-max(BITS * most, 64) // 64) * 64
            n = next((j for j, d in enumerate(left) if j == COLUMNS or j and (j * size >= CELLS or 2 * entries[d] < most and most > 64)), len(left))
            block, left = left[:n], left[n:]
            cells = np.zeros((size, n), bool)
            for c, d in enumerate(block):
                deep = levels[d]
                at = np.repeat(np.arange(len(deep)), deep)
                level = np.arange(len(at)) - np.repeat(np.cumsum(deep) - deep, deep)
                for rows in places(hashes[self.terms[d]][at], level, size):
                    cells[rows, c] = True
            pick = lambda values: pa.array([[values[d] for d in block]], pa.list_(pa.int64()))  # noqa: E731, B023
            yield _record(kind=[0], doc_ids=pick(self.ids), rids=pick(self.rids), sizes=pick(self.sizes), size=[size], bits=pa.array([np.packbits(cells, axis=1).tobytes()], pa.binary()))


SCHEMA = "kind int, doc_ids array<long>, rids array<long>, sizes array<long>, size int, bits binary, term binary, df long, total long"
_KINDS = {"kind": pa.int32(), "doc_ids": pa.list_(pa.int64()), "rids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "size": pa.int32(), "bits": pa.binary(), "term": pa.binary(), "df": pa.int64(), "total": pa.int64()}


def _record(kind, **columns):
    return pa.record_batch([pa.array(kind, pa.int32()) if c == "kind" else pa.array(columns[c], t) if c in columns else pa.nulls(len(kind), t) for c, t in _KINDS.items()], names=list(_KINDS))


def index(docs: DataFrame, k: int) -> DataFrame:
    """Rows of three kinds from ``docs(doc_id, rid, text)``: 0, blocks of signatures; 1, (term, df) of a lot; 2, its documents and terms."""

    def run(batches):
        lot = _Lot()
        for b in batches:
            for s in range(0, len(b), 256):
                part = b.slice(s, 256)
                for doc_id, rid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), strict=True):
                    lot.add(doc_id, rid, text)
                    if lot.full():
                        yield from lot.batches(k)
                        lot = _Lot()
        yield from lot.batches(k)

    return docs.select("doc_id", "rid", "text").mapInArrow(run, SCHEMA)


def queries(items: DataFrame) -> DataFrame:
    """(iid, item_id, term, n) of ``items(item_id, text)``: each distinct row is a query; a query without a term has no rows."""

    def run(batches):
        for b in batches:
            for iid, item_id, text in zip(b.column(0).to_pylist(), b.column(1), as_bytes(b.column(2)), strict=True):
                found = Counter(terms(text))
                m = len(found)
                yield pa.record_batch([pa.array([iid] * m, pa.int64()), pa.array([item_id.as_py()] * m, item_id.type), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["iid", "item_id", "term", "n"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    return rows.select(F.xxhash64("item_id", "text").alias("iid"), "item_id", "text").mapInArrow(run, f"iid long, item_id {kind}, term binary, n long")


class Compiled:
    """A block of queries: terms with their weights, times their repeats in a query."""

    def __init__(self, pairs: list, docs: int, total: int):
        self.docs, self.total = docs, total
        self.iids = sorted({p.iid for p in pairs})
        at = {iid: k for k, iid in enumerate(self.iids)}
        words = sorted({bytes(p.term) for p in pairs})
        number = {w: k for k, w in enumerate(words)}
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        weight = {bytes(p.term): math.floor(1000 * math.log((2 * docs + 2) / (2 * p.df + 1))) for p in pairs}
        self.of = {iid: [] for iid in self.iids}
        for p in pairs:
            self.of[p.iid].append((bytes(p.term), p.n * weight[bytes(p.term)]))
        mine = sorted((number[bytes(p.term)], at[p.iid], p.n * weight[bytes(p.term)]) for p in pairs)
        self.term, self.query, self.weight = (np.array(x, np.int64) for x in zip(*mine, strict=True))
        self.starts = np.searchsorted(self.term, np.arange(len(words) + 1))
        self.floors = None

    def lengths(self, n):
        """The contract's m: 100 for a document of average length, from 75 up."""
        return 75 + (25 * n * self.docs) // self.total

    def exact(self, text: bytes, iids: list) -> list[int]:
        words = terms(text)
        tf, m = Counter(words), self.lengths(len(words))
        return [sum(w * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, w in self.of[iid] if t in tf) for iid in iids]

    def bounds(self, size: int, bits: bytes, sizes: np.ndarray) -> np.ndarray:
        """Upper bounds of scores, queries by documents of a block."""
        n = len(sizes)
        wide = (n + 7) // 8
        rows = np.frombuffer(bits, np.uint8).reshape(size, wide)
        m = self.lengths(sizes)
        most = np.minimum(np.append(LEVELS[1:], 1 << 40)[:, None] - 1, sizes[None, :])
        worth = np.concatenate([np.zeros((1, n), np.int64), (10**9 * most) // (1000 * most + 12 * m[None, :])])
        out = np.zeros(len(self.iids) * n)
        for s in range(0, len(self.hashes), 256):
            a, b, c = places(self.hashes[s : s + 256], 0, size)
            t, d = np.nonzero(np.unpackbits(rows[a] & rows[b] & rows[c], axis=1, count=n))
            level, open_ = np.ones(len(t), np.int64), np.arange(len(t))
            for deeper in range(1, len(LEVELS)):
                open_ = open_[sizes[d[open_]] >= LEVELS[deeper]]
                if not len(open_):
                    break
                col = d[open_]
                byte, bit = col >> 3, (7 - (col & 7)).astype(np.uint8)
                met = np.ones(len(open_), np.uint8)
                for spots in places(self.hashes[s : s + 256], deeper, size):
                    met &= rows[spots[t[open_]], byte] >> bit
                open_ = open_[met.astype(bool)]
                level[open_] += 1
            value, t = worth[level, d], t + s
            times = self.starts[t + 1] - self.starts[t]
            cuts = np.searchsorted(np.cumsum(times), np.arange(0, int(times.sum()) + 1, 1 << 21))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(t)), strict=True):
                if lo == hi:
                    continue
                many = times[lo:hi]
                pair = np.repeat(self.starts[t[lo:hi]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                hit = np.repeat(np.arange(lo, hi), many)
                out += np.bincount(self.query[pair] * n + d[hit], self.weight[pair] * value[hit], len(out))
        return out.reshape(len(self.iids), n)


def _bounded(blocks: DataFrame, model, k: int) -> DataFrame:
    """(iid, rid, bound) from the blocks: the k highest of a block for each query or, where floors are known, all that reach them."""

    def run(batches):
        compiled = model()
        for batch in batches:
            for row in batch.to_pylist():
                sizes, rids = np.array(row["sizes"], np.int64), np.array(row["rids"], np.int64)
                bound = compiled.bounds(row["size"], row["bits"], sizes)
                if compiled.floors is not None:
                    q, d = np.nonzero(bound >= compiled.floors[:, None])
                else:
                    d = np.argpartition(-bound, k - 1, axis=1)[:, :k] if bound.shape[1] > k else np.tile(np.arange(bound.shape[1]), (len(bound), 1))
                    q, d = np.repeat(np.arange(len(d)), d.shape[1]), d.ravel()
                    some = bound[q, d] > 0
                    q, d = q[some], d[some]
                yield pa.record_batch([pa.array(np.array(compiled.iids, np.int64)[q]), pa.array(rids[d]), pa.array(bound[q, d].astype(np.int64))], names=["iid", "rid", "bound"])

    return blocks.mapInArrow(run, "iid long, rid long, bound long")


def _scored(docs: DataFrame, chosen: DataFrame, model) -> DataFrame:
    """(iid, doc_id, score) of the pairs ``chosen(iid, rid)``; of the texts only those chosen, and a few others, are shuffled."""
    wanted = chosen.groupBy("rid").agg(F.collect_set("iid").alias("iids"))  # a block of queries bounds the set
    pages, bits = bit_set(wanted.select(F.col("rid").alias("key")), wanted.count())

    def run(batches):
        compiled = model()
        for b in batches:
            asked = b.column(2).to_pylist()
            scores = [compiled.exact(text, iids) for text, iids in zip(as_bytes(b.column(1)), asked, strict=True)]
            at = np.repeat(np.arange(len(b)), [len(x) for x in asked])
            yield pa.record_batch([pa.array([i for x in asked for i in x], pa.int64()), b.column(0).take(pa.array(at)), pa.array([s for x in scores for s in x], pa.int64())], names=["iid", "doc_id", "score"])

    texts = may_hold(docs, F.col("rid"), pages, bits).join(wanted, "rid").select("doc_id", "text", "iids")
    return texts.mapInArrow(run, "iid long, doc_id long, score long").where("score > 0")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring rows of ``docs(doc_id, text)`` for each distinct row of ``items(item_id, text)``.

    Scores above 0 only; equal scores in ascending order of doc_id, null last. Null or empty texts have no terms: such documents are in no list and such
    items have none. Repeated documents each take a place. Very long texts are read whole. Empty tables give an empty result; other columns are ignored.
    Queries go in blocks of at most about QUERIES queries and PAIRS terms, whose floors and weights are all that the driver holds.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ranked")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    made = scratch.save(index(docs, k), "index", ["kind"])
    blocks = made.where("kind = 0").select("sizes", "rids", "size", "bits")
    n, total = made.where("kind = 2").agg(F.sum("df"), F.sum("total")).first()
    asked = scratch.save(queries(items), "queries")
    df = made.where("kind = 1").groupBy("term").agg(F.sum("df").alias("df"))
    pairs = scratch.save(asked.join(df, "term"), "pairs")
    many, terms_ = pairs.agg(F.countDistinct("iid"), F.count("*")).first()
    lots = max(-(-many // QUERIES), -(-terms_ // PAIRS))
    found = scratch.save(spark.createDataFrame([], "iid long, doc_id long, score long, rank int"), "found")
    best = Window.partitionBy("iid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for lot in range(lots):
        mine = pairs.where(F.pmod("iid", F.lit(lots)) == lot).select("iid", "term", "n", "df").collect()
        if not mine:
            continue
        compiled = Compiled(mine, n, total)
        by_bound = Window.partitionBy("iid").orderBy(F.col("bound").desc(), "rid")
        seeds = _bounded(blocks, shipped(spark, compiled), SEEDS * k).withColumn("at", F.row_number().over(by_bound)).where(F.col("at") <= SEEDS * k)
        seeds = scratch.save(seeds.select("iid", "rid").distinct(), f"seeds{lot}")
        kth = _scored(docs, seeds, shipped(spark, compiled)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        floor = {r.iid: r.score for r in kth.select("iid", "score").collect()}
        compiled.floors = np.array([floor.get(iid, 1) for iid in compiled.iids], np.float64)
        model = shipped(spark, compiled)
        chosen = scratch.save(_bounded(blocks, model, k).select("iid", "rid").distinct(), f"chosen{lot}")
        rows = _scored(docs, chosen, model).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        rows.select("iid", "doc_id", "score", "rank").write.mode("append").parquet(f"{scratch.root}/found")
    found = spark.read.schema(found.schema).parquet(f"{scratch.root}/found")
    return found.join(asked.select("iid", "item_id").distinct(), "iid").select("item_id", "rank", "doc_id", "score")
