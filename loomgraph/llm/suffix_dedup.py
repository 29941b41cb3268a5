"""Removal of repeated passages with a logarithmic family of sparse suffix arrays.

A suffix enters the index where it starts with the smallest 64-byte fingerprint of some 200-byte window. The choice
depends on the window's bytes alone, so two equal windows enter with equal suffixes, and each window belongs to exactly one
entry: an entry covers the run of consecutive windows which chose it. Batches become sorted arrays of entries (first bytes,
fingerprint, place); a batch is merge-scanned against every level of the family for long matches, and levels of equal rank
merge into the next rank, which later batches scan. The arrays that are left at the end hold every run that matched, with its
places counted: runs of equal bytes repeat as a whole; the bytes of the others are brought together by key and their
windows compared one by one through two independent 64-bit fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, text_buffers

ANCHOR = 64  # bytes fingerprinted at an entry
PIECE = 1 << 20  # bytes handled at once; longer texts are cut into pieces that overlap by a window less one byte
BUCKET = 4096  # runs of bytes compared in one task, on average
_PLACE = np.uint64(PIECE - 1)


class _Rolling:
    """Fingerprints of any substring of a piece by prefix sums modulo 2**64."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.table = r.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(r.integers(1 << 40, 1 << 62)) * 8 + 5
        self.power, self.inverse = self._powers(base), self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(PIECE + 1, base % (1 << 64), np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.inverse[start])

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        n = len(sums) - k
        return _mixed((sums[k:] - sums[:n]) * self.inverse[:n])


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_ROLL: dict[int, _Rolling] = {}


def _roll(seed: int) -> _Rolling:
    if seed not in _ROLL:
        _ROLL[seed] = _Rolling(seed)
    return _ROLL[seed]


def _pieces(offsets: np.ndarray, window: int):
    """(first byte, last byte, rows, their first bytes, their last bytes, bytes of the first row that lie before)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        s, e = int(offsets[i]), int(offsets[i + 1])
        if e - s > PIECE:
            for p in range(s, e - window + 1, PIECE - window + 1):
                q = min(p + PIECE, e)
                yield p, q, np.array([i]), np.array([p]), np.array([q]), p - s
            i += 1
            continue
        j = max(int(np.searchsorted(offsets, s + PIECE, "right")) - 1, i + 1)
        yield s, int(offsets[j]), np.arange(i, j), offsets[i:j], offsets[i + 1 : j + 1], 0
        i = j


def piece_entries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int):
    """(first eight bytes, key, run fingerprint, first window, windows) of the entries of texts that lie side by side in ``data``."""
    n = len(data) - window + 1
    if n <= 0:
        return None
    first, second = _roll(1), _roll(2)
    sums = first.sums(data)
    gram = first.grams(sums, ANCHOR)
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width, done = window - ANCHOR + 1, 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if width > done:
        least = np.minimum(least[: done - width], least[width - done :])
    place = (least[:n] & _PLACE).astype(np.int64)
    valid = np.repeat(ends, ends - starts)[:n] - np.arange(n) >= window
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    s = np.flatnonzero(fresh)
    if not len(s):
        return None
    count = np.add.reduceat(valid.astype(np.int64), s)
    more = second.sums(data)
    at = place[s]
    head = np.zeros(len(s), np.uint64)
    for k in range(8):
        head = head << np.uint64(8) | data[at + k]
    return head ^ np.uint64(1 << 63), gram[at], second.of(more, s, s + count + window - 1), s, count  # signed, heads order like bytes


def entries(docs: DataFrame, window: int, batches: int) -> DataFrame:
    """(head, key, run, rid, start, windows, batch) of ``docs(rid, text)``."""

    def run(parts):
        for b in parts:
            data, offsets = text_buffers(b.column(1))
            rid = b.column(0).to_numpy()
            for p, q, rows, starts, ends, before in _pieces(offsets, window):
                if (found := piece_entries(data[p:q], starts - p, ends - p, window)) is None:
                    continue
                head, key, whole, s, count = found
                at = np.searchsorted(starts - p, s, "right") - 1
                own = rid[rows[at]]
                yield pa.record_batch(
                    [pa.array(head.view(np.int64)), pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(own), pa.array(s - (starts - p)[at] + before), pa.array(count.astype(np.int32)), pa.array((own % batches).astype(np.int32))],
                    names=["head", "key", "run", "rid", "start", "windows", "batch"],
                )

    return docs.select("rid", "text").mapInArrow(run, "head long, key long, run long, rid long, start long, windows int, batch int")


class SuffixIndexFamily:
    """Levels of suffix arrays: the suffixes of all batches so far, in order of their first bytes and the fingerprint of their first 64.

    Suffixes that agree for the whole run of windows they stand for are one row: (head, key, run), how many there are, and the first place.
    ``add`` takes a batch, scans it against itself and every level for keys that match, and keeps the family logarithmic: two levels of one
    rank merge into one of the next, so at most one level of a rank is left.
    """

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.hits, self.made, self.scans = scratch, {}, [], 0, []

    def _save(self, rows: DataFrame, n: Column, one: Column) -> tuple[str, DataFrame]:
        self.made += 1
        array = rows.groupBy("head", "key", "run").agg(F.sum(n).alias("n"), F.min(one).alias("one"))
        return f"level{self.made}", self.scratch.save(array.sortWithinPartitions("head", "key"), f"level{self.made}")

    def _merged(self, rows: DataFrame) -> tuple[str, DataFrame]:
        return self._save(rows, F.col("n"), F.col("one"))

    def add(self, batch: DataFrame) -> DataFrame:
        """The (head, key) of suffixes in ``batch(head, key, run, rid, start, windows)`` that match another one for 64 bytes or more."""
        name, array = self._save(batch, F.lit(1).cast("long"), F.struct("rid", "start", "windows"))
        found = array.groupBy("head", "key").agg(F.sum("n").alias("n")).where("n > 1").select("head", "key")
        self.scans.append(sorted(self.levels))
        for _, level in self.levels.values():
            found = found.unionByName(array.select("head", "key").join(level.select("head", "key"), ["head", "key"], "left_semi"))
        self.hits.append(self.scratch.save(found.distinct(), f"hits{self.made}"))
        rank = 0
        while rank in self.levels:
            other, level = self.levels.pop(rank)
            merged = self._merged(array.unionByName(level))
            self.scratch.drop(other)
            self.scratch.drop(name)
            (name, array), rank = merged, rank + 1
        self.levels[rank] = (name, array)
        return self.hits[-1]

    def matches(self) -> DataFrame:
        """(head, key, run, n, one) of all suffixes whose key matched in some scan, out of the levels that are left."""
        hits, rows = self.hits[0], None
        for more in self.hits[1:]:
            hits = hits.unionByName(more)
        hits = hits.distinct()
        for _, level in self.levels.values():
            own = level.join(hits, ["head", "key"], "left_semi")
            rows = own if rows is None else rows.unionByName(own)
        return rows.groupBy("head", "key", "run").agg(F.sum("n").alias("n"), F.min("one").alias("one")) if len(self.levels) > 1 else rows


def batches_for(rows: int) -> int:
    """Batches that an input is indexed in: two, and one more for each doubling beyond 65,536 rows."""
    return 2 + (rows >> 16).bit_length()


def _packed(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, size, packed): texts compressed one by one, as they are to be dealt out twice."""

    def run(parts):
        codec = pa.Codec("zstd")
        for b in parts:
            texts = as_bytes(b.column(2))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int32()), pa.array([codec.compress(t, asbytes=True) if t else b"" for t in texts], pa.binary())], names=["rid", "doc_id", "size", "packed"])

    return docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "rid long, doc_id long, size int, packed binary")


def _unpacked(sizes: pa.Array, packed: pa.Array):
    codec = pa.Codec("zstd")
    for n, z in zip(sizes.to_pylist(), packed.to_pylist(), strict=True):
        yield codec.decompress(z, n, asbytes=True) if n else b""


def _snippets(packed: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(bucket, rid, start, alone, bytes) for every run in ``runs(rid, runs[])``."""

    def run(parts):
        for b in parts:
            out = [], [], [], [], []
            for rid, text, spans in zip(b.column(0).to_pylist(), _unpacked(b.column(1), b.column(2)), b.column(3).to_pylist(), strict=True):
                for x in spans:
                    for k, v in zip(out, (x["bucket"], rid, x["start"], x["alone"], text[x["start"] : x["start"] + x["windows"] + window - 1]), strict=True):
                        k.append(v)
            yield pa.record_batch([pa.array(k, t) for k, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "rid", "start", "alone", "bytes"])

    joined = packed.join(runs.hint("shuffle_hash"), "rid").select("rid", "size", "packed", "runs")
    return joined.mapInArrow(run, "bucket long, rid long, start long, alone boolean, bytes binary")


def _snippet_windows(data: np.ndarray, offsets: np.ndarray, window: int):
    """(snippet, first byte in it, two fingerprints) of the windows of snippets."""
    one, two, i, out = _roll(1), _roll(2), 0, []
    while i < len(offsets) - 1:
        j = max(int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1, i + 1)
        part, ends = data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        sizes = np.diff(offsets[i : j + 1])
        owner, place = np.repeat(np.arange(i, j), sizes), np.arange(len(part))
        fits = np.flatnonzero(np.repeat(ends, sizes) - place >= window)
        w1, w2 = one.grams(one.sums(part), window), two.grams(two.sums(part), window)
        out.append((owner[fits], fits - (offsets[owner[fits]] - offsets[i]), w1[fits], w2[fits]))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else None


def _repeated_in_bucket(window: int):
    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rid, start, alone = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "start", "alone"))
        snippet, at, w1, w2 = _snippet_windows(*text_buffers(table.column("bytes")), window)
        order = np.lexsort((w2, w1))
        same = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        k = np.flatnonzero(twice & alone[snippet])
        fresh = np.ones(len(k), bool)
        fresh[1:] = (snippet[k][1:] != snippet[k][:-1]) | (at[k][1:] != at[k][:-1] + 1)
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(k)))
        return pa.table({"rid": rid[snippet[k[first]]], "start": start[snippet[k[first]]] + at[k[first]], "size": pa.array(count + window - 1, pa.int64())})

    return find


def _windows(snippets: DataFrame, window: int) -> DataFrame:
    """(w1, w2, rid, start, alone) for every window of snippets, a row each."""

    def run(parts):
        for b in parts:
            if (found := _snippet_windows(*text_buffers(b.column(4)), window)) is None:
                continue
            snippet, at, w1, w2 = found
            rid, start, alone = (b.column(k).to_numpy(zero_copy_only=False)[snippet] for k in (1, 2, 3))
            yield pa.record_batch([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(rid), pa.array(start + at), pa.array(alone)], names=["w1", "w2", "rid", "start", "alone"])

    return snippets.mapInArrow(run, "w1 long, w2 long, rid long, start long, alone boolean")


def remove_repeats(docs: DataFrame, window: int = 200, batches: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``, the bytes that remain.

    Every byte covered by a ``window``-byte string that also starts elsewhere is removed, in all its places; strings are
    judged on the input. Null text is empty: no bytes, the hash of nothing. Texts shorter than the window keep all. A
    repeated row is another place, so both rows lose what they share. Very long texts are read whole. An empty table gives an
    empty result; other columns are ignored. ``batches`` (by default more for more rows) does not change results.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    batches = batches or batches_for(docs.count())
    runs = scratch.save(entries(docs, window, batches), "entries", ["batch"])
    family = SuffixIndexFamily(scratch)
    for k in range(batches):
        family.add(runs.where(F.col("batch") == k).drop("batch"))
    classes = scratch.save(family.matches(), "classes")
    for name, _ in family.levels.values():
        scratch.drop(name)
    spans = runs.join(classes.where("n > 1").select("head", "key", "run"), ["head", "key", "run"], "left_semi").select("rid", "start", (F.col("windows") + (window - 1)).cast("long").alias("size"))
    spans = scratch.save(spans, "spans")
    scratch.drop("entries")
    # Entries of one key but different bytes: their bytes meet in buckets. A key with more of them than a bucket should hold
    # has its windows dealt out one by one instead.
    kinds = scratch.save(classes.groupBy("head", "key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    buckets = int((kinds.agg(F.sum("kinds")).first()[0] or 0) // BUCKET) + 1
    bucket = F.when(F.col("kinds") > 4 * BUCKET, F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).cast("long").alias("bucket")
    mixed = classes.join(kinds, ["head", "key"]).select("one.*", (F.col("n") == 1).alias("alone"), bucket)
    mixed = mixed.groupBy("rid").agg(F.collect_list(F.struct("start", "windows", "alone", "bucket")).alias("runs"))
    packed = _packed(docs)
    snippets = scratch.save(_snippets(packed, mixed, window), "snippets")
    spans = spans.unionByName(snippets.where("bucket >= 0").groupBy("bucket").applyInArrow(_repeated_in_bucket(window), "rid long, start long, size long"))
    windows = _windows(snippets.where("bucket = -1"), window)
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    spans = spans.unionByName(windows.where("alone").join(twice, ["w1", "w2"], "left_semi").select("rid", "start", F.lit(window).cast("long").alias("size")))
    spans = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "size")).alias("spans"))  # a set: rows that repeat a row have its spans again

    def cut(parts):
        for b in parts:
            lists = b.column(3)
            at, flat = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]), lists.flatten()
            start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            out = [[], [], [], [], []]
            for i, raw in enumerate(_unpacked(b.column(1), b.column(2))):
                text = np.frombuffer(raw, np.uint8)
                s, z = start[at[i] : at[i + 1]], size[at[i] : at[i + 1]]
                if len(s):
                    first, last = (np.minimum(x, len(text)) for x in (s, s + z))
                    step = np.bincount(first, minlength=len(text) + 1) - np.bincount(last, minlength=len(text) + 1)
                    gone = np.cumsum(step)[: len(text)] > 0
                    kept, removed, n = text[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                else:
                    kept, removed, n = text.tobytes(), 0, 0
                for x, v in zip(out, (len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    x.append(v)
            yield pa.record_batch([b.column(0), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = packed.join(spans.hint("shuffle_hash"), "rid", "left").select("doc_id", "size", "packed", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
