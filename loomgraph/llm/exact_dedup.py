"""Exact duplicates by a Golomb-coded fingerprint exchange.

Each task is a sender: it sorts the fingerprints of its texts, cuts them by the owners' ranges and sends each owner its part, Golomb-Rice coded. An
owner merges what it received and answers every sender with a bitmap of the fingerprints that another sender has too. Only the rows so marked,
the suspects, have their texts shuffled, and texts are then grouped by their bytes. All that moves for other rows is a few numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, bit_set, may_hold

BLANKS = " \t\n\x0b\x0c\r"
LOT = 1 << 17  # rows whose fingerprints a sender sorts and codes together
OWNED = 1 << 20  # fingerprints that an owner holds on average
SPARE = 20  # bits of a fingerprint beyond those that number the rows


def normalised(text: Column) -> Column:
    """The text without BLANKS; null is empty."""
    return F.coalesce(F.translate(text, BLANKS, ""), F.lit(""))


def rice_encode(values: np.ndarray, span: int) -> tuple[int, bytes]:
    """(k, code) of ascending distinct values below ``span``: gaps with k low bits each, then their quotients in unary."""
    n = len(values)
    k = max(int(np.log2(max(span / n, 1) * np.log(2) + 1e-9)), 0) if n else 0
    gaps = np.diff(values, prepend=-1) - 1
    low = (gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.int64)) & 1
    ends = np.cumsum((gaps >> k) + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    return k, np.packbits(low.astype(np.uint8).ravel()).tobytes() + np.packbits(unary).tobytes()


def rice_decode(n: int, k: int, code: bytes) -> np.ndarray:
    """The values of ``rice_encode``."""
    data, cut = np.frombuffer(code, np.uint8), (n * k + 7) // 8
    low = np.unpackbits(data[:cut])[: n * k].reshape(n, k).astype(np.int64) @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64))
    quotients = np.diff(np.flatnonzero(np.unpackbits(data[cut:]))[:n], prepend=-1) - 1
    return np.cumsum((quotients << k) + low + 1) - 1


def send(docs: DataFrame, width: int, owner_bits: int) -> DataFrame:
    """Rows of two kinds from ``docs(doc_id, rid, chars, text)``: 0, a row's own (sender, doc_id, rid, chars, fp, sha); 1, a message (sender, owner, n, k, code)."""
    below = width - owner_bits

    def lot(sender, ids, rids, chars, fps, shas):
        rows = len(fps)
        fp = np.array(fps, np.uint64) >> np.uint64(64 - width)
        fp = fp.astype(np.int64)
        yield pa.record_batch(
            [pa.array([0] * rows, pa.int32()), pa.array([sender] * rows, pa.int64()), pa.concat_arrays(ids), pa.concat_arrays(rids), pa.concat_arrays(chars), pa.array(fp), pa.array(shas, pa.binary()),
             *(pa.nulls(rows, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=NAMES)
        own = np.unique(fp)
        owners, at = np.unique(own >> below, return_index=True)
        parts = np.split(own & ((1 << below) - 1), at[1:])
        coded = [rice_encode(p, 1 << below) for p in parts]
        m = len(owners)
        yield pa.record_batch(
            [pa.array([1] * m, pa.int32()), pa.array([sender] * m, pa.int64()), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())),
             pa.array(owners.astype(np.int32)), pa.array([len(p) for p in parts], pa.int32()), pa.array([c[0] for c in coded], pa.int32()), pa.array([c[1] for c in coded], pa.binary())], names=NAMES)

    def run(batches):
        task, lots = TaskContext.get().partitionId(), 0
        ids, rids, chars, fps, shas = [], [], [], [], []
        for b in batches:
            for s in range(0, len(b), 4096):
                part = b.slice(s, 4096)
                texts = [t.translate(None, BLANKS.encode()) for t in as_bytes(part.column(3))]
                for have, column in ((ids, 0), (rids, 1), (chars, 2)):
                    have.append(part.column(column))
                fps += [xxhash.xxh64_intdigest(t) for t in texts]
                shas += [hashlib.sha256(t).digest() for t in texts]
                if len(fps) >= LOT:
                    yield from lot(task << 24 | lots, ids, rids, chars, fps, shas)
                    lots, ids, rids, chars, fps, shas = lots + 1, [], [], [], [], []
        if fps:
            yield from lot(task << 24 | lots, ids, rids, chars, fps, shas)

    return docs.select("doc_id", "rid", "chars", "text").mapInArrow(run, SENT)


NAMES = ["kind", "sender", "doc_id", "rid", "chars", "fp", "sha", "owner", "n", "k", "code"]
SENT = "kind int, sender long, doc_id long, rid long, chars int, fp long, sha binary, owner int, n int, k int, code binary"


def answer(messages: DataFrame) -> DataFrame:
    """(sender, owner, n, bitmap): for each message, which of its fingerprints came from another sender as well."""

    def merge(key, table):
        lists = [rice_decode(n, k, code) for n, k, code in zip(*(table.column(c).to_pylist() for c in ("n", "k", "code")), strict=True)]
        every = np.sort(np.concatenate(lists))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "n": table.column("n"), "bitmap": pa.array([np.packbits(np.isin(x, shared)).tobytes() for x in lists], pa.binary())})

    return messages.select("sender", "owner", "n", "k", "code").groupBy("owner").applyInArrow(merge, "sender long, owner int, n int, bitmap binary")


def suspects(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, rid, chars, sha, place, suspect) of the senders' rows: suspects have a fingerprint twice in their lot or in an owner's answer."""

    def mark(key, own, got):
        fp = own.column("fp").to_numpy()
        distinct, at, count = np.unique(fp, return_inverse=True, return_counts=True)
        got = got.sort_by("owner")
        shared = np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8))[:n] for n, bits in zip(got.column("n").to_pylist(), got.column("bitmap").to_pylist(), strict=True)])
        found = (shared.astype(bool) | (count > 1))[at]
        place = (key[0].as_py() << 20) + np.arange(len(fp))
        return own.select(["doc_id", "rid", "chars", "sha"]).append_column("place", pa.array(place)).append_column("suspect", pa.array(found))

    return rows.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(mark, "doc_id long, rid long, chars int, sha binary, place long, suspect boolean")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row: groups of texts that are equal without BLANKS.

    Of a group the row with the most code points in its original text stays, then the smallest doc_id, null last; of rows that tie in both, one. Null and
    blank texts are one group. Repeated rows count and come back as often as they came in. Very long texts are read whole. An
    empty table gives an empty result. Columns besides doc_id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("chars", F.coalesce(F.length("text"), F.lit(0)))
    n = docs.select("doc_id").count()
    owner_bits = min(max((n // OWNED).bit_length(), 4), 16)
    sent = scratch.save(send(docs, min(n.bit_length() + SPARE, 60), owner_bits), "sent", ["kind"])
    rows, messages = sent.where("kind = 0").select("sender", "doc_id", "rid", "chars", "fp", "sha"), sent.where("kind = 1")
    rows = scratch.save(suspects(rows, answer(messages)), "rows")
    scratch.drop("sent")
    doubtful = rows.where("suspect")
    pages, bits = bit_set(doubtful.select(F.col("rid").alias("key")), doubtful.count())
    texts = may_hold(docs.select("rid", "text"), F.col("rid"), pages, bits).select(normalised(F.col("text")).alias("norm"))
    equal = texts.groupBy("norm").agg(F.count("*").alias("copies")).where("copies > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"))
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("without"), "doc_id", "place")).alias("best")
    groups = doubtful.groupBy("sha").agg(F.count("*").alias("group_size"), best).join(equal, "sha")
    groups = scratch.save(groups.select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.place").alias("first")), "groups")
    same = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")]
    met = doubtful.join(groups, "sha", "left").withColumn("keep_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    met = met.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long"))).withColumn("kept", F.coalesce(F.col("first") == F.col("place"), F.lit(True)))
    alone = rows.where("not suspect").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long")).withColumn("kept", F.lit(True))
    return met.select(*same).unionByName(alone.select(*same))
