"""Helpers shared by the corpus operators: scratch tables, Arrow text buffers, connected components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is configured and all runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _FALLBACK[app]


class Scratch:
    """Tables of one query below the shared folder. ``drop`` removes what later steps no longer read; the rest goes when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)  # deleteOnExit takes only what exists
        files.deleteOnExit(path)

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession, model: object) -> Callable[[], object]:
    """A function that returns ``model`` inside tasks; it is sent to each executor once, its class included."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(sent.value)


def carried(docs: DataFrame, *own: str) -> Column:
    """The row as a struct named row, without columns that the operator itself will return (its names win)."""
    return F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(docs.columns) if c not in own], F.lit(0).alias("_none")).alias("row")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; row i is bytes[offsets[i]:offsets[i+1]], null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int32)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets.astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows and about ``size`` bytes of column ``text``; a row is never cut."""
    for b in batches:
        offsets, i = text_buffers(b.column(text))[1], 0
        while i < len(b):
            j = min(max(int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1, i + 1), i + rows, len(b))
            yield b.slice(i, j - i)
            i = j


def as_bytes(column: pa.Array) -> list[bytes]:
    """Rows as UTF-8 bytes; null rows are empty."""
    data, offsets = text_buffers(column)
    whole = memoryview(data)
    return [bytes(whole[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def connect(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the links i-j into ``labels``, in which each node points at the smallest node of its set."""
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels[:] = further


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)`` that is not the smallest of its component.

    Alternating large-star and small-star rounds; each round is one written table, so that its lineage is short and a
    lost executor costs a task only. A node with a third of all links is a partial minimum plus a join that adaptive
    execution can split. Rounds end when the links no longer change.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, mark, k = scratch.save(links, f"{tag}0"), None, 0
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        k += 1
        links = scratch.save(small, f"{tag}{k}")
        scratch.drop(f"{tag}{k - 1}")


PAGE_BITS, MOST_BITS = 15, 28  # bits of a page of a bit set, and of the largest bit set (2**28 bits are 32 MB)


def _slot(key: Column, bits: int) -> tuple[Column, Column]:
    slot = F.shiftrightunsigned(key, 64 - bits)
    return F.shiftright(slot, PAGE_BITS), slot.bitwiseAND(F.lit((1 << PAGE_BITS) - 1))


def bit_set(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(pages, bits): the 64-bit hashes ``key`` as a set of bits, 16 for each of ``n`` keys and never more than 2**MOST_BITS, so that it can be broadcast."""
    bits = min(max((16 * n).bit_length(), PAGE_BITS), MOST_BITS)
    page, place = _slot(F.col("key"), bits)
    return keys.where("key is not null").select(page.alias("_set_page"), place.alias("_set_place")).groupBy("_set_page").agg(F.bitmap_construct_agg("_set_place").alias("_set_bits")), bits


def _looked_up(df: DataFrame, key: Column, pages: DataFrame, bits: int, how: str) -> DataFrame:
    page, place = _slot(key, bits)
    byte = F.conv(F.hex(F.substring("_set_bits", F.shiftright(F.col("_set_place"), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.withColumn("_set_page", page).withColumn("_set_place", place).join(F.broadcast(pages), "_set_page", how).withColumn("_set_in", F.getbit(byte, (F.col("_set_place") % 8).cast("int")) == 1)


def may_hold(df: DataFrame, key: Column, pages: DataFrame, bits: int) -> DataFrame:
    """Rows of ``df`` whose key is in the bit set, and a few others: where the set is at its largest size more others pass, and none is lost."""
    return _looked_up(df, key, pages, bits, "inner").where("_set_in").drop("_set_page", "_set_place", "_set_bits", "_set_in")


def in_set(df: DataFrame, key: Column, pages: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with ``name``: true for keys of the bit set and a few others, false only for keys that are not in it."""
    return _looked_up(df, key, pages, bits, "left").withColumn(name, F.coalesce("_set_in", F.lit(False))).drop("_set_page", "_set_place", "_set_bits", "_set_in")
