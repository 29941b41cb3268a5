"""Streams of items and documents: duplicates, rates, idempotent ingestion."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.catalog import messages_to_documents
from ..operators.chunking import assemble_chunks


def stream_dedup(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first of equal keys within the watermark's delay; state is dropped as the watermark passes."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_rates(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows of each source in windows of ten minutes that begin every minute; rows later than the delay are dropped."""
    windows = F.window("ts", "10 minutes", "1 minute")
    return stream.withWatermark("ts", delay).groupBy(windows.alias("w"), "source").agg(F.count("*").alias("n")).select("source", F.col("w.start").alias("start"), (F.col("n") / 10).alias("per_minute"))


def stream_ingest(stream: DataFrame, path: str, checkpoint: str, pieces: str | None = None) -> DataStreamWriter:
    """Writes documents once per (doc_id, hash of text), whatever batch they come in; with ``pieces``, also their chunks, to that path.

    Each batch has its own folder, so that a batch run again replaces itself; what earlier batches wrote is left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("sha256", F.coalesce(F.sha2("text", 256), F.lit(""))).dropDuplicates(["doc_id", "sha256"])
        stored = _stored(batch.sparkSession, path)
        if stored is not None:
            seen = stored.where(F.col("batch") < batch_id).select(F.col("doc_id").alias("d"), F.col("sha256").alias("s"))
            rows = rows.join(seen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha256") == F.col("s")), "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if pieces:
            new = batch.sparkSession.read.parquet(f"{path}/batch={batch_id}")
            assemble_chunks(new).write.mode("overwrite").parquet(f"{pieces}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing is there yet
        return None


def stream_microbatch(stream: DataFrame, path: str, checkpoint: str, size: int = 200, every: str = "1500 milliseconds", once: bool = False) -> DataStreamWriter:
    """Plans batches of at most ``size`` ids of a source: each trigger's ids (source, id), repeats once, numbered within the trigger."""
    from ..operators.catalog import plan_batches

    def write(batch: DataFrame, batch_id: int) -> None:
        plan_batches(batch.select("source", "id"), size).write.mode("overwrite").parquet(f"{path}/trigger={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)


def stream_overview(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keeps counts per source of a stream of (source, id): each batch is added to its own sources, the others stay as they are.

    Version v of the counts is in ``path``/v=(batch id); a batch run again replaces its version. ``overview`` reads the latest.
    """
    from ..operators.explore import overview_incremental

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh, before = batch.groupBy("source").agg(F.count("*").alias("n")), overview(batch.sparkSession, path, batch_id)
        if before is not None:
            dirty = fresh.select("source")
            added = before.join(dirty, "source", "left_semi").unionByName(fresh).groupBy("source").agg(F.sum("n").alias("n"))
            fresh = overview_incremental(before, added, dirty, "source")
        fresh.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def overview(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest counts (before a batch)."""
    stored = _stored(spark, path)
    if stored is None:
        return None
    stored = stored if before is None else stored.where(F.col("v") < before)
    last = stored.agg(F.max("v")).first()[0]
    return None if last is None else spark.read.parquet(f"{path}/v={last}")


def stream_conversations(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """The document of ``messages_to_documents`` for each conversation of ``stream(conv_id, turn, role, text, ts)``, once no message has come for ``gap``.

    Messages may come in any triggers and order; those of one conversation that lie no further apart than ``gap`` are one document. The state of a
    conversation goes with its document, as the watermark passes its end; messages later than ``delay`` are dropped.
    """
    return messages_to_documents(stream.withWatermark("ts", delay), F.session_window("ts", gap))


BATCHES = "source string, shard int, batch long, ids array<long>"


def stream_batches(stream: DataFrame, size: int = 200, flush_ms: int = 1500, shards: int = 1) -> DataFrame:
    """Batches of exactly ``size`` ids of a source from ``stream(source, id)``: what a trigger leaves open is filled by the next ones.

    A batch that is still open ``flush_ms`` after its last id is given out as it is. The state of a source is its open ids, fewer than ``size``, and the number
    of its next batch. ``shards`` cuts sources that are too large for one task into independent series. Repeats of ids are for ``stream_dedup``.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fill(key, frames, state: GroupState):
        open_, number = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        if state.hasTimedOut:
            if open_:
                out.append((*key, number, open_))
            state.update(([], number + bool(open_)))  # the numbers go on
        else:
            for f in frames:
                open_ += f["id"].tolist()
            while len(open_) >= size:
                out.append((*key, number, open_[:size]))
                open_, number = open_[size:], number + 1
            state.update((open_, number))
            if open_:
                state.setTimeoutDuration(flush_ms)
        yield pd.DataFrame(out, columns=["source", "shard", "batch", "ids"])

    rows = stream.select("source", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("long").alias("id"))
    return rows.groupBy("source", "shard").applyInPandasWithState(fill, BATCHES, "open array<long>, number long", "append", GroupStateTimeout.ProcessingTimeTimeout)
