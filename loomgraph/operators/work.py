"""Plans over tables about work: pending writes, retries, progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recall import numbered, top

# Parts of messages of errors that may pass or stay, and seconds to wait by attempt.
TRANSIENT = ["timeout", "timed out", "rate limit", "too many requests", "temporarily unavailable", "connection reset", "connection aborted", "connection refused", "connection error", "server disconnected", "database is locked", "database is busy", "busy timeout", " 429", " 500", " 502", " 503", " 504"]
PERMANENT = [" 400", " 401", " 403", " 404", "validation error", "schema validation", "invalid api key", "unauthorized", "forbidden", "not found"]
BACKOFF = [10, 30, 90, 180, 300, 600, 900, 1800]


def retryable(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda markers: reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in markers])
    return has(TRANSIENT) & ~has(PERMANENT)


def dedupe_pending(refs: DataFrame, missing: DataFrame) -> DataFrame:
    """References of ``refs(source, id, job_id, inflight, created)`` to keep: those of jobs in flight, and the first pending one of a missing id.

    An id that a job in flight holds is not pending again; a job that names an id twice counts once.
    """
    first = Window.partitionBy("source", "id").orderBy(F.desc("inflight"), "created", "job_id")
    rows = refs.distinct().withColumn("rn", F.row_number().over(first)).join(missing.select("source", "id").distinct().withColumn("missing", F.lit(True)), ["source", "id"], "left")
    return rows.where("inflight OR (rn = 1 AND missing)").select("source", "id", "job_id")


def consolidate_jobs(refs: DataFrame, size: int) -> DataFrame:
    """Distinct pending ids that no job in flight holds, in batches of each source."""
    busy = refs.where("inflight").select("source", "id").distinct()
    ids = refs.where("NOT inflight").select("source", "id").distinct().join(busy, ["source", "id"], "left_anti")
    batch = F.floor(F.col("place") / size).cast("int")
    return numbered(ids, "source", "id").withColumn("batch", batch).groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def consolidation_counts(refs: DataFrame, size: int) -> DataFrame:
    """Per source of ``refs(source, id, job_id, inflight, payload)`` with pending jobs: old jobs and references, distinct ids left, duplicates, new
    jobs, and the payload most of the pending jobs have (the smallest of equals). Ids that a job in flight holds are not left.
    """
    pending = refs.where("NOT inflight")
    busy = refs.where("inflight").select("source", "id").distinct().withColumn("busy", F.lit(True))
    ids = pending.groupBy("source", "id").agg(F.count("*").alias("n")).join(busy, ["source", "id"], "left")
    counts = ids.groupBy("source").agg(F.sum("n").alias("old_refs"), F.count(F.when(F.col("busy").isNull(), 1)).alias("unique_refs"), (F.sum("n") - F.count("*")).alias("duplicate_refs"))
    jobs = pending.groupBy("source", "job_id").agg(F.min("payload").alias("payload"))
    modes = jobs.groupBy("source", "payload").agg(F.count("*").alias("n"))
    olds = modes.groupBy("source").agg(F.sum("n").alias("old_jobs"))
    mode = top(modes, ["source"], [F.desc("n"), F.col("payload")], 1).select("source", "payload")
    return counts.join(olds, "source").join(mode, "source").withColumn("new_jobs", F.ceil(F.col("unique_refs") / size))


def register_items(active: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct new record once; created is false where an active item exists."""
    known = active.select(*keys).distinct().withColumn("known", F.lit(True))
    return new.select(*keys).distinct().join(known, keys, "left").select(*keys, F.col("known").isNull().alias("created"))


def split_retry(refs: DataFrame, max_attempts: int) -> DataFrame:
    """What becomes of failed jobs ``refs(job_id, id, attempts, retryable)``, a row for each id: two halves by id, another attempt after a pause, or failure.

    The part of each id is 0 or 1; ids are unique in a job.
    """
    sizes = refs.groupBy("job_id").agg(F.count("*").alias("n"))
    rows = numbered(refs, "job_id", "id").join(sizes, "job_id")
    halved = F.col("retryable") & (F.col("n") > 1)
    part = F.when(halved & (F.col("place") >= F.floor(F.col("n") / 2)), 1).otherwise(0)
    action = F.when(halved, "split").when(F.col("attempts") < max_attempts, "retry").otherwise("fail")
    delay = F.get(F.array(*map(F.lit, BACKOFF)), F.greatest(F.lit(0), F.least(F.col("attempts") - 1, F.lit(len(BACKOFF) - 1))).cast("int"))
    return rows.select("job_id", action.alias("action"), F.when(action == "retry", delay).alias("delay"), part.alias("part"), "id")


AUXILIARY = ["entity_vectors", "event_entity_vectors"]


def backfill_status(items: DataFrame, sources: DataFrame, deferred: bool) -> DataFrame:
    """Per source of ``sources(source)``: pending ``items(source, table_name, pending)`` of the auxiliary tables, and a state.

    backfilling with pending items; without, deferred if such writes are put off, else complete. Rows without a source are unknown.
    """
    waiting = items.where(F.col("pending") & F.col("table_name").isin(*AUXILIARY))
    counts = waiting.groupBy("source").agg(*[F.count(F.when(F.col("table_name") == t, 1)).alias(t) for t in AUXILIARY])
    rows = sources.select("source").distinct().join(counts, "source", "left").na.fill(0, AUXILIARY)
    n = F.col(AUXILIARY[0]) + F.col(AUXILIARY[1])
    state = F.when(F.col("source").isNull(), "unknown").when(n > 0, "backfilling").otherwise("deferred" if deferred else "complete")
    return rows.select("source", *AUXILIARY, n.alias("pending"), state.alias("state"))


def backfill_overall(status: DataFrame) -> DataFrame:
    """One row over all sources: backfilling if one is, deferred if one is, complete if one is, else unknown."""
    some = lambda s: F.coalesce(F.max(F.col("state") == s), F.lit(False))
    state = F.when(some("backfilling"), "backfilling").when(some("deferred"), "deferred").when(some("complete"), "complete").otherwise("unknown")
    return status.agg(F.count("*").alias("sources"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*AUXILIARY, "pending")], state.alias("state"))


def stall_reason(per_minute: Column, total: Column, pending: Column, paused: Column, queued: Column, running: Column) -> Column:
    """Why nothing is finished: queued_waiting, running_in_progress, paused, no_worker, idle; null where something is, or there is nothing."""
    left = pending - paused
    waiting = F.when(queued > 0, "queued_waiting").when(running > 0, "running_in_progress").when(paused > 0, "paused").otherwise("no_worker")
    return F.when((per_minute == 0) & (left > 0), waiting).when((per_minute == 0) & (total > 0) & (left <= 0), "idle")


def ingest_stats(documents: DataFrame, jobs: DataFrame, items: DataFrame, chunks: DataFrame, events: DataFrame, now: str, minutes: int = 10) -> DataFrame:
    """One row: documents by status, jobs waiting and running, what the last minutes finished a minute, seconds left, reason of a stall.

    ``documents(status)``, ``jobs(status, ts)``, ``items(status, ts)``, ``chunks(ts)``, ``events(ts)``; the window ends at ``now``, with both ends.
    """
    moment = F.lit(now).cast("timestamp")
    recent = (F.col("ts") <= moment) & (F.col("ts") >= moment - F.make_dt_interval(mins=F.lit(minutes)))
    kinds = {"doc": documents.select("status"), "job": jobs.select("status", "ts"), "item": items.select("status", "ts"), "chunk": chunks.select("ts"), "event": events.select("ts")}
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("kind", F.lit(k)) for k, df in kinds.items()])
    n = lambda kind, c: F.count(F.when((F.col("kind") == kind) & c, 1))
    is_ = lambda s: F.upper("status") == s
    row = every.agg(
        n("doc", F.lit(True)).alias("total"), *[n("doc", is_(s)).alias(a) for s, a in (("READY", "indexed"), ("FAILED", "failed"), ("PAUSED", "paused"), ("LOADING", "loading"), ("EXTRACTING", "extracting"))],
        n("job", is_("QUEUED")).alias("queued"), n("job", is_("RUNNING")).alias("running"), (n("job", is_("SUCCEEDED") & recent) / minutes).alias("docs_per_minute"),
        (n("item", is_("SUCCEEDED") & recent) / minutes).alias("items_per_minute"), (n("chunk", recent) / minutes).alias("chunks_per_minute"), (n("event", recent) / minutes).alias("events_per_minute"),
    ).withColumn("pending", F.col("total") - F.col("indexed") - F.col("failed"))
    left = F.col("pending") - F.col("paused")
    eta = F.when((F.col("docs_per_minute") > 0) & (left > 0), F.round(left / F.col("docs_per_minute") * 60).cast("long"))
    return row.withColumn("eta_seconds", eta).withColumn("stall", stall_reason(*map(F.col, ("docs_per_minute", "total", "pending", "paused", "queued", "running"))))


def ingest_rates(items: DataFrame, now: str, minutes: int) -> DataFrame:
    """Per source of ``items(source, ts)``: finished in the last minutes, still to come after ``now``, and minutes needed at that rate."""
    moment = F.lit(now).cast("timestamp")
    recent = (F.col("ts") <= moment) & (F.col("ts") > moment - F.make_dt_interval(mins=F.lit(minutes)))
    counts = items.groupBy("source").agg(F.count(F.when(recent, 1)).alias("recent"), F.count(F.when(F.col("ts") > moment, 1)).alias("remaining"))
    return counts.withColumn("eta", F.round(F.col("remaining") * minutes / F.nullif("recent", F.lit(0)), 3))
