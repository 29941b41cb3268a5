"""Documents, messages, counts, write planning and audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .recall import numbered, top


# Words of the documents made from messages and pages.
MESSAGES, NAMELESS, SOURCE_LINE = "消息", "文本", "> 来源："


def _filled(name: str, columns: list[str]) -> Column:
    """A column's value, null where it is empty or missing."""
    return F.nullif(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit(None).cast("string")


def messages_to_documents(messages: DataFrame, window: Column | None = None) -> DataFrame:
    """One text per conversation: a header, then each turn with its author (else role) and, if known, time ``ts``, in order of turn.

    A conversation is one document, so its turns meet in one row; with a ``window`` (a stream's session) it is one for each of its windows.
    """
    who = F.coalesce(_filled("author", messages.columns), _filled("role", messages.columns), F.lit(MESSAGES))
    line = F.concat(F.lit("**"), who, F.lit("**"), F.coalesce(F.concat(F.lit("（"), _filled("ts", messages.columns), F.lit("）")), F.lit("")), F.lit("："), F.coalesce("text", F.lit("")))
    grouped = messages.groupBy("conv_id", *([] if window is None else [window])).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    text = F.concat(F.lit(f"# {MESSAGES}\n\n\n\n"), F.array_join(F.transform("t", lambda t: t.line), "\n\n"))
    return grouped.select("conv_id", F.concat(F.lit(f"{MESSAGES}-"), F.size("t").cast("string"), F.lit("条")).alias("title"), text.alias("text"))


def ingest_content(rows: DataFrame) -> DataFrame:
    """``rows(title, text, messages)`` with filename, content and error: the text of messages if there is one, else title and text, else an error."""
    title, text, messages = (F.nullif(F.col(c), F.lit("")) for c in ("title", "text", "messages"))
    content = F.coalesce(messages, F.concat(F.coalesce(F.concat(F.lit("# "), title, F.lit("\n\n")), F.lit("")), text))
    name = F.coalesce(title, F.when(messages.isNotNull(), MESSAGES).otherwise(NAMELESS))
    error = F.when(content.isNull(), "text or messages needed")
    return rows.withColumn("error", error).withColumn("filename", F.when(F.col("error").isNull(), F.concat(name, F.lit(".md")))).withColumn("content", content)


def html_document(pages: DataFrame, most: int = 8 << 20) -> DataFrame:
    """``pages(page_id, url, html)`` as documents (id, title, filename, content); a page without a body has an error in place of a content.

    Of a page the first ``most`` characters count; that cut is part of the format. Null addresses and pages are empty.
    """
    html = F.substring(F.coalesce("html", F.lit("")), 1, most)
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)[^>]*>.*?</\1>", " "), "(?s)<[^>]+>", " ")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[ \\t]+", " "), r"\n\s*\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")
    host = F.coalesce(F.try_parse_url("url", F.lit("AUTHORITY")), F.lit(""))
    path = F.replace(F.btrim(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/")), F.lit("/"), F.lit("-"))
    slug = F.coalesce(F.nullif(path, F.lit("")), F.nullif(host, F.lit("")), F.lit("page"))
    slug = F.coalesce(F.nullif(F.btrim(F.substring(F.regexp_replace(slug, "[^A-Za-z0-9._-]", "-"), 1, 60), F.lit("-")), F.lit("")), F.lit("page"))
    filename = F.concat(F.when(host != "", F.concat(host, F.lit("-"))).otherwise(""), slug, F.lit(".md"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("u"), body.alias("body"), filename.alias("filename"), html_title(html).alias("t"))
    rows = rows.withColumn("title", F.coalesce(F.nullif("t", F.lit("")), "filename"))
    content = F.concat(F.lit("# "), "title", F.lit(f"\n\n{SOURCE_LINE}"), "u", F.lit("\n\n"), "body", F.lit("\n"))
    return rows.select("page_id", F.substring(F.md5("u"), 1, 12).alias("id"), "title", "filename", F.when(F.col("body") != "", content).alias("content"), F.when(F.col("body") == "", "no body").alias("error"))


def content_hash(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.sha2(F.col(text), 256).alias("sha256"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "[ \\t\\r\\n]+", " "))


def plan_folder_sync(listing: DataFrame, existing: DataFrame) -> DataFrame:
    """new, unchanged or changed per (source, path) by hash without regard to case."""
    old = existing.select("source", "path", F.lower("sha256").alias("old"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.lower("sha256"), "unchanged").otherwise("changed")
    return listing.join(old, ["source", "path"], "left").select("source", "path", status.alias("status"))


def folder_plan(listing: DataFrame, existing: DataFrame, root: str, most_bytes: int = 100 << 20, most_items: int = 20_000, most_total: int = 5 << 30) -> DataFrame:
    """``listing(source, path, sha256, size_bytes)`` with status and reason: rejected, else new, unchanged or changed against ``existing``.

    Rejected are paths that are refused or not below ``root``, hashes that are none, files too large, those routed to skip, PDF and office
    files (not selected by default), and all of a request that lists more than ``most_items`` files or ``most_total`` bytes. A request is a source's rows of
    one ``request``, where the listing has that column (a folder of more files comes in several), else all of its rows. Files that are only in ``existing`` stay.
    """
    from ..sources.files import bad_path, route_files

    clean = F.ltrim(F.regexp_replace(F.trim(F.replace("path", F.lit("\\"), F.lit("/"))), r"^(\./)+", ""), F.lit("/"))
    of = [c for c in ("source", "request") if c in listing.columns]
    totals = listing.groupBy(*of).agg(F.count("*").alias("_n"), F.sum("size_bytes").alias("_total"))
    rows = listing.join(totals, of).withColumn("path", F.coalesce(clean, F.lit(""))).withColumn("sha256", F.lower(F.trim(F.coalesce("sha256", F.lit("")))))
    if "head" not in rows.columns:
        rows = rows.withColumn("head", F.lit(None).cast("string"))
    rows = route_files(rows).withColumnRenamed("reason", "_why")
    p = F.col("path")
    wrong = (
        F.when(F.col("_n") > most_items, "too many files").when(F.col("_total") > most_total, "too many bytes")
        .when(bad_path(p).isNotNull() | F.exists(F.split(p, "/"), lambda d: d == "") | (F.length(p) > 1024), "path").when(~p.startswith(root + "/"), "root")
        .when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "hash").when(F.col("size_bytes") > most_bytes, "too large")
        .when(F.col("route") == "skip", F.col("_why")).when(F.col("route").isin("pdf", "office"), "not selected")
    )
    old = existing.select("source", "path", F.lower("sha256").alias("_old"), F.lit(True).alias("_known"))
    found = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_known").isNull(), "new").when(F.col("_old") == F.col("sha256"), "unchanged").otherwise("changed")
    return rows.withColumn("reason", wrong).join(old, ["source", "path"], "left").select("source", "path", found.alias("status"), "reason")


def upsert(batch: DataFrame, path: str, key: str, order: str) -> dict[str, int]:
    """Writes the batch's last row of each key over the latest version of the table at ``path``; returns rows inserted, updated and kept.

    Every call writes a whole new version, which ``upserted`` reads once it is complete, so a call that is broken off changes nothing.
    """
    spark = batch.sparkSession
    old = upserted(spark, path)
    target = (old if old is not None else batch.where("false")).drop("version")
    version = 0 if old is None else old.agg(F.max("version")).first()[0] + 1
    where = f"{path}/version={version}"
    upsert_rows(batch, target, key, order).write.mode("overwrite").parquet(where)
    n = {r["change"]: r["count"] for r in spark.read.parquet(where).groupBy("change").count().collect()}
    return {"inserted": n.get("insert", 0), "updated": n.get("update", 0), "kept": n.get("keep", 0)}


def upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version of a table written by ``upsert``, or None."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException:  # nothing is there yet
        return None
    return rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).drop("change")


def upsert_rows(batch: DataFrame, target: DataFrame, key: str, order: str) -> DataFrame:
    """The batch's last row per key over the target's other rows; change tells insert, update, keep."""
    last = top(batch, [key], [F.desc(order)], 1, "rn").drop("rn")
    known = target.select(key)
    new = last.join(known, key, "left_anti").withColumn("change", F.lit("insert"))
    old = last.join(known, key, "left_semi").withColumn("change", F.lit("update"))
    return new.unionByName(old).unionByName(target.join(last.select(key), key, "left_anti").withColumn("change", F.lit("keep")))


def refresh_source_counts(sources: DataFrame, documents: DataFrame) -> DataFrame:
    sums = documents.groupBy(F.col("source_id").alias("source_config_id")).agg(F.count("*").alias("n"), F.sum("chunk_count").alias("chunks"), F.sum("event_count").alias("events"))
    return sources.join(sums, "source_config_id", "left").select("source_config_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "chunks", "events")])


def status_counts(documents: DataFrame) -> DataFrame:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = F.col("status")
    return documents.groupBy("source_id").agg(F.count("*").alias("total"), count(s == "READY").alias("ready"), count(s == "FAILED").alias("failed"), count(s == "PAUSED").alias("paused"), count(~s.isin("READY", "FAILED")).alias("pending"))


def list_documents(documents: DataFrame, status: str, keyword: str, limit: int, offset: int) -> DataFrame:
    found = documents.where((F.col("status") == status) & F.contains(F.lower("filename"), F.lit(keyword.lower())))
    return found.orderBy(F.desc("created_at"), "document_id").offset(offset).limit(limit).select("document_id", "filename")


def outline(chunks: DataFrame, per_document: int) -> DataFrame:
    """The first chunks of each document by rank with heading and length."""
    return top(chunks, ["doc_id"], [F.col("rank")], per_document).select("doc_id", "chunk_id", "rank", "heading", F.length("content").alias("length"))


def recent_activity(documents: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    latest = top(documents, ["source_id"], [F.desc("created_at"), F.col("document_id")], k)
    return latest.join(sources, F.col("source_id") == F.col("source_config_id")).select("source_id", "name", "document_id", "rn")


def history_window(messages: DataFrame, budget: int, keep_recent: int = 2) -> DataFrame:
    """The newest messages whose running token sum (a quarter of the characters) is within the budget; one at least.

    A conversation of at most max(2, keep_recent) messages stays whole.
    """
    size = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("cum", F.sum(size).over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(back))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    return rows.where((F.col("cum") <= budget) | (F.col("rn") == 1) | (F.col("n") <= max(2, keep_recent))).select("conv_id", "turn", "cum")


def pick_documents(documents: DataFrame, k: int, explicit: DataFrame | None = None) -> DataFrame:
    """The k first documents of each source by status, events, time and id: those with events, or, if given, those of ``explicit(document_id)``."""
    rank = F.array_position(F.array(*map(F.lit, ("READY", "EXTRACTING", "FAILED", "PAUSED", "LOADING", "PENDING"))), F.col("status"))
    rows = documents.where("event_count > 0") if explicit is None else documents.join(explicit.select("document_id"), "document_id", "left_semi")
    return top(rows, ["source_id"], [rank, F.desc("event_count"), F.desc("created_at"), F.desc("document_id")], k).select("source_id", "document_id", "rn")


def ingest_busy(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """busy: a document of the source is under way, or a queued or running one of ``jobs(source_id, document_id, status)`` has such a document."""
    active = F.col("status").isin("PENDING", "LOADING", "EXTRACTING")
    own = documents.select("source_id", F.coalesce(active, F.lit(False)).alias("b"))
    held = jobs.where(F.lower("status").isin("queued", "running")).select("source_id", "document_id").join(documents.where(active).select("document_id"), "document_id", "left_semi")
    return own.unionByName(held.select("source_id", F.lit(True).alias("b"))).groupBy("source_id").agg(F.max("b").alias("busy"))


def plan_batches(ids: DataFrame, size: int, scheduled: DataFrame | None = None) -> DataFrame:
    """Distinct ids of each source in order, without those ``scheduled(source, id)``, cut into batches of ``size``. Null ids drop out."""
    rows = ids.select("source", "id").distinct()
    if scheduled is not None:
        rows = rows.join(scheduled.select("source", "id"), ["source", "id"], "left_anti")
    return numbered(rows, "source", "id").select("source", "id", F.floor(F.col("place") / size).cast("int").alias("batch"))


def _percentiles(rows: DataFrame, key: str, slow: float) -> DataFrame:
    """Per key: the element at index min(n - 1, int(n p)) in order of duration, the longest, and how many took ``slow`` or more."""
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("duration_ms", "id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    at = lambda p: F.max(F.when(F.col("pos") == F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("duration_ms")))
    most = F.max("duration_ms").alias("max")
    return rows.groupBy(key).agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), most, F.count(F.when(F.col("duration_ms") >= slow, 1)).alias("slow"))


def latency_summary(samples: DataFrame, slow: float, last: int = 4096, routes: int = 20) -> DataFrame:
    """The ``last`` samples of all: a row with null path for all of them, and one for each of the paths with the longest requests.

    The window is the feature: it bounds the rows that meet in a task.
    """
    recent = samples.select("path", "duration_ms", "ts", "id").orderBy(F.desc("ts"), F.desc("id")).limit(last)
    by_path = _percentiles(recent, "path", slow).orderBy(F.desc("max"), "path").limit(routes)
    whole = _percentiles(recent.withColumn("path", F.lit(None).cast("string")), "path", slow)
    return whole.unionByName(by_path)


def slowest_requests(samples: DataFrame, slow: float, last: int = 4096, k: int = 10) -> DataFrame:
    """The k slowest of the ``last`` samples that took ``slow`` or more."""
    return samples.orderBy(F.desc("ts"), F.desc("id")).limit(last).where(F.col("duration_ms") >= slow).orderBy(F.desc("duration_ms"), "id").limit(k)


def missing_vector_ids(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """(source, id) of the visible events without a vector, as batches of writes take them."""
    seen = events.where("status IS NULL OR status <> 'DELETED'")
    return seen.join(vectors, "event_id", "left_anti").select(F.col("source_config_id").alias("source"), F.col("event_id").alias("id"))


def missing_vectors(events: DataFrame, vectors: DataFrame) -> DataFrame:
    return missing_vector_ids(events, vectors).groupBy(F.col("source").alias("source_config_id")).agg(F.count("*").alias("missing"))


def queue_audit(refs: DataFrame) -> DataFrame:
    """Per status of ``refs(status, job_id, id)``: jobs, references, distinct ids, duplicates."""
    return refs.groupBy("status").agg(F.countDistinct("job_id").alias("jobs"), F.count("*").alias("refs"), F.countDistinct("id").alias("unique_ids")).withColumn("duplicates", F.col("refs") - F.col("unique_ids"))


def queue_sources(jobs: DataFrame, k: int = 10) -> DataFrame:
    """The k sources of ``jobs(source, job_id)`` with most jobs."""
    return jobs.groupBy("source").agg(F.countDistinct("job_id").alias("jobs")).orderBy(F.desc("jobs"), "source").limit(k)


def queue_items(items: DataFrame) -> DataFrame:
    """Items of ``items(kind, version, status)`` by all three."""
    return items.groupBy("kind", "version", "status").agg(F.count("*").alias("n"))


def url_list(rows: DataFrame, config: str) -> DataFrame:
    """The http(s) addresses with a host in a list that commas and line breaks separate."""
    urls = rows.withColumn("url", F.explode(F.split(config, "[,\\n]"))).withColumn("url", F.trim("url"))
    return urls.where(F.col("url").rlike("^https?://[^/?#]+")).drop(config)


def html_body(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation, headers and footers; blanks collapse."""
    for tag in ("script", "style", "nav", "header", "footer"):
        html = F.regexp_replace(html, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), "[ \\t\\r\\n]+", " "))


def text_to_document(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(F.trim(title), F.lit("")) != "", F.concat(F.lit("# "), F.trim(title), F.lit("\n\n"), F.coalesce(text, F.lit("")))).otherwise(F.coalesce(text, F.lit("")))


def publish_revision(documents: DataFrame, staged: DataFrame) -> DataFrame:
    """Documents with the values of complete ``staged(document_id, sha256, size_bytes, complete)`` rows; replaced marks them."""
    new = staged.where("complete").select("document_id", F.col("sha256").alias("_h"), F.col("size_bytes").alias("_s"))
    rows = documents.join(new, "document_id", "left")
    return rows.select("document_id", F.coalesce("_h", "sha256").alias("sha256"), F.coalesce("_s", "size_bytes").alias("size_bytes"), F.col("_h").isNotNull().alias("replaced"))


def publish_revisions(documents: DataFrame, staged: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """Publishes complete revisions ``staged(document_id, sha256, size_bytes, chunk_count, event_count, derived_id, complete)``.

    documents: with the new values and ``replaced``; sources: totals changed by new less old; cleanup: rows for documents whose derived id
    was there and is another now.
    """
    values = ["sha256", "size_bytes", "chunk_count", "event_count", "derived_id"]
    new = staged.where("complete").select("document_id", *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_new"))
    rows = documents.join(new, "document_id", "left")
    known = F.col("_new").isNotNull()
    out = rows.select("document_id", "source_id", *[F.when(known, F.coalesce(f"_{c}", c) if c in ("sha256", "size_bytes") else F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values], known.alias("replaced"))
    change = lambda c: F.sum(F.coalesce(F.col(f"_{c}"), F.lit(0)) - F.coalesce(F.col(c), F.lit(0))).alias(f"_{c}")
    changed = rows.where(known).groupBy("source_id").agg(change("chunk_count"), change("event_count"))
    totals = sources.join(changed, "source_id", "left").select("source_id", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("chunk_count", "event_count")])
    cleanup = rows.where(known & F.col("derived_id").isNotNull() & ~F.col("derived_id").eqNullSafe(F.col("_derived_id")))
    return {"documents": out, "sources": totals, "cleanup": cleanup.select("document_id", "source_id", F.col("derived_id").alias("old_derived_id"), F.coalesce("_sha256", "sha256").alias("new_hash"))}


def revision_cleanup_guard(cleanup: DataFrame, documents: DataFrame) -> DataFrame:
    """run where the document is gone, or still carries the new hash and no longer points at the old derived id; else skip."""
    current = documents.select("document_id", F.col("sha256").alias("_h"), F.col("derived_id").alias("_d"), F.lit(True).alias("_known"))
    rows = cleanup.join(current, "document_id", "left")
    run = F.col("_known").isNull() | (F.col("_h").eqNullSafe(F.col("new_hash")) & ~F.col("_d").eqNullSafe(F.col("old_derived_id")))
    return rows.select("document_id", F.when(run, "run").otherwise("skip").alias("action"))


def chunk_document_rank(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """``events(event_id, document_id, chunk_id, rank)`` renumbered inside their document by the place of their chunk, rank and id, from 0.

    Events of a chunk that ``chunks(chunk_id, place)`` lacks come last. A null rank comes before all others of its chunk.
    """
    order = Window.partitionBy("document_id").orderBy(F.asc_nulls_last("place"), F.asc_nulls_first("rank"), "event_id")
    return events.join(chunks.select("chunk_id", "place"), "chunk_id", "left").withColumn("rank", F.row_number().over(order) - 1).drop("place")


def table_profile(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(table_name, status, n_rows): rows of each table by its status column, one row with null status where it has none."""
    parts = []
    for name, (df, status) in tables.items():
        rows = df.select((F.col(status) if status else F.lit(None)).cast("string").alias("status"))
        parts.append(rows.groupBy("status").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "status", "n_rows"))
    return reduce(DataFrame.unionByName, parts)


def vectorizable_chunks(chunks: DataFrame, include_parents: bool, parents: tuple[str, ...] = ("parent",)) -> DataFrame:
    """Chunks to embed: all, or those whose ``chunk_type`` is not one of ``parents``; rows without a type stay."""
    return chunks if include_parents else chunks.where(F.col("chunk_type").isNull() | ~F.col("chunk_type").isin(*parents))
