"""Pages with cursors in both directions, overview partitions, graphs of hits and of sources, filling of open batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch
from .recall import VISIBLE, numbered, top


def timeline_page(events: DataFrame, as_of: str, k: int, cursor: DataFrame | None = None, newer: bool = False) -> DataFrame:
    """A page of each source's timeline as of a moment, newest first (then rank, event_id), with ordinals and the snapshot's total.

    ``cursor(source_config_id, event_time, rank, event_id)`` is the last row of the page before (``newer``: the first row of the page after);
    sources without a cursor begin at the newest event (``newer``: have no page). ``has_more`` tells of rows further in the direction read.
    """
    moment = F.lit(as_of).cast("timestamp")
    seen = events.where(VISIBLE).where((F.col("event_time") <= moment) & (F.col("created_time") <= moment)).select("source_config_id", "event_time", "rank", "event_id")
    marked = seen.withColumns({"c_time": F.lit(None).cast("timestamp"), "c_rank": F.lit(None).cast("int"), "c_id": F.lit(None).cast("string")})
    if cursor is not None:
        names = cursor.select("source_config_id", F.col("event_time").alias("c_time"), F.col("rank").alias("c_rank"), F.col("event_id").alias("c_id"))
        marked = seen.join(names, "source_config_id", "left")
    t, r, i = F.col("event_time"), F.col("rank"), F.col("event_id")
    at, cr, ci = F.col("c_time"), F.col("c_rank"), F.col("c_id")
    after = (t < at) | ((t == at) & ((r > cr) | ((r == cr) & (i > ci))))
    ahead = ~after & ~((t == at) & (r == cr) & (i == ci))
    wanted = F.coalesce(ahead, F.lit(False)) if newer else ci.isNull() | after
    # Counts instead of numbering all rows: how many lie before the page, how many on its side, how many in all.
    counts = marked.groupBy("source_config_id").agg(F.count("*").alias("total"), F.sum(wanted.cast("int")).alias("side"))
    order = [F.desc("event_time"), F.col("rank"), F.col("event_id")]
    back = [F.col("event_time"), F.desc("rank"), F.desc("event_id")]
    page = top(marked.where(wanted), ["source_config_id"], back if newer else order, k).join(counts, "source_config_id")
    first = F.col("side") - F.col("rn") + 1 if newer else F.col("total") - F.col("side") + F.col("rn")
    return page.select("source_config_id", "event_time", "rank", "event_id", first.cast("long").alias("ordinal"), "total", (F.col("side") > k).alias("has_more"))


def entity_page(relations: DataFrame, events: DataFrame, as_of: str, k: int, cursor: DataFrame | None = None) -> DataFrame:
    """The next k visible events of each entity as of a moment: latest, heaviest, largest id first, after ``cursor(entity_id, event_time, weight, event_id)``."""
    moment = F.lit(as_of).cast("timestamp")
    seen = events.where(VISIBLE).where((F.col("event_time") <= moment) & (F.col("created_time") <= moment)).select("event_id", "event_time")
    pairs = relations.where(F.col("created_time") <= moment).groupBy("event_id", "entity_id").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    rows = pairs.join(seen, "event_id")
    if cursor is not None:
        c = cursor.select("entity_id", F.col("event_time").alias("t"), F.col("weight").alias("w"), F.col("event_id").alias("i"))
        later = "event_time < t OR (event_time = t AND (weight < w OR (weight = w AND event_id < i)))"
        rows = rows.join(c, "entity_id", "left").where(f"i IS NULL OR {later}").drop("t", "w", "i")
    page = top(rows, ["entity_id"], [F.desc("event_time"), F.desc("weight"), F.desc("event_id")], k + 1)
    page = page.withColumn("has_more", F.max("rn").over(Window.partitionBy("entity_id")) > k)
    return page.where(F.col("rn") <= k).select("entity_id", "event_id", "event_time", "weight", "rn", "has_more")


def messages_before(messages: DataFrame, k: int, cursor: DataFrame) -> DataFrame:
    """The k messages of each conversation before ``cursor(conv_id, before)``, newest first in ``rn``; without a cursor the newest."""
    rows = messages.join(cursor, "conv_id", "left").where("before IS NULL OR turn < before")
    page = top(rows, ["conv_id"], [F.desc("turn")], k + 1).withColumn("has_more", F.max("rn").over(Window.partitionBy("conv_id")) > k)
    return page.where(F.col("rn") <= k).select("conv_id", "turn", "rn", "has_more")


def time_buckets(events: DataFrame, buckets: int = 8) -> DataFrame:
    """(source_config_id, bucket, start, end, n): equal spans of each source's visible events, the last one closed; one if all are at one time."""
    seen = events.where(VISIBLE).select("source_config_id", F.expr("unix_micros(CAST(event_time AS TIMESTAMP))").alias("t"))
    ends = seen.groupBy("source_config_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    m = F.when(F.col("hi") > F.col("lo"), F.lit(buckets)).otherwise(1)
    ends = ends.withColumn("m", m).withColumn("edges", F.transform(F.sequence(F.lit(0), F.col("m")), lambda i: F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * i / F.col("m"))))
    rows = seen.join(ends, "source_config_id").withColumn("bucket", F.least(F.size(F.filter("edges", lambda e: e <= F.col("t"))), F.col("m")) - 1)
    rows = rows.groupBy("source_config_id", "bucket", "edges").agg(F.count("*").alias("n"))
    edge = lambda k: F.timestamp_micros(F.element_at("edges", F.col("bucket") + k).cast("long")).cast("timestamp_ntz")
    return rows.select("source_config_id", "bucket", edge(1).alias("start"), edge(2).alias("end"), "n")


def top_categories(events: DataFrame, k: int) -> DataFrame:
    """The k most frequent categories of each source's visible events; blank ones are "uncategorised", ties by label."""
    label = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("uncategorised"))
    n = events.where(VISIBLE).groupBy("source_config_id", label.alias("category")).agg(F.count("*").alias("n"))
    return top(n, ["source_config_id"], [F.desc("n"), F.col("category")], k)


def overview_partitions(stats: DataFrame, previous: DataFrame) -> DataFrame:
    """Geometry of ``stats(source_config_id, n_events)``: density, radius, a place on a golden-angle spiral unless ``previous(source_config_id, x, y)`` has one."""
    n = F.col("n_events") + 1.0
    # One row per source: the order over all of them is a small sort.
    rows = stats.withColumn("i", F.row_number().over(Window.orderBy(F.desc("n_events"), "source_config_id")) - 1)
    angle, far = F.col("i") * 2.399963229728653, 120 * F.sqrt(F.col("i").cast("double"))
    rows = rows.join(previous.select("source_config_id", F.col("x").alias("px"), F.col("y").alias("py")), "source_config_id", "left")
    z = F.conv(F.substring(F.sha2("source_config_id", 256), 1, 4), 16, 10).cast("double") / 65535 * 40 - 20
    return rows.select(
        "source_config_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(n) / 6)), 6).alias("density"),
        F.round(F.least(F.lit(120.0), F.greatest(F.lit(24.0), 24 + 18 * F.log10(n))), 6).alias("radius"),
        F.round(F.coalesce("px", far * F.cos(angle)), 4).alias("x"), F.round(F.coalesce("py", far * F.sin(angle)), 4).alias("y"), F.round(z, 4).alias("z"), F.col("n_events").alias("importance"),
    )


def overview_stale(overview: DataFrame, counts: DataFrame, dirty: DataFrame) -> DataFrame:
    """Per source of ``counts(source_id, n)``: stale if it is marked dirty, is missing in ``overview(source_id, n)``, or counts differ."""
    rows = counts.join(overview.withColumnRenamed("n", "shown"), "source_id", "left").join(dirty.select("source_id").distinct().withColumn("marked", F.lit(True)), "source_id", "left")
    return rows.select("source_id", (F.coalesce("marked", F.lit(False)) | F.col("shown").isNull() | (F.col("shown") != F.col("n"))).alias("stale"))


def manifest(partitions: DataFrame, counts: DataFrame, limit: int = 256) -> DataFrame:
    """The ``limit`` most important sources; one without a partition gets a placeholder from its count."""
    rows = counts.join(partitions, "source_config_id", "left")
    rows = rows.select("source_config_id", F.coalesce("importance", "n").alias("importance"), F.coalesce("radius", F.lit(24.0)).alias("radius"), F.col("radius").isNull().alias("placeholder"))
    return rows.orderBy(F.desc("importance"), "source_config_id").limit(limit)


def graph_for_sections(sections: DataFrame, direct: DataFrame, events: DataFrame, limit: int) -> DataFrame:
    """Events behind hits of each query: direct ones by score first, then one event of each chunk in turn, best chunks first.

    ``sections(query_id, source_config_id, chunk_id, score)``, ``direct(query_id, event_id, score)``. Per chunk the first
    min(8, ceil(candidates / chunks)) visible events by rank and id take part, and all direct ones; of these the first candidates by place in their chunk,
    rank and id, candidates being min(200, max(4 limit, 2 direct, 8 chunks + direct)). Of equal titles (whatever the case and blanks) in a source the first stays.
    """
    seen = events.where(VISIBLE).select("event_id", "source_config_id", "chunk_id", "title", "rank")
    hits = sections.groupBy("query_id", "source_config_id", "chunk_id").agg(F.max("score").alias("chunk_score"))
    size = hits.groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    n_direct = direct.groupBy("query_id").agg(F.countDistinct("event_id").alias("n_direct"))
    rows = hits.join(seen, ["source_config_id", "chunk_id"]).select("query_id", "event_id", "source_config_id", "chunk_id", "title", "rank", "chunk_score")
    named = direct.groupBy("query_id", "event_id").agg(F.max("score").alias("direct_score"))
    extra = named.join(seen, "event_id").join(rows.select("query_id", "event_id"), ["query_id", "event_id"], "left_anti")
    rows = rows.join(named, ["query_id", "event_id"], "left").unionByName(extra.withColumn("chunk_score", F.lit(0.0)))
    rows = rows.join(size, "query_id", "left").join(n_direct, "query_id", "left").na.fill(0, ["n_chunks", "n_direct"])
    wide = F.least(F.lit(200), F.greatest(F.lit(4 * limit), 2 * F.col("n_direct"), 8 * F.col("n_chunks") + F.col("n_direct")))
    depth = F.row_number().over(Window.partitionBy("query_id", "source_config_id", "chunk_id").orderBy("rank", "event_id"))
    rows = rows.withColumn("depth", depth).withColumn("straight", F.col("direct_score").isNotNull())
    rows = rows.where(F.col("straight") | (F.col("depth") <= F.least(F.lit(8), F.ceil(wide / F.greatest("n_chunks", F.lit(1))))))
    level = F.coalesce("rank", F.lit(0))
    rows = rows.withColumn("wide", wide).withColumn("cut", F.row_number().over(Window.partitionBy("query_id").orderBy("depth", level, "event_id"))).where("cut <= wide")
    score, dealt = F.coalesce("direct_score", "chunk_score"), ~F.col("straight")
    order = [F.desc("straight"), F.when(~dealt, -score), F.when(~dealt, level), *[F.when(dealt, c) for c in (F.col("depth"), -F.col("chunk_score"), F.col("source_config_id"), F.col("chunk_id"))], F.col("event_id")]
    title = F.coalesce(F.nullif(F.regexp_replace(F.lower("title"), r"\s+", ""), F.lit("")), F.col("event_id"))
    rows = rows.withColumn("title_key", title).withColumn("score", score)
    first = F.row_number().over(Window.partitionBy("query_id", "source_config_id", "title_key").orderBy(*order))
    rows = rows.withColumn("first", first).where("first = 1")
    return top(rows, ["query_id"], order, limit).select("query_id", "event_id", F.round("score", 6).alias("score"), F.col("straight").alias("direct"), "rn")


def section_graph(found: DataFrame, relations: DataFrame, entities: DataFrame, n_entities: int, edge_limit: int) -> dict[str, DataFrame]:
    """Relations of the events of each query (heaviest, oldest first, limited), its hottest entities, and the edges to those.

    The limit of a query is min(edge_limit, max(4 events, 3 n_entities)).
    """
    scratch = Scratch(found.sparkSession, "section_graph")
    # The few rows that a search finds are saved, and so are their limited relations: of a known size, they are sent to the tables, which stay in place.
    found = scratch.save(found.select("query_id", "event_id"), "found")
    n = found.groupBy("query_id").agg(F.count("*").alias("n_events"))
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))  # null and 0 count as 1 here
    rows = found.select("query_id", "event_id").join(relations.select("id", "event_id", "entity_id", weight.alias("weight"), "created_time"), "event_id").join(n, "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "created_time", "id")
    rows = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= F.least(F.lit(edge_limit), F.greatest(4 * F.col("n_events"), F.lit(3 * n_entities))))
    rows = scratch.save(rows, "rows")
    heat = rows.groupBy("query_id", "entity_id").agg(F.count("*").alias("heat")).join(entities.select("entity_id", "name"), "entity_id")
    hot = top(heat, ["query_id"], [F.desc("heat"), F.col("name"), F.col("entity_id")], n_entities)
    edges = rows.join(hot.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_semi").select("query_id", "event_id", "entity_id", "weight", "id")
    return {"entities": hot, "edges": edges}


def source_graph(documents: DataFrame, events: DataFrame, associations: DataFrame) -> DataFrame:
    """Edges (source_config_id, from_id, to_id, kind) of picked documents, sliced events and their associations, each once.

    contains: document to event, subevent: event to the event it is part of, mentions: event to entity.
    """
    own = events.select("source_config_id", "event_id", "source_id", "parent_id")
    kept = own.join(documents.select(F.col("document_id").alias("source_id")), "source_id", "left_semi")
    contains = kept.select("source_config_id", F.col("source_id").alias("from_id"), F.col("event_id").alias("to_id"), F.lit("contains").alias("kind"))
    inside = own.where("parent_id IS NOT NULL").join(own.select("source_config_id", F.col("event_id").alias("parent_id")), ["source_config_id", "parent_id"], "left_semi")
    inside = inside.select("source_config_id", F.col("parent_id").alias("from_id"), F.col("event_id").alias("to_id"), F.lit("subevent").alias("kind"))
    mentions = associations.join(own.select("event_id", "source_config_id"), "event_id").select("source_config_id", F.col("event_id").alias("from_id"), F.col("entity_id").alias("to_id"), F.lit("mentions").alias("kind"))
    return contains.unionByName(inside).unionByName(mentions).distinct()


def source_graph_counts(documents: DataFrame, picked: DataFrame, events: DataFrame, graph: DataFrame) -> DataFrame:
    """Per source with ``documents(source_id, event_count)``: documents and events of the whole, those of ``picked`` and ``events`` shown, entities and edges of each kind, truncated.

    truncated: not all documents or not all their events are shown.
    """
    whole = documents.groupBy(F.col("source_id").alias("source_config_id")).agg(F.count("*").alias("documents"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"))
    docs = picked.groupBy(F.col("source_id").alias("source_config_id")).agg(F.count("*").alias("shown_documents"))
    shown = events.groupBy("source_config_id").agg(F.countDistinct("event_id").alias("shown_events"))
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(kind)
    edges = graph.groupBy("source_config_id").agg(F.countDistinct(F.when(F.col("kind") == "mentions", F.col("to_id"))).alias("shown_entities"), n("contains"), n("subevent"), n("mentions"))
    rows = reduce(lambda a, b: a.join(b, "source_config_id", "left"), [docs, shown, edges], whole).na.fill(0)
    return rows.withColumn("truncated", (F.col("shown_documents") < F.col("documents")) | (F.col("shown_events") < F.col("events")))


def fill_tail(items: DataFrame, tails: DataFrame, size: int) -> DataFrame:
    """(source, id, batch): items go to open batches of their source while these have room, newest first, the rest to new ones.

    ``items(source, id)``, ``tails(source, batch, used, opened)``; new batches are numbered -1, -2, ... for each source. Items are placed by
    intervals of capacity, one after the other in order of id.
    """
    room = tails.where(F.col("used") < size).withColumn("room", size - F.col("used"))
    newest = Window.partitionBy("source").orderBy(F.desc("opened"), F.desc("batch"))
    room = room.withColumn("hi", F.sum("room").over(newest)).withColumn("lo", F.col("hi") - F.col("room")).select("source", "batch", "lo", "hi")
    placed = numbered(items.select("source", "id").distinct(), "source", "id").withColumnRenamed("place", "at")
    most = room.groupBy("source").agg(F.max("hi").alias("most"))
    rows = placed.join(most, "source", "left").na.fill(0, ["most"])
    fits = rows.where(F.col("at") < F.col("most")).join(room, "source").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("source", "id", "batch")
    new = rows.where(F.col("at") >= F.col("most")).select("source", "id", (-1 - F.floor((F.col("at") - F.col("most")) / size)).cast("long").alias("batch"))
    return fits.unionByName(new)


def sample_queries(vectors: DataFrame, n: int) -> DataFrame:
    """About n to 2n vectors of ``vectors(id, v)``: every step-th in order of id, whatever the ids are; null vectors are passed over."""
    known = vectors.where("v IS NOT NULL").withColumn("_all", F.lit(0))
    total = known.count()
    placed = numbered(known.select("_all", "id"), "_all", "id", max(64, total >> 20))
    chosen = placed.where(F.col("place") % max(1, total // (2 * n)) == 0).select("id")
    return known.join(chosen, "id").select("id", "v")
