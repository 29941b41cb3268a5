"""Expansion by keyset pages, snapshots, dirty marks and point reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .recall import VISIBLE, top


def expand_event(relations: DataFrame, weight: float, entity_id: str, k: int) -> DataFrame:
    """The k entities of each event after the cursor (weight, entity_id), heaviest first; total counts all of them."""
    pairs = relations.groupBy("event_id", "entity_id").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    pairs = pairs.withColumn("total", F.count("*").over(Window.partitionBy("event_id")))
    after = pairs.where((F.col("weight") < weight) | ((F.col("weight") == weight) & (F.col("entity_id") > entity_id)))
    return top(after, ["event_id"], [F.desc("weight"), F.col("entity_id")], k)


def expand_events(relations: DataFrame, cursors: DataFrame, k: int, as_of: str | None = None) -> DataFrame:
    """The k entities of each event of ``cursors(event_id, weight, entity_id)`` after its own cursor, heaviest first; a null weight begins at the first.

    total counts all entities of an event. With ``as_of`` only relations created until then take part. Events without a cursor are not read further.
    """
    known = relations if as_of is None else relations.where(F.col("created_time") <= F.lit(as_of).cast("timestamp"))
    pages = cursors.select("event_id", F.col("weight").alias("_w"), F.col("entity_id").alias("_e"))
    pairs = known.join(pages.select("event_id"), "event_id", "left_semi").groupBy("event_id", "entity_id").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    pairs = pairs.withColumn("total", F.count("*").over(Window.partitionBy("event_id"))).join(pages, "event_id")
    after = pairs.where(F.col("_w").isNull() | (F.col("weight") < F.col("_w")) | ((F.col("weight") == F.col("_w")) & (F.col("entity_id") > F.col("_e"))))
    return top(after.drop("_w", "_e"), ["event_id"], [F.desc("weight"), F.col("entity_id")], k)


def expand_entity(relations: DataFrame, events: DataFrame, after: str, before: str, k: int) -> DataFrame:
    """The k latest visible events of each entity within [after, before)."""
    seen = events.where(VISIBLE).where((F.col("event_time") >= F.lit(after).cast("timestamp")) & (F.col("event_time") < F.lit(before).cast("timestamp")))
    pairs = relations.groupBy("event_id", "entity_id").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    rows = pairs.join(seen.select("event_id", "event_time"), "event_id")
    return top(rows, ["entity_id"], [F.desc("event_time"), F.desc("weight"), F.desc("event_id")], k)


def graph_revision(events: DataFrame, relations: DataFrame) -> DataFrame:
    """A hash per source that changes with its counts and latest times."""
    e = events.groupBy("source_config_id").agg(F.count("*").alias("n"), F.unix_timestamp(F.max("created_time")).alias("t"))
    r = relations.groupBy("source_config_id").agg(F.count("*").alias("m"), F.unix_timestamp(F.max("created_time")).alias("u"))
    text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in "ntmu"])
    return e.join(r, "source_config_id", "left").select("source_config_id", F.sha2(text, 256).alias("revision"))


def mark_dirty(marks: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed sources get the next revision and their latest reason; the other marks stay."""
    latest = changes.groupBy("source_id").agg(F.max_by("reason", "at").alias("new"))
    changed = F.col("new").isNotNull().cast("int")
    return marks.join(latest, "source_id", "full").select("source_id", (F.coalesce("revision", F.lit(0)) + changed).cast("long").alias("revision"), F.coalesce("new", "reason").alias("reason"))


def clear_marks(marks: DataFrame, built: DataFrame) -> DataFrame:
    """Marks that stay after a build from ``built(source_id, revision)``: those it did not see, or that have another revision by now."""
    return marks.join(built, ["source_id", "revision"], "left_anti")


def overview_incremental(previous: DataFrame | None, fresh: DataFrame, dirty: DataFrame, key: str) -> DataFrame:
    """Rows of dirty keys from ``fresh``, the others from ``previous``; all from ``fresh`` without a previous overview or a dirty key.

    Pass ``fresh`` lazily, only dirty keys are read through.
    """
    if previous is None or dirty.isEmpty():
        return fresh
    return previous.join(dirty, key, "left_anti").unionByName(fresh.join(dirty, key, "left_semi"))


def keep_latest_snapshots(snapshots: DataFrame, keep: int) -> DataFrame:
    """Active snapshots and the ``keep`` latest of the others."""
    older = top(snapshots.where("NOT active"), ["source"], [F.desc("created"), F.desc("id")], keep).drop("rn")
    return snapshots.where("active").unionByName(older)


def repair_hidden_events(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of which all expected events exist but some are hidden, with the number that becomes visible again."""
    n = events.groupBy("source_id").agg(F.count("*").alias("total"), F.sum(F.expr(VISIBLE).cast("int")).alias("visible"))
    known = n.join(documents.select(F.col("document_id").alias("source_id"), "event_count"), "source_id")
    return known.where("visible < event_count AND total = event_count").select("source_id", (F.col("total") - F.col("visible")).alias("restored"))


def restored_events(events: DataFrame, documents: DataFrame) -> DataFrame:
    """All events; the hidden ones of documents that ``repair_hidden_events`` finds are COMPLETED again."""
    found = repair_hidden_events(events, documents).select("source_id", F.lit(True).alias("_back"))
    return events.join(found, "source_id", "left").withColumn("status", F.when(F.col("_back") & ~F.expr(VISIBLE), "COMPLETED").otherwise(F.col("status"))).drop("_back")


def event_vector_rows(events: DataFrame, relations: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Visible events as documents of the vector table: texts, times, category, tags and keywords as far as the events have them, ids of their entities.

    ``vectors(event_id, title_vector, content_vector)`` are joined where given; an event without them keeps nulls.
    """
    extra = [c for c in ("source_config_id", "source_id", "summary", "content", "category", "tags", "keywords", "start_time", "created_time") if c in events.columns]
    ids = relations.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("entity_ids"))
    rows = events.where(VISIBLE).join(ids, "event_id", "left").select("event_id", F.coalesce("title", F.lit("")).alias("title"), *extra, F.coalesce("entity_ids", F.lit("")).alias("entity_ids"))
    return rows if vectors is None else rows.join(vectors, "event_id", "left")


def read_lines(docs: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of numbered lines (from 1) of every document, and its number of lines; null text has none."""
    rows = docs.where("text IS NOT NULL").withColumn("l", F.split("text", "\n"))
    return rows.select("doc_id", F.size("l").alias("total"), F.posexplode(F.slice("l", offset + 1, limit)).alias("pos", "line")).select("doc_id", (F.col("pos") + offset + 1).alias("line_no"), "line", "total")


def messages_page(messages: DataFrame, limit: int) -> DataFrame:
    """The newest messages of every conversation; has_more tells whether there are older ones. Sort by turn to show them."""
    page = top(messages, ["conv_id"], [F.desc("turn")], limit + 1)
    page = page.withColumn("has_more", F.max("rn").over(Window.partitionBy("conv_id")) > limit)
    return page.where(F.col("rn") <= limit).select("conv_id", "turn", "rn", "has_more")


def node_detail(ids: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    """Title and document of each event id; unknown ids keep nulls."""
    found = ids.join(events.select("event_id", "title", "source_id"), "event_id", "left")
    return found.join(documents.select(F.col("document_id").alias("source_id"), "filename"), "source_id", "left").select("event_id", "title", "filename")


def node_details(ids: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """Label, description, category, document and chunk of each of ``ids(kind, id)``, kinds event and entity; unknown and hidden nodes drop out.

    The description of an event is its content, else its summary; of all, 4,000 characters.
    """
    text = lambda c, df: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
    shared = lambda kind, key, label, about, category, more: [F.lit(kind).alias("kind"), F.col(key).alias("id"), label.alias("label"), F.substring(about, 1, 4000).alias("description"), category.alias("category"), *more]
    none = F.lit(None).cast("string")
    e = events.where(VISIBLE).select(*shared("event", "event_id", F.col("title"), F.coalesce(F.nullif(text("content", events), F.lit("")), text("summary", events)), F.coalesce("category", F.lit("")), [F.col("source_id"), F.col("chunk_id")]))
    n = entities.select(*shared("entity", "entity_id", F.col("name"), text("description", entities), F.col("type"), [none.alias("source_id"), none.alias("chunk_id")]))
    wanted = ids.select("kind", "id").distinct()
    return e.join(wanted, ["kind", "id"], "left_semi").unionByName(n.join(wanted, ["kind", "id"], "left_semi"))


def save_exploration(sessions: DataFrame, steps: DataFrame, path: str) -> None:
    """Appends ``sessions(session_id, owner, title, updated_at)`` and ``steps(session_id, ...)`` to the tables below ``path``; a title has 80 characters."""
    sessions.withColumn("title", F.substring(F.trim("title"), 1, 80)).write.mode("append").parquet(f"{path}/sessions")
    steps.write.mode("append").parquet(f"{path}/steps")


def exploration_list(sessions: DataFrame, steps: DataFrame, limit: int = 20) -> DataFrame:
    """The latest of each owner's ``sessions(session_id, owner, updated_at)`` with their number of steps."""
    latest = top(sessions, ["owner"], [F.desc("updated_at"), F.col("session_id")], max(1, min(limit, 100)))
    counts = steps.groupBy("session_id").agg(F.count("*").alias("steps"))
    return latest.join(counts, "session_id", "left").select("owner", "session_id", F.coalesce("steps", F.lit(0)).alias("steps"), "rn")


def section_relations(scored: DataFrame, relations: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """Relations of the events of ``scored(query_id, event_id)`` with the query's k hottest entities (most rows, then name and id)."""
    asked = scored.select("query_id", "event_id").distinct()
    pairs = relations.select("event_id", "entity_id").join(asked, "event_id")
    # A relation counts once for each name of its entity. Ids and events take no part in the choice, they are joined to what was chosen.
    names = entities.select("entity_id", "name").where("entity_id IS NOT NULL").repartition("entity_id").distinct().withColumn("names", F.count("*").over(Window.partitionBy("entity_id")))
    heat = pairs.groupBy("query_id", "entity_id").agg(F.count("*").alias("heat")).join(names, "entity_id")
    hot = top(heat, ["query_id"], [F.desc("heat"), F.col("name"), F.col("entity_id")], k).select("query_id", "entity_id", "heat", "names")
    chosen = pairs.distinct().join(hot, ["query_id", "entity_id"]).withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("names").cast("int")))).drop("_each", "names")
    return relations.select("event_id", "entity_id", "id").join(chosen, ["event_id", "entity_id"]).select("query_id", "entity_id", "event_id", "id", "heat")


def cover_entities(assoc: DataFrame, budget: int) -> DataFrame:
    """Entities of each source chosen to cover its events: again and again the one with most events not yet covered.

    Ties go by heat (number of events), name and id; when all are covered the rest of the budget goes by the same order. ``assoc``
    (source_config_id, event_id, entity_id, name) is a slice of a bounded number of events and of entities per event.
    """

    def choose(rows):
        import pandas as pd

        from heapq import heapify, heappop, heapreplace

        events = rows.groupby("entity_id")["event_id"].agg(set).to_dict()
        names = rows.groupby("entity_id")["name"].min().to_dict()
        order = sorted(events, key=lambda e: (-len(events[e]), names[e], e))
        left, chosen = set().union(*events.values()), []
        # Gains only fall, so the first of the heap whose gain is still right is the best, and of equals the first in order.
        heap = [(-len(events[e]), k, e) for k, e in enumerate(order)]
        heapify(heap)
        while left and heap and len(chosen) < budget:
            gain, k, best = heap[0]
            now = len(events[best] & left)
            if now != -gain:
                heapreplace(heap, (-now, k, best))
                continue
            heappop(heap)
            chosen.append(best)
            left -= events[best]
        taken = set(chosen)
        chosen += [e for e in order if e not in taken][: budget - len(chosen)]
        return pd.DataFrame({"source_config_id": rows["source_config_id"].iloc[0], "entity_id": chosen, "pos": range(len(chosen))})

    return assoc.select("source_config_id", "event_id", "entity_id", "name").groupBy("source_config_id").applyInPandas(choose, "source_config_id string, entity_id string, pos int")


def get_chunks(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks by (source, id), with ``raw_content``, if there is one, where content is null or empty; unknown ids drop out."""
    if "raw_content" in chunks.columns:
        chunks = chunks.withColumn("content", F.coalesce(F.nullif("content", F.lit("")), "raw_content", "content"))
    return chunks.join(ids.distinct(), ["source_config_id", "chunk_id"], "left_semi")
