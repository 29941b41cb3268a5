"""Graph slices, timelines, expansion and overviews over events, entities and relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch
from .recall import LIVE, VISIBLE, top

CHUNK = 512  # events of an entity that one side of a block of pairs holds


def entity_heat(entities: DataFrame, relations: DataFrame, k: int, types: list[str] | None = None) -> DataFrame:
    """The k entities of a source with most relations, of ``types`` only if these are given."""
    if types is not None:
        entities = entities.where(F.col("type").isin(types))
        relations = relations.join(entities.select("entity_id"), "entity_id", "left_semi")
    heat = relations.groupBy("entity_id").agg(F.count("*").alias("heat"))
    hot = entities.join(heat, "entity_id", "left").withColumn("heat", F.coalesce("heat", F.lit(0)))
    return top(hot, ["source_config_id"], [F.desc("heat"), F.col("name"), F.col("entity_id")], k).select("source_config_id", "entity_id", "name", "heat", "rn")


def event_relation_counts(relations: DataFrame) -> DataFrame:
    return relations.where(LIVE).groupBy("event_id").agg(F.count("*").alias("n"))


def slice_associations(relations: DataFrame, per_event: int = 8) -> DataFrame:
    order = [F.desc_nulls_last("weight"), F.col("created_time"), F.col("entity_id"), F.col("id")]
    return top(relations, ["event_id"], order, per_event).select("event_id", "entity_id", "id", "rn")


def cover_edges(assoc: DataFrame) -> DataFrame:
    """Edges that are the first of their event or of their entity, in the order of ``pos``."""
    first_event = F.row_number().over(Window.partitionBy("event_id").orderBy("pos")) == 1
    first_entity = F.row_number().over(Window.partitionBy("entity_id").orderBy("pos")) == 1
    return assoc.withColumn("covers", first_event | first_entity)


def cover_edge_slice(assoc: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges of ``assoc(source_config_id, event_id, entity_id, pos)`` to selected entities: covering ones first, then the rest, by ``pos``.

    A source has at most min(3000, max(200, 2 events, 3 entities)) of them, events and entities counted over its eligible edges.
    """
    scratch = Scratch(assoc.sparkSession, "edges")
    # Saved, selected entities have a known size and are sent to the associations where they are few; edges are read twice, and associations are dear.
    chosen = scratch.save(selected.select("entity_id").distinct(), "selected")
    own = assoc.join(chosen, "entity_id", "left_semi").select("source_config_id", "event_id", "entity_id", "pos")
    own = cover_edges(scratch.save(own, "own"))
    sizes = own.groupBy("source_config_id").agg(F.least(F.lit(3000), F.greatest(F.lit(200), 2 * F.countDistinct("event_id"), 3 * F.countDistinct("entity_id"))).alias("most"))
    kept = top(own, ["source_config_id"], [F.desc("covers"), F.col("pos")], 3000).join(sizes, "source_config_id")
    return kept.where(F.col("rn") <= F.col("most")).select("source_config_id", "event_id", "entity_id", "pos", "covers", "rn")


def shared_entity_edges(relations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pairs of events that share entities, with the number shared.

    An entity of many events is cut into chunks, and each pair of chunks is a join key of its own, so no task holds more than two chunks of
    one entity. Its pairs are the result and grow with the square of its events; ``shared_entity_members`` has them in linear size.
    """
    pairs = relations.select("event_id", "entity_id").distinct()
    sizes = pairs.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1").select("entity_id", F.ceil(F.col("n") / chunk).cast("int").alias("m"))
    pairs = pairs.join(sizes, "entity_id").withColumn("c", F.pmod(F.xxhash64("event_id"), F.col("m")).cast("int"))
    blocks = pairs.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    keyed = blocks.select("entity_id", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"), "c", "event_id")
    other = keyed.select("entity_id", "p", "q", F.col("c").alias("d"), F.col("event_id").alias("other_id"))
    # Within a block of two chunks only pairs across them count; pairs of one chunk have a block of their own.
    met = keyed.join(other, ["entity_id", "p", "q"]).where("event_id < other_id AND (p = q OR c <> d)")
    return met.groupBy("event_id", "other_id").agg(F.count("*").alias("shared"))


def shared_entity_members(relations: DataFrame) -> DataFrame:
    """(entity_id, event_id, n): the hyperedges themselves, each entity of two events or more with its events and their number."""
    pairs = relations.select("event_id", "entity_id").distinct()
    sizes = pairs.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1")
    return pairs.join(sizes, "entity_id").select("entity_id", "event_id", "n")


def slice_events(events: DataFrame, relations: DataFrame, k: int) -> DataFrame:
    """Per source: events with relations first (rank, newest), then the others, one document after the other in turn."""
    seen = events.where(VISIBLE)
    linked = relations.select("event_id").distinct()
    order = [F.col("rank"), F.desc("created_time"), F.col("event_id")]
    first = seen.join(linked, "event_id", "left_semi").withColumn("grp", F.lit(0)).withColumn("turn", F.lit(0))
    rest = seen.join(linked, "event_id", "left_anti").withColumn("grp", F.lit(1))
    rest = rest.withColumn("turn", F.row_number().over(Window.partitionBy("source_config_id", "source_id").orderBy(*order)))
    both = first.unionByName(rest)
    return top(both, ["source_config_id"], [F.col("grp"), F.col("turn"), *order], k).select("source_config_id", "event_id", "grp", "rn")


def timeline(events: DataFrame, as_of: str, k: int) -> DataFrame:
    """First page of each source as of a moment: newest first, rank and id as ties, with the snapshot's total and ordinals."""
    seen = events.where(VISIBLE).where((F.col("event_time") <= F.lit(as_of).cast("timestamp")) & (F.col("created_time") <= F.lit(as_of).cast("timestamp")))
    total = seen.groupBy("source_config_id").agg(F.count("*").alias("total"))
    page = top(seen, ["source_config_id"], [F.desc("event_time"), F.col("rank"), F.col("event_id")], k, "ordinal")
    return page.join(total, "source_config_id").select("source_config_id", "event_id", "ordinal", "total", (F.col("total") > k).alias("has_more"))


def event_bundles(relations: DataFrame, as_of: str, k: int) -> DataFrame:
    """Per event the k heaviest entities (null weight counts 1), with the number of all and the importance of event and entity."""
    pairs = relations.where(F.col("created_time") <= F.lit(as_of).cast("timestamp")).groupBy("event_id", "entity_id").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.max("description").alias("description"))
    pairs = pairs.withColumn("total", F.count("*").over(Window.partitionBy("event_id")))
    kept = top(pairs, ["event_id"], [F.desc("weight"), F.col("entity_id")], k)
    importance = F.greatest(F.lit(0.4), F.least(F.lit(1.0), 0.5 + 0.08 * F.log(1.0 + F.col("total"))))
    return kept.select("event_id", "entity_id", "weight", "description", "total", F.round(importance, 6).alias("importance"), F.round(F.greatest(F.lit(0.3), F.least(F.lit(1.0), 0.42 + 0.08 * F.col("weight"))), 6).alias("entity_importance"), (F.col("total") <= k).alias("complete"), "rn")


def entity_event_counts(relations: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    moment = F.lit(as_of).cast("timestamp")
    seen = events.where(VISIBLE).where((F.col("event_time") <= moment) & (F.col("created_time") <= moment)).select("event_id")
    return relations.where(F.col("created_time") <= moment).join(seen, "event_id", "left_semi").groupBy("entity_id").agg(F.countDistinct("event_id").alias("n"))


def overview_stats(events: DataFrame, relations: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per source: visible events, first and last time, distinct event-entity pairs of visible events.

    A task sorts its relations and makes them distinct, and holds them twice; ``tasks`` deals out as many as there are, else Spark chooses.
    """
    seen = events.where(VISIBLE)
    shown = seen.select("event_id", "source_config_id")
    shown = shown.repartition(tasks, "event_id", "source_config_id") if tasks else shown  # relations follow
    stats = seen.groupBy("source_config_id").agg(F.count("*").alias("n_events"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))
    pairs = relations.join(shown, ["event_id", "source_config_id"], "left_semi").select("source_config_id", "event_id", "entity_id").distinct()
    pairs = pairs.groupBy("source_config_id").agg(F.count("*").alias("n_relations"), F.countDistinct("entity_id").alias("n_entities"))
    out = stats.join(pairs, "source_config_id", "left").na.fill(0, ["n_relations", "n_entities"])
    return out.withColumn("density", F.round(F.least(F.lit(1.0), F.log10(F.col("n_events") + 1.0) / 6), 6))


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """One entity per (source, type, normalized name): the smallest id, and the number of mentions."""
    return mentions.groupBy("source_config_id", "type", "normalized_name").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n"))


def delete_documents(events: DataFrame, relations: DataFrame, entities: DataFrame, doc_ids: DataFrame) -> dict[str, DataFrame]:
    """What a cascade removes: events of the documents, their relations, and entities left without a relation."""
    gone = events.join(doc_ids, "source_id", "left_semi").select("event_id")
    lost = relations.join(gone, "event_id", "left_semi")
    kept = relations.join(gone, "event_id", "left_anti").select("entity_id").distinct()
    orphans = entities.join(lost.select("entity_id").distinct(), "entity_id", "left_semi").join(kept, "entity_id", "left_anti")
    return {"events": gone, "relations": lost.select("id", "event_id", "entity_id"), "entities": orphans.select("entity_id")}


def delete_cascade(doc_ids: DataFrame, chunks: DataFrame, events: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(kind, id) of all that goes with ``doc_ids(source_id)``: chunks, events of the documents or of those chunks, relations, orphaned entities, and the vectors of all four.

    A vector has the id of what it stands for; its kind ends in _vector.
    """
    cut = chunks.join(doc_ids, "source_id", "left_semi").select("chunk_id")
    own = events.join(doc_ids, "source_id", "left_semi").select("event_id")
    gone = own.unionByName(events.join(cut, "chunk_id", "left_semi").select("event_id")).distinct()
    lost = relations.join(gone, "event_id", "left_semi")
    kept = relations.join(gone, "event_id", "left_anti").select("entity_id").distinct()
    orphans = entities.join(lost.select("entity_id").distinct(), "entity_id", "left_semi").join(kept, "entity_id", "left_anti")
    parts = {"chunk": cut.select(F.col("chunk_id").alias("id")), "event": gone.select(F.col("event_id").alias("id")), "relation": lost.select("id"), "entity": orphans.select(F.col("entity_id").alias("id")).distinct()}
    rows = reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(k)) for k, df in parts.items()])
    return rows.select(F.explode(F.array("kind", F.concat("kind", F.lit("_vector")))).alias("kind"), "id")


def source_hits(hits: DataFrame) -> DataFrame:
    return hits.groupBy("source_config_id").agg(F.countDistinct("event_id").alias("hits"), F.max("score").alias("score"), F.max("event_time").alias("latest"))
