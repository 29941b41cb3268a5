"""Search along hyperedges: entities that a query's text names, their events, and events that share an entity with those, hop by hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch
from .recall import terms, top


def named_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id): entities of ``entities(entity_id, normalized_name)`` whose name's words stand in the text of ``queries(query_id, text)`` in a row.

    Null texts and names without a word name nothing.
    """
    return _said(queries, entities).join(entities.select("normalized_name", "entity_id").distinct(), "normalized_name").select("query_id", "entity_id").distinct()


def _said(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, normalized_name): the names in a query's text. A name meets only queries with its rarest word (among names), so that frequent words join nothing."""
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    names = entities.select("normalized_name").distinct().select("normalized_name", terms(F.col("normalized_name")).alias("words")).where("size(words) > 0")
    words = names.select("normalized_name", F.explode(F.array_distinct("words")).alias("word"))
    rarest = words.join(words.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("normalized_name").agg(F.min(F.struct("n", "word")).alias("r"))
    keyed = names.join(rarest, "normalized_name").select("normalized_name", spaced("words").alias("name"), F.col("r.word").alias("word"))
    asked = queries.select("query_id", terms(F.coalesce("text", F.lit(""))).alias("words")).select("query_id", spaced("words").alias("said"), F.explode(F.array_distinct("words")).alias("word"))
    return asked.join(keyed, "word").where(F.contains("said", F.col("name"))).select("query_id", "normalized_name").distinct()


def hyperedge_walk(queries: DataFrame, entities: DataFrame, relations: DataFrame, k: int, hops: int = 2) -> DataFrame:
    """(query_id, event_id, score, hop, rn): the k best events within ``hops`` shared entities of the events of the entities that a query names.

    An event of named entities scores the sum of their weights (a null weight is 1). Each hop goes on from the k best so far: an entity passes on half of its best
    event's score to all its events, and an event keeps its best score and the first hop that gave it. Of an entity's events only the k of smallest id can be
    among the k best by it, so hubs add k rows each. A hop's frontier is a saved table of at most k rows for each query.
    Queries that name the same names are walked once, as the one of smallest id.
    """
    scratch = Scratch(queries.sparkSession, "walk")
    links = scratch.save(relations.groupBy("event_id", "entity_id").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("w")), "links")
    names = scratch.save(entities.select("normalized_name", "entity_id").distinct(), "names")
    said = scratch.save(_said(queries, names), "said")
    asked = said.groupBy("query_id").agg(F.sort_array(F.collect_list("normalized_name")).alias("all"))
    asked = scratch.save(asked.withColumn("walk", F.min("query_id").over(Window.partitionBy("all"))).select("query_id", "walk"), "asked")
    said = said.join(asked.where("query_id = walk").select("query_id"), "query_id", "left_semi")
    named = scratch.save(names.join(said, "normalized_name").select("query_id", "entity_id").distinct(), "named")
    best = links.join(named, "entity_id").groupBy("query_id", "event_id").agg(F.round(F.sum("w"), 6).alias("score")).withColumn("hop", F.lit(0))
    order = [F.desc("score"), F.col("event_id")]
    front = scratch.save(top(best, ["query_id"], order, k), "hop0")
    for hop in range(1, hops + 1):
        led = front.join(links, "event_id").groupBy("query_id", "entity_id").agg(F.round(F.max("score") / 2, 6).alias("score"))
        led = scratch.save(led, f"led{hop}")
        first = top(links.join(led.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "event_id"), ["entity_id"], [F.col("event_id")], k).drop("rn")
        near = led.join(first, "entity_id").groupBy("query_id", "event_id").agg(F.max("score").alias("score")).withColumn("hop", F.lit(hop))
        both = front.drop("rn").unionByName(near).groupBy("query_id", "event_id").agg(F.max("score").alias("score"), F.min("hop").alias("hop"))
        front = scratch.save(top(both, ["query_id"], order, k), f"hop{hop}")
    return asked.join(front.withColumnRenamed("query_id", "walk"), "walk").select("query_id", *[c for c in front.columns if c != "query_id"])


def walked_chunks(found: DataFrame, events: DataFrame, k: int) -> DataFrame:
    """(query_id, source_config_id, chunk_id, score, n_events, rn): chunks behind the events of a walk, by their best event, then id."""
    behind = found.join(events.select("event_id", "source_config_id", "chunk_id"), "event_id").where("chunk_id IS NOT NULL")
    chunks = behind.groupBy("query_id", "source_config_id", "chunk_id").agg(F.max("score").alias("score"), F.count("*").alias("n_events"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source_config_id", "chunk_id"))
    return chunks.withColumn("rn", rank).where(F.col("rn") <= k)
