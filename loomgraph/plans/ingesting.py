"""Registered queries of ingestion and of the overview after it: the three tables that extraction by the stand-in model makes of all chunks, a refresh, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingestion, overview
from ..storage import Scratch
from .registry import ORACLES, query

_FOUND = """WITH FIX, w AS (SELECT *, substring(content, 1, 60) AS title, md5(chunk_id || chr(31) || '0') AS event_id, [trim(x, '.,;:!?') for x in regexp_extract_all(content, '\\S+') if regexp_matches(x, '^\\p{Lu}')] AS names FROM ch),
m AS (SELECT event_id, source_config_id, trim(title) AS description, name, count(*)::DOUBLE AS weight, CASE WHEN upper(name) = name THEN 'initials' ELSE 'word' END AS type, lower(name) AS normalized_name FROM (SELECT *, unnest(names) AS name FROM w) GROUP BY ALL),
e AS (SELECT *, md5(source_config_id || chr(31) || type || chr(31) || normalized_name) AS entity_id FROM m)"""


def _tables(t):
    chunks = t.chunks().select("chunk_id", "source_config_id", F.col("doc_id").alias("document_id"), F.col("rank").alias("place"), "content")
    path = Scratch(t.spark, "ingested").root
    ingestion.extract_batches(chunks, path)
    return ingestion.event_tables(ingestion.extracted(t.spark, path), ingestion.TYPES)


@query(f"{_FOUND} SELECT event_id, source_config_id, CAST(doc_id AS VARCHAR) AS document_id, chunk_id, title, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS INT) AS rank, CAST(NULL AS VARCHAR) AS status FROM w WHERE len(names) > 0")
def extracted_events(t):
    return _tables(t)["events"]


@query(f"{_FOUND} SELECT entity_id, source_config_id, type, normalized_name, min(name) AS name, min_by(description, event_id) AS description FROM e GROUP BY ALL")
def extracted_entities(t):
    return _tables(t)["entities"]


@query(f"{_FOUND} SELECT event_id, entity_id, source_config_id, max(weight) AS weight, min(description) AS description, md5(event_id || chr(31) || entity_id) AS id FROM e GROUP BY ALL")
def extracted_relations(t):
    return _tables(t)["event_entity"]


@query(ORACLES["overview_stats"])
def overview_refresh(t):
    """An overview that lacks a third of the events of half the sources is brought up to date by marks of these."""
    changed, path = "source_config_id < 'n2'", f"{Scratch(t.spark, 'overview').root}/table"
    early = t.events().where(f"NOT ({changed}) OR CAST(event_id AS BIGINT) % 3 > 0")
    none = t.spark.createDataFrame([], "source_config_id string, revision long")
    overview.refresh_overview(t.sources(), early, t.relations(), path, none, tasks=t.tasks())
    overview.refresh_overview(t.sources(), t.events(), t.relations(), path, t.sources().where(changed).withColumn("revision", F.lit(1)), tasks=t.tasks())
    return overview.stored_overview(t.spark, path, t.sources())
