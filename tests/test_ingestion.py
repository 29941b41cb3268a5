"""Ingestion in batches: runs that break off or pause, failures of single chunks, odd rows, tables and vectors that do not change when repeated."""

import os

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import ingestion
from loomgraph.operators.merge import merged

SCHEMA = "chunk_id string, source_config_id string, document_id string, place long, content string"
ROWS = [(f"d{i % 7}-{i}", f"s{i % 2}", f"d{i % 7}", i, f"Alice met BOB. {'Carol' if i % 3 else 'nobody'} number {i}\nthen Alice left") for i in range(60)] + [("plain", "s0", "d0", 99, "nothing of note")]


def chunks(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def tables(spark, path):
    made = ingestion.event_tables(ingestion.extracted(spark, path), ingestion.TYPES)
    return {k: sorted(map(str, df.select(*sorted(df.columns)).collect())) for k, df in made.items()}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    assert ingestion.extract_batches(chunks(spark), path) == {"chunks": 61, "processed": 61, "eventless": 1, "failed": 0, "events": 60, "paused": False}
    return tables(spark, path)


def test_a_paused_run_goes_on_where_it_stopped(spark, tmp_path, whole):
    path, asked = str(tmp_path), []

    def twice():
        asked.append(1)
        return len(asked) > 2

    told = ingestion.extract_batches(chunks(spark), path, per_task=1, pause=twice)
    assert told["paused"] and 0 < told["processed"] < 61 and len(os.listdir(f"{path}/raw")) >= 2
    assert not ingestion.extract_batches(chunks(spark), path, per_task=1)["paused"]
    assert tables(spark, path) == whole
    # Every chunk was extracted once, the first batches not again.
    assert ingestion.extracted(spark, path).groupBy("chunk_id").count().where("count > 1").count() == 0
    assert ingestion.extract_batches(chunks(spark), path)["events"] == 60 and tables(spark, path) == whole


def test_a_run_that_breaks_off_loses_only_its_open_batch(spark, tmp_path, whole, monkeypatch):
    path, real, n = str(tmp_path), ingestion._extract, []

    def broken(batch, fn):
        n.append(1)
        if len(n) < 3:
            return real(batch, fn)
        return real(batch, fn).withColumn("position", F.raise_error(F.lit("lost")).cast("int"))

    monkeypatch.setattr(ingestion, "_extract", broken)
    with pytest.raises(Exception, match="lost"):
        ingestion.extract_batches(chunks(spark), path, per_task=1)
    monkeypatch.undo()
    before = {r.chunk_id for r in ingestion.extracted(spark, path).collect()}
    assert 0 < len(before) < 61
    ingestion.extract_batches(chunks(spark), path, per_task=1)
    assert tables(spark, path) == whole and ingestion.extracted(spark, path).count() == 61


def test_failures_concern_their_chunk_and_are_tried_again(spark, tmp_path, whole):
    path = str(tmp_path)

    def fails(text):
        if "number 7\n" in text:
            raise ValueError("no answer")
        return ingestion.typed_words(text)

    told = ingestion.extract_batches(chunks(spark), path, fails)
    assert (told["processed"], told["failed"], told["paused"]) == (60, 1, False)
    assert [r.error for r in ingestion.extracted(spark, path).where("error IS NOT NULL").collect()] == ["ValueError: no answer"]
    told = ingestion.extract_batches(chunks(spark), path)
    assert (told["processed"], told["failed"]) == (61, 0) and tables(spark, path) == whole


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path)
    assert ingestion.extract_batches(chunks(spark, []), path) == {"chunks": 0, "processed": 0, "eventless": 0, "failed": 0, "events": 0, "paused": False}
    assert all(not t for t in tables(spark, path).values())
    rows = [(None, None, None, None, None), ("", "s", "d", 1, "Xa")] + [("hot", "s", "d", 2, "Ya")] * 500 + [("long", "s", "d", None, "Za " * 100_000)]
    told = ingestion.extract_batches(chunks(spark, rows).withColumn("position", F.lit("clash")), path)
    assert told["chunks"] == 3 and told["processed"] == 3
    made = ingestion.event_tables(ingestion.extracted(spark, path), ingestion.TYPES)
    assert {(r.chunk_id, r["rank"]) for r in made["events"].collect()} == {("hot", 0), ("long", 1)}
    assert {(r.normalized_name, r.type) for r in made["entities"].collect()} == {("ya", "word"), ("za", "word")}
    assert {r.weight for r in made["event_entity"].collect()} == {1.0, 100_000.0}


def test_entities_are_resolved_by_source_type_and_name(spark, tmp_path):
    path = str(tmp_path)

    def model(text):
        return [
            ("first", [({"person": "Ann  Lee", "name": "Ann  Lee"}, 0.5), ({"name": " ann lee", "type": "person", "description": "chair"}, None), ({"name": " "}, 1.0)]),
            ("second", [({"name": "ANN LEE", "type": "place"}, 2.0), ({"name": "untyped"}, 0.0)]),
        ]

    ingestion.extract_batches(chunks(spark, [("a", "s", "d", 0, "x"), ("b", "t", "d", 1, "x")]), path, model)
    made = ingestion.event_tables(ingestion.extracted(spark, path), ["person", "place"])
    found = {(r.source_config_id, r.type, r.normalized_name, r.description) for r in made["entities"].collect()}
    assert found == {(s, *e) for s in "st" for e in (("person", "ann lee", "chair"), ("place", "ann lee", None), ("unknown", "untyped", None))}
    assert [(r["title"], r["rank"]) for r in made["events"].orderBy("rank").collect()] == [("first", 0), ("second", 1), ("first", 2), ("second", 3)]
    weights = made["event_entity"].join(made["entities"].select("entity_id", "type"), "entity_id").where("source_config_id = 's'")
    assert {(r.type, r.weight) for r in weights.collect()} == {("person", 1.0), ("place", 2.0), ("unknown", 0.0)}


def test_ingestion_end_to_end_can_be_repeated(spark, tmp_path, whole):
    path = str(tmp_path)
    paused = ingestion.ingest(chunks(spark), path, per_task=1, buckets=4, pause=lambda: True)
    assert paused["paused"] and paused["vectors"] == 0 and merged(spark, f"{path}/events") is None
    told = ingestion.ingest(chunks(spark), path, buckets=4)
    assert told["vectors"] == 60 and not told["paused"]
    for name, want in whole.items():
        df = merged(spark, f"{path}/{name}")
        assert sorted(map(str, df.select(*sorted(df.columns)).collect())) == want
    assert ingestion.ingest(chunks(spark), path, buckets=4)["vectors"] == 0
    more = ROWS + [("late", "s1", "d9", 0, "Dora came")]
    assert ingestion.ingest(chunks(spark, more), path, buckets=4)["vectors"] == 1
    assert merged(spark, f"{path}/vectors").count() == merged(spark, f"{path}/events").count() == 61


def test_a_batch_lists_no_files_of_other_batches(spark, tmp_path, monkeypatch):
    real, seen = ingestion._extract, []

    def listed(batch, fn):
        seen.append(set(batch.inputFiles()))
        return real(batch, fn)

    monkeypatch.setattr(ingestion, "_extract", listed)
    assert ingestion.extract_batches(chunks(spark), str(tmp_path), per_task=1)["processed"] == 61
    assert len(seen) > 3 and all(seen) and sum(map(len, seen)) == len(set.union(*seen))
