"""The stored index: sources, folders read, skipped blocks, hot terms; hyperedge walks over hubs; failures of one query's rerank."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import explore, hyperedges, search, stored
from loomgraph.operators.recall import bm25

CHUNKS = "source_config_id string, chunk_id string, rank int, content string"


@pytest.fixture(scope="module")
def chunks(spark):
    r = np.random.default_rng(0)
    words = [f"w{k}" for k in range(300)]
    p = 1 / np.arange(1, 301)
    rows = [(f"s{i % 5}", f"c{i}", i, " ".join(r.choice(words, int(r.integers(3, 30)), p=p / p.sum())) + (" hot" if i % 3 == 0 else "")) for i in range(3000)]
    rows += [(None, "n1", 1, "w1 alone hot"), ("s1", "e1", 1, None), ("s1", "e2", 2, "")]
    return spark.createDataFrame(rows, CHUNKS).cache()


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(stored, "SLICE", 256)
        m.setattr(stored, "BLOCK", 32)
        stored.write_postings(chunks, path, "2024-01-01 00:00:00")
    return stored.Postings(spark, path)


def rows(df):
    return {(r.query_id, r.rn): (r.chunk_id, round(r.score, 6)) for r in df.collect()}


def test_search_equals_a_search_of_the_sources_alone(spark, chunks, index):
    queries = spark.createDataFrame([(1, "w5 w40 hot"), (2, "w1 w2 w3 w250"), (3, None), (4, "missing words"), (5, "hot alone")], "query_id long, text string")
    assert rows(index.search(queries, 10)) == rows(bm25(queries.where("text IS NOT NULL"), chunks, 10))
    wanted = {1: ["s1"], 2: ["s0", "s3"], 5: ["s0", "s1", "s2", "s3", "s4", None], 4: ["s1"]}
    scope = spark.createDataFrame([(q, s) for q, ss in wanted.items() for s in ss] + [(1, "s1"), (1, "unknown")], "query_id long, source_config_id string")
    got = rows(index.search(queries, 10, scope))
    for q, ss in wanted.items():
        own = chunks.where(F.coalesce("source_config_id", F.lit("")).isin([s or "" for s in ss]))
        want = rows(bm25(queries.where(F.col("query_id") == q), own, 10))
        assert {k: v for k, v in got.items() if k[0] == q} == want
    assert not [k for k in got if k[0] == 3]
    plan = index.of("blocks", ["s1"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*folder.*of-s1", plan)
    assert all("folder=of-s1" in f for f in index.of("blocks", ["s1"]).select(F.input_file_name().alias("f")).distinct().toPandas().f)


def test_blocks_are_skipped_and_hot_terms_are_cut(spark, chunks, index):
    queries = spark.createDataFrame([(k, f"w{200 + k} w{250 + k} hot w1") for k in range(10)], "query_id long, text string")
    found, told = index._search(queries, 5, None)
    counts = {r.open: r["count"] for r in told.groupBy("open").count().collect()}
    assert counts[False] > 0.2 * counts[True] and rows(found) == rows(bm25(queries, chunks, 5))
    hot = index.of("blocks", None).where("term = 'hot'")
    assert hot.agg(F.max("n")).first()[0] <= 32 and hot.where("source_config_id = 's0'").count() > 6


def test_stale_index(spark, index):
    counts = index.stats.select("source_config_id", "rows")
    assert not index.stale(counts, "2024-01-01 00:10:00") and index.stale(counts, "2024-01-01 01:00:00")
    assert index.stale(counts.withColumn("rows", (F.col("rows") * 1.2).cast("long")), "2024-01-01 00:10:00")
    assert index.stale(counts.unionByName(spark.createDataFrame([("new", 1)], "source_config_id string, rows long")), "2024-01-01 00:10:00")


def test_literal_search_within_sources(spark, chunks, index, monkeypatch):
    more = chunks.unionByName(spark.createDataFrame([("s1", "x1", 1, "看到 龙卷风 了"), ("s2", "x2", 1, "龙卷风 龙卷风")], CHUNKS))
    queries = spark.createDataFrame([(1, "龙卷风"), (2, "龙卷风")], "query_id long, text string")
    scope = spark.createDataFrame([(1, "s1"), (2, "s1"), (2, "s2")], "query_id long, source_config_id string")
    want = [(1, 1, "x1"), (2, 1, "x2"), (2, 2, "x1")]
    assert sorted((r.query_id, r.rn, r.chunk_id) for r in search.lexical_channel(queries, index, more, 5, scope).collect()) == want
    monkeypatch.setattr(search, "LITERALS", 0)  # beyond the limit texts and terms meet by pairs of characters
    assert sorted((r.query_id, r.rn, r.chunk_id) for r in search.lexical_channel(queries, index, more, 5, scope).collect()) == want


def test_empty_index(spark, chunks, tmp_path):
    stored.write_postings(chunks.limit(0), str(tmp_path), "2024-01-01")
    queries = spark.createDataFrame([(1, "w1")], "query_id long, text string")
    assert stored.Postings(spark, str(tmp_path)).search(queries, 3).count() == 0


def test_a_failing_query_does_not_undo_the_rerank_of_others(spark):
    sections = spark.createDataFrame([(q, p, "bad" if q == 1 and p == 2 else "x" * p) for q in (1, 2) for p in range(1, 5)] + [(3, 1, "bad")], "query_id long, pos int, content string")
    queries = spark.createDataFrame([(q, "t") for q in (1, 2, 3)], "query_id long, text string")

    def scorer(texts, contents):
        if (contents == "bad").any():
            raise ValueError("no score")
        return contents.str.len()

    got = sorted((r.query_id, r.place, r.pos) for r in search.rerank(sections.coalesce(1), queries, scorer).collect())
    assert got == [(1, k, k) for k in range(1, 5)] + [(2, k, 5 - k) for k in range(1, 5)] + [(3, 1, 1)]


def test_walks_over_a_hub(spark):
    """A hub of a third of all relations adds no more than k events a hop."""
    entities = spark.createDataFrame([("a", "acme corp"), ("b", "acme"), ("h", "hub"), ("z", "..."), ("n", None)], "entity_id string, normalized_name string")
    links = [(f"e{k:04}", "h", 1.0) for k in range(2000)] + [("e1999", "a", 0.5), ("e1998", "b", None), ("x1", "b", 0.2), ("x1", "c", 1.0), ("y1", "c", 1.0)]
    relations = spark.createDataFrame(links, "event_id string, entity_id string, weight double")
    queries = spark.createDataFrame([(1, "News of ACME, Corp!"), (2, "acme"), (3, "acmecorp"), (4, None)], "query_id long, text string")
    assert {(r.query_id, r.entity_id) for r in hyperedges.named_entities(queries, entities).collect()} == {(1, "a"), (1, "b"), (2, "b")}
    got = {(r.query_id, r.rn): (r.event_id, r.score, r.hop) for r in hyperedges.hyperedge_walk(queries, entities, relations, 4, 2).collect()}
    assert [got[1, k] for k in range(1, 5)] == [("e1998", 1.0, 0), ("e0000", 0.5, 1), ("e0001", 0.5, 1), ("e0002", 0.5, 1)]
    assert {q for q, _ in got} == {1, 2}


def test_lazy_cover_equals_a_rescan(spark):
    r = np.random.default_rng(4)
    for n in range(3):
        pairs = sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 60, 300), r.integers(0, 40, 300), strict=True)})
        df = spark.createDataFrame([("s", f"v{a}", f"t{b:02}", f"n{b % 7}") for a, b in pairs], "source_config_id string, event_id string, entity_id string, name string")
        events = {}
        for a, b in pairs:
            events.setdefault(f"t{b:02}", set()).add(a)
        order = sorted(events, key=lambda e: (-len(events[e]), f"n{int(e[1:]) % 7}", e))
        rest, left, chosen = list(order), set().union(*events.values()), []
        while left and rest and len(chosen) < 25:
            best = max(rest, key=lambda e: len(events[e] & left))
            chosen.append(best)
            rest.remove(best)
            left -= events[best]
        chosen += rest[: 25 - len(chosen)]
        assert [x.entity_id for x in explore.cover_entities(df, 25).orderBy("pos").collect()] == chosen
