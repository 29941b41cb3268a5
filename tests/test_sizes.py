"""Queries on tables larger or odder than the test tables: ties, caps, and what a step sends, shuffles or holds."""

from loomgraph.operators import catalog, recall


def test_merged_rows_without_an_id_come_after_others_of_their_score(spark):
    rows = spark.createDataFrame([(1, "s", None, 2.0), (1, "s", 5, 2.0), (1, None, 4, 2.0), (1, "s", None, 3.0)], "query_id int, source_config_id string, chunk_id long, score double")
    got = [(r.source_config_id, r.chunk_id, r.score) for r in recall.merge_sources(rows, 3).orderBy("rn").collect()]
    assert got == [("s", None, 3.0), ("s", 5, 2.0), ("s", None, 2.0)]


def test_a_folder_of_many_files_comes_in_requests(spark):
    listing = spark.range(25_000).selectExpr("'s' AS source", "'r/'||id||'.txt' AS path", "repeat('a', 64) AS sha256", "1L AS size_bytes", "id div 10000 AS request")
    plan = lambda rows: {tuple(r) for r in catalog.folder_plan(rows, listing.where("false"), "r").select("status", "reason").distinct().collect()}
    assert plan(listing) == {("new", None)} and plan(listing.drop("request")) == {("rejected", "too many files")}


def test_bm25_shuffles_no_pairs_and_adds_up_rows_of_one_id(spark, monkeypatch):
    import numpy as np

    from loomgraph.operators import ranking

    monkeypatch.setattr(ranking, "PAIRS", 50)
    monkeypatch.setattr(ranking, "GROUP", 7)
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in r.zipf(1.3, int(r.integers(1, 40))) if x < 60) for _ in range(400)]
    rows = [(f"c{i % 380}", x) for i, x in enumerate(texts)] + [(f"t{i}", "w1 w2") for i in range(50)] + [("e", ""), ("f", None)]
    asked = [(q, " ".join(f"w{x}" for x in r.integers(1, 60, 12))) for q in range(20)] + [(20, "W1 w2"), (21, None), (22, "none")]
    dl, tf, df = {}, {}, {}
    lengths = [len((x or "").split()) for _, x in rows]
    for c, x in rows:
        w = (x or "").split()
        for t in w:
            tf[c, len(w), t] = tf.get((c, len(w), t), 0) + 1
    for _, _, t in tf:
        df[t] = df.get(t, 0) + 1
    n, mean, want = len(rows), sum(lengths) / len(rows), []
    for q, text in asked:
        score = {}
        for (c, size, t), f in tf.items():
            if t in set((text or "").lower().split()):
                score[c] = score.get(c, 0) + np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean)) / 2
        want += [(q, c, k + 1) for k, c in enumerate(sorted(score, key=lambda c: (-round(score[c], 9), c))[:8])]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string")
    found = recall.bm25(spark.createDataFrame(asked, "query_id int, text string"), chunks.repartition(3), 8)
    assert sorted((r.query_id, r.chunk_id, r.rn) for r in found.collect()) == sorted(want)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_queries_of_the_same_names_are_walked_once(spark, monkeypatch):
    from loomgraph.operators import hyperedges
    from loomgraph.storage import Scratch

    sizes, save = {}, Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    entities = spark.createDataFrame([("a", "acme"), ("b", "box"), ("c", "cup")], "entity_id string, normalized_name string")
    links = [(f"e{i:03}", "a", 1.0 + i % 3) for i in range(90)] + [(f"e{i:03}", "c", 0.5) for i in range(0, 90, 7)] + [("x", "c", 1.0), ("y", "b", -1.0), ("z", "b", -4.0), ("y", "c", 0.1)]
    relations = spark.createDataFrame(links, "event_id string, entity_id string, weight double")
    for search in (hyperedges.hyperedge_walk, recall.hyperedge_search):
        got = {}
        for n in (1, 30):
            queries = spark.createDataFrame([(q, "ACME") for q in range(n)] + [(99, "box")], "query_id int, text string")
            rows = search(queries, entities, relations, 5).collect()
            got[n] = ({(r.event_id, r.score, r.rn) for r in rows if r.query_id < 99}, {(r.event_id, r.score) for r in rows if r.query_id == 99}, sizes.get("led1", sizes.get("direct")))
            assert len([r for r in rows if r.query_id < 99]) == 5 * n
        assert got[1] == got[30] and {e for e, _, _ in got[1][0]} == {"e002", "e005", "e008", "e011", "e014"}
        sizes.clear()


def test_neighbours_of_equal_vectors_go_by_id(spark, monkeypatch):
    import numpy as np

    from loomgraph.operators import ranking

    monkeypatch.setattr(ranking, "PAIRS", 64)
    r = np.random.default_rng(2)
    base = r.normal(size=(30, 24))
    rows = [(i, [float(x) for x in base[i % 30]], "ab"[i % 2]) for i in range(600)] + [(1000, None, "a"), (1001, [0.0] * 24, "a"), (1002, [1.0] * 3, "a"), (1003, [float("nan")] * 24, "a")]
    vectors = spark.createDataFrame(rows, "id int, v array<double>, source_config_id string").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in base[i]]) for i in range(7)], "query_id int, q array<double>")
    found = recall.knn(asked, vectors, 9)
    got = [(x.query_id, x.id) for x in found.orderBy("query_id", "rn").collect()]
    assert got == [(q, q + 30 * k) for q in range(7) for k in range(9)]
    own = recall.knn(asked.selectExpr("*", "explode(array('a', 'b')) AS source_config_id").where("query_id % 2 = 0"), vectors.where("id < 30 OR id > 33"), 4)
    assert [x.id for x in own.where("query_id = 2").orderBy("rn").collect()] == [2, 62, 92, 122]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def _many_lines(spark, monkeypatch):
    from loomgraph import fixtures

    monkeypatch.setattr(fixtures, "PER_TASK", 1)
    return fixtures.Tables(spark, "/root/testdata/sf0.001")


def _nodes(plan):
    """Nodes of a physical plan, with those of its stages."""
    kind, parts = plan.nodeName(), plan.children()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlan" else [plan.plan()] if kind.endswith("QueryStage") else [parts.apply(i) for i in range(parts.size())]
    return [plan, *[n for p in inner for n in _nodes(p)]]


def test_a_task_gets_no_more_lines_where_there_are_more(spark, monkeypatch):
    from loomgraph.operators import graph

    t = _many_lines(spark, monkeypatch)
    n = t.tasks()
    assert n == t.raw("lineitem").count() and n > 1000
    for df in (t.relations(), t.entities(), graph.overview_stats(t.events(), t.relations(), 77)):
        dealt = [x.outputPartitioning().numPartitions() for x in _nodes(df._jdf.queryExecution().executedPlan()) if x.nodeName() == "Exchange"]
        assert n in dealt
    assert 77 in dealt
    few = [r.asDict() for r in graph.overview_stats(t.events(), t.relations()).orderBy("source_config_id").limit(3).collect()]
    monkeypatch.undo()
    assert t.tasks() is None and few == [r.asDict() for r in graph.overview_stats(t.events(), t.relations(), 5).orderBy("source_config_id").limit(3).collect()]


def test_entities_are_made_distinct_by_their_keys(spark, tmp_path):
    from loomgraph.fixtures import ENTITIES, Tables, _on

    plan = Tables(spark, "/root/testdata/sf0.001").entities()._jdf.queryExecution().optimizedPlan().toString()
    assert all("p_name" not in line and "p_type" not in line for line in plan.splitlines() if "Aggregate" in line and "c_nationkey" in line) and "normalized_name" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)
    # A customer without a nation, a part that comes twice and one under two names.
    tables = {
        "customer": ([(1, 1), (2, None), (3, 1)], "c_custkey long, c_nationkey int"), "orders": ([(1, 1), (2, 2), (3, 3)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(o, p) for o in (1, 2, 3) for p in (1, 1, 2, 3, 9)], "l_orderkey long, l_partkey long"),
        "part": ([(1, "a", "t"), (1, "a", "t"), (1, "B", "t"), (2, "a", "t"), (3, None, None)], "p_partkey long, p_name string, p_type string"),
    }
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tables(spark, str(tmp_path))
    want = t._lines().join(t.raw("part"), _on("l_partkey", "p_partkey")).selectExpr(*ENTITIES).distinct()
    assert sorted(map(str, t.entities().collect())) == sorted(map(str, want.collect())) and want.count() == 4 + 3


def test_relations_of_entities_with_several_names_and_of_sent_hits(spark):
    from collections import Counter

    from loomgraph.operators import explore, graph, pages

    relations = spark.createDataFrame([("e1", "x", "1"), ("e1", "y", "2"), ("e1", "x", "3"), ("e2", "x", "4"), ("e2", "z", "5"), ("e2", None, "6"), ("e2", "w", "7")], "event_id string, entity_id string, id string")
    entities = spark.createDataFrame([("x", "A"), ("x", "B"), ("x", "A"), ("y", "C"), ("z", None), (None, "D")], "entity_id string, name string")
    scored = spark.createDataFrame([(1, "e1"), (1, "e1"), (2, "e1"), (2, "e2")], "query_id int, event_id string")
    got = explore.section_relations(scored, relations, entities, 2)
    # x has two names, which are two of the two chosen: each of its rows meets both, so it comes four times.
    want = {(1, "e1", "x", "1", 2): 4, (1, "e1", "x", "3", 2): 4, (2, "e1", "x", "1", 3): 4, (2, "e1", "x", "3", 3): 4, (2, "e2", "x", "4", 3): 4}
    assert Counter(map(tuple, got.select("query_id", "event_id", "entity_id", "id", "heat").collect())) == want
    saved = lambda df: "parquet" in "".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in x)
    weighed = relations.selectExpr("*", "1D AS weight", "current_timestamp() AS created_time")
    assert saved(pages.section_graph(scored.distinct(), weighed, entities.where("entity_id <> 'x'"), 3, 9)["edges"])
    assoc = relations.selectExpr("'s' AS source_config_id", "event_id", "entity_id", "id AS pos")
    cut = graph.cover_edge_slice(assoc, entities)
    assert saved(cut) and sorted((r.pos, r.covers, r.rn) for r in cut.collect()) == [("1", True, 1), ("2", True, 2), ("3", False, 5), ("4", True, 3), ("5", True, 4)]


def test_many_sections_are_reranked_in_pieces(spark, monkeypatch):
    import pandas as pd

    from loomgraph.operators import search

    monkeypatch.setattr(search, "PIECE", 4)
    rows = [(q, i, f"{(7 * i) % 20:02d}" + ("!" if q == 2 and i == 13 else "")) for q in (1, 2) for i in range(20)] + [(3, 5, "one")]
    sections = spark.createDataFrame(rows, "query_id int, pos int, content string")
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, text string")

    def scorer(texts, contents):
        if len(contents) > 4 or contents.str.contains("!").any() or (contents == "one").any():
            raise ValueError
        return pd.Series([float(c) for c in contents])

    got = {(r.query_id, r.place): r.content for r in search.rerank(sections, queries, scorer).collect()}
    assert [got[1, k] for k in range(1, 21)] == [f"{k:02d}" for k in range(19, -1, -1)]
    assert [got[2, k] for k in range(1, 21)] == [c for q, _, c in rows if q == 2] and got[3, 1] == "one"
