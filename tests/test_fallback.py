"""Search with a fallback: every line that holds the beginning of a query counts, whatever its rank."""

import duckdb

from loomgraph.operators import recall
from loomgraph.plans.registry import ORACLES, QUERIES


def test_holding_equals_a_comparison_of_all(spark):
    texts = ["the Old Mill by the river", "old mill", "a gold mill", "x", "", None, "ΟΔΟΣ und 龙卷风 hier", "old  mill old mill", "50% of a.b", "gold-mill"]
    chunks = spark.createDataFrame([(f"c{i % 8}", t) for i, t in enumerate(texts)], "chunk_id string, content string")
    asked = [(1, "OLD mill"), (1, "old mill"), (2, "the old mill by"), (3, ""), (4, None), (5, "龙卷风"), (6, "mill"), (7, "d-m"), (8, "% of a.b"), (9, "old m"), (None, "x"), (10, "y old mill by the")]
    got = recall.holding(spark.createDataFrame(asked, "query_id int, phrase string"), chunks).collect()
    want = [(q, f"c{i % 8}") for q, p in asked for i, t in enumerate(texts) if p is not None and t is not None and p.lower() in t.lower()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_scores_of_pairs_are_those_of_a_search(spark):
    chunks = spark.createDataFrame([(f"c{i}", "w1 " * (i % 5) + f"w{i % 7} other") for i in range(60)] + [("c3", "w2 w1"), ("n", None), (None, "w1")], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w5"), (3, "none")], "query_id int, text string")
    want = {(r.query_id, r.chunk_id): round(r.score, 9) for r in recall.bm25(queries, chunks, 100).collect()}
    assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in recall.bm25(queries, chunks, None).collect()} == want
    pairs = spark.createDataFrame([(1, "c3"), (2, "c5"), (2, "c1"), (3, "c1"), (1, "c3"), (1, "gone")], "query_id int, chunk_id string")
    got = {(r.query_id, r.chunk_id): round(r.score, 9) for r in recall.bm25(queries, chunks, None, pairs).collect()}
    assert got == {k: v for k, v in want.items() if k in {(1, "c3"), (2, "c5"), (2, "c1"), (3, "c1")}} and (1, "c3") in got


def test_lines_beyond_the_best_24_count(spark, tmp_path):
    begin = "which of the small rivers runs north all"
    text = begin + " year long without ice or mud"
    lines = ["ice mud year long without rivers north"] * 60 + [f"{'filler ' * 80}{begin.upper()} {'and more ' * 40}"] * 30 + ["", "unlike"]
    spark.createDataFrame([(1, "\n".join(lines), "src0"), (2, "unlike", "src1")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text), (2, "nothing of that sort")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in (1, 2, 12, 24)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r.chunk_id, r.fallback) for r in QUERIES["search_with_fallback"](spark, str(tmp_path)).collect())
    assert [r for r in got if r[0] == 1] == sorted((1, f"1-{k}", False) for k in range(60, 90)) and [r[2] for r in got if r[0] == 2] == [True] * 3
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    sql = ORACLES["search_with_fallback"]
    at = sql.index("ch AS (SELECT doc_id")  # only the lines' view is needed
    assert sorted(con.sql("WITH " + sql[at:]).fetchall()) == got
