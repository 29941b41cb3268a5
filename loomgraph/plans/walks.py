"""Registered queries of hyperedge walks, boilerplate, evidence and external citations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, hyperedges, relevance
from .registry import query

_ASKED = "'what links the '||upper(p_name)||', and'||chr(10)||p_type||' of late'"
_HOP = """l{h} AS (SELECT query_id, entity_id, round(max(score) / 2, 6) AS score FROM f{b} JOIN p USING (event_id) GROUP BY ALL),
n{h} AS (SELECT query_id, event_id, max(score) AS score, {h} AS hop FROM l{h} JOIN p USING (entity_id) GROUP BY ALL),
u{h} AS (SELECT query_id, event_id, max(score) AS score, min(hop) AS hop FROM (SELECT query_id, event_id, score, hop FROM f{b} UNION ALL SELECT * FROM n{h}) GROUP BY ALL),
f{h} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS rn FROM u{h} QUALIFY rn <= 20)"""
_WALK = rf"""q AS (SELECT p_partkey AS query_id, ' '||array_to_string(regexp_extract_all(lower({_ASKED}), '[a-z0-9]+'), ' ')||' ' AS said FROM part WHERE p_partkey % 100 = 0),
nm AS (SELECT DISTINCT entity_id, ' '||array_to_string(regexp_extract_all(normalized_name, '[a-z0-9]+'), ' ')||' ' AS name FROM en),
s AS (SELECT DISTINCT query_id, entity_id FROM q JOIN nm ON contains(said, name) WHERE trim(name) <> ''), p AS (SELECT event_id, entity_id, max(coalesce(weight, 1.0)) AS w FROM ee GROUP BY ALL),
d AS (SELECT query_id, event_id, round(sum(w), 6) AS score, 0 AS hop FROM p JOIN s USING (entity_id) GROUP BY ALL), f0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS rn FROM d QUALIFY rn <= 20),
{_HOP.format(h=1, b=0)}, {_HOP.format(h=2, b=1)}"""


def _walk(t):
    queries = t.raw("part").where("p_partkey % 100 = 0").selectExpr("p_partkey AS query_id", _ASKED.replace("chr(10)", "'\\n'") + " AS text")
    return hyperedges.hyperedge_walk(queries, t.entities(), t.relations(), 20)


@query(f"WITH FIX, {_WALK} SELECT query_id, event_id, score, CAST(hop AS INT) AS hop, CAST(rn AS INT) AS rn FROM f2")
def hyperedge_walk(t):
    return _walk(t)


@query(f"""WITH FIX, {_WALK}, c AS (SELECT query_id, source_config_id, chunk_id, max(score) AS score, count(*) AS n_events FROM f2 JOIN ev USING (event_id) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_config_id, chunk_id) AS INT) AS rn FROM c QUALIFY rn <= 10""")
def walked_chunks(t):
    return hyperedges.walked_chunks(_walk(t), t.events(), 10)


_MARKED = "CASE doc_id % 4 WHEN 0 THEN '新浪首页 '||text||' 免责声明' WHEN 1 THEN '免责声明 免责声明 '||text WHEN 2 THEN text ELSE '阅读排行榜' END"


@query("SELECT doc_id, doc_id % 4 = 0 AND text IS NOT NULL OR doc_id % 12 = 3 AS boilerplate FROM documents")
def boilerplate_pages(t):
    rows = t.raw("documents").selectExpr("doc_id", "CASE WHEN doc_id % 12 = 3 THEN '点击加载更多' ELSE '' END AS heading", f"{_MARKED} AS content")
    return rows.select("doc_id", relevance.is_boilerplate(F.col("heading"), F.coalesce("content", F.lit(""))).alias("boilerplate"))


@query("""WITH r AS (SELECT page_id % 20 AS query_id, page_id AS pos, 'T'||page_id AS title, url FROM pages), u AS (SELECT *, CASE WHEN regexp_matches(url, '^https?://') THEN lower(regexp_extract(url, '^(https?)://([^/?#@]*@)?([^/?#@]+)([^#]*)', 1))||'://'||lower(regexp_extract(url, '^(https?)://([^/?#@]*@)?([^/?#@]+)([^#]*)', 3))||regexp_extract(url, '^(https?)://([^/?#@]*@)?([^/?#@]+)([^#]*)', 4) END AS c FROM r),
f AS (SELECT * FROM u WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, c ORDER BY pos) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rn FROM f QUALIFY rn <= 20), n AS (SELECT DISTINCT query_id, c FROM u WHERE pos % 3 = 0)
SELECT query_id, c AS url, title, n.c IS NOT NULL AS mapped, CAST(rn AS INT) AS rn FROM k LEFT JOIN n USING (query_id, c)""")
def external_citations(t):
    rows = t.raw("pages").selectExpr("page_id % 20 AS query_id", "page_id AS pos", "'T'||page_id AS title", "url")
    said = rows.where("pos % 3 = 0").groupBy("query_id").agg(F.array_join(F.collect_list(F.concat(F.lit("see "), "url", F.lit("."))), " ").alias("answer"))
    return answers.external_citations(said, rows)


@query("""WITH FIX, s AS (SELECT l_suppkey % 10 AS query_id, 'n'||c_nationkey AS source_config_id, 'c'||o_custkey||'-'||(o_orderkey % 3) AS chunk_id, max(l_extendedprice) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_config_id, chunk_id) AS pos FROM s QUALIFY pos <= 12), d AS (SELECT o_orderkey % 10 AS query_id, event_id, source_config_id, chunk_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_orderkey % 10 ORDER BY o_totalprice DESC, event_id) AS pos FROM orders JOIN ev ON event_id = lpad(CAST(o_orderkey AS STRING), 10, '0') QUALIFY pos <= 8),
e AS (SELECT query_id, source_config_id, chunk_id, min(pos) AS ep, max(score) AS es FROM d GROUP BY ALL), b AS (SELECT query_id, source_config_id, chunk_id, s1.score, pos, ep, es FROM s1 FULL JOIN e USING (query_id, source_config_id, chunk_id))
SELECT query_id, source_config_id, chunk_id, 'text of '||chunk_id AS content, greatest(score, es) AS score, ep IS NOT NULL AS by_event, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ep IS NULL, coalesce(ep, pos), source_config_id, chunk_id) AS INT) AS rn FROM b QUALIFY rn <= 15""")
def event_first_evidence(t):
    from ..operators.recall import top

    hits = t._lines().groupBy(F.expr("l_suppkey % 10").alias("query_id"), F.expr("'n'||c_nationkey").alias("source_config_id"), F.expr("'c'||o_custkey||'-'||(o_orderkey % 3)").alias("chunk_id")).agg(F.max("l_extendedprice").alias("score"))
    hits = top(hits, ["query_id"], [F.desc("score"), F.col("source_config_id"), F.col("chunk_id")], 12, "pos").withColumn("content", F.concat(F.lit("text of "), "chunk_id"))
    orders = t.raw("orders").selectExpr("o_orderkey % 10 AS query_id", "lpad(CAST(o_orderkey AS STRING), 10, '0') AS event_id", "o_totalprice AS score")
    told = top(orders.join(t.events(), "event_id"), ["query_id"], [F.desc("score"), F.col("event_id")], 8, "pos")
    chunks = t.events().select("source_config_id", "chunk_id").distinct().withColumn("content", F.concat(F.lit("text of "), "chunk_id"))
    return answers.event_first_evidence(hits, told, chunks, 15)
