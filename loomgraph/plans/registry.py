"""Registered queries of the event-entity operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import CTE, LIVE, VISIBLE, Tables
from ..operators import catalog, graph, recall

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "1998-01-01"


def query(sql: str | None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql.replace("WITH FIX", f"WITH {CTE}") if "WITH FIX" in sql else sql
        return f

    return register


def _top(sql: str, k: int) -> str:
    return f"SELECT * FROM ({sql}) WHERE rn <= {k}"


_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_BM25 = f"""
q AS (SELECT item_id AS query_id, text FROM benchmark),
w AS (SELECT chunk_id, {_WORDS.format("content")} AS w FROM ch),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
qt AS (SELECT DISTINCT query_id, unnest({_WORDS.format("text")}) AS term FROM q),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) / 2 AS raw
  FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT query_id, chunk_id, least(1.0, raw) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) AS rn FROM sc) WHERE rn <= 24)"""


def _benchmark_queries(t: Tables) -> DataFrame:
    return t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH FIX, {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rn AS INT) AS rn FROM bm")
def bm25_top(t):
    return recall.bm25(_benchmark_queries(t), t.chunks(), 24).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rn")


_FUSE = """
r AS (SELECT query_id, chunk_id AS key, score AS raw, CASE WHEN rn <= 3 THEN 0.3 ELSE 0.1 END AS lex, 0 AS exact, rn AS pos FROM bm),
f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, key) - 1 AS p, count(*) OVER (PARTITION BY query_id) AS n FROM r),
f2 AS (SELECT *, least(1.0, 0.5 * raw + 0.2 * (1 - p::DOUBLE / greatest(1, n - 1)) + 0.3 * lex) AS c, bool_or(lex >= 0.2) OVER (PARTITION BY query_id) AS a, max(raw) OVER (PARTITION BY query_id) AS best FROM f1),
f3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, raw DESC, pos, key) AS rn FROM f2 WHERE CASE WHEN a THEN lex >= 0.2 ELSE raw >= greatest(0.35, 0.68 * best) END)"""


@query(f"WITH FIX, {_BM25}, {_FUSE} SELECT query_id, key, round(c, 5) AS combined, CAST(rn AS INT) AS rn FROM f3 WHERE rn <= 8")
def search_sections(t):
    found = recall.bm25(_benchmark_queries(t), t.chunks(), 24)
    lex = F.when(F.col("rn") <= 3, 0.3).otherwise(0.1)
    rows = found.select("query_id", F.col("chunk_id").alias("key"), F.col("score").alias("raw"), lex.alias("lex"), F.lit(0).alias("exact"), F.col("rn").alias("pos"))
    return recall.fuse(rows, 8).withColumn("combined", F.round("combined", 5))


_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query(f"""SELECT query_id, id, round(score, 6) AS score, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
SELECT a.vec_id AS query_id, b.vec_id AS id, greatest(0.0, least(1.0, {_COS})) AS score FROM embeddings AS a, embeddings AS b WHERE a.vec_id % 100 = 0)) WHERE rn <= 10""")
def knn_exact(t):
    v = t.raw("embeddings")
    found = recall.knn(v.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS q"), v.selectExpr("vec_id AS id", "embedding AS v"), 10)
    return found.withColumn("score", F.round("score", 6))


@query("""WITH FIX, p AS (SELECT unnest(['thing', 'license', 'the ']) AS pattern)
SELECT * FROM (SELECT pattern, chunk_id, rank, CAST(hits AS INT) AS hits, CAST(row_number() OVER (PARTITION BY pattern ORDER BY hits DESC, rank, chunk_id) AS INT) AS rn FROM (
SELECT pattern, chunk_id, rank, (length(content) - length(replace(lower(content), pattern, ''))) // length(pattern) AS hits FROM ch, p WHERE contains(lower(content), pattern))) WHERE rn <= 40""")
def grep_hits(t):
    patterns = t.spark.createDataFrame([("thing",), ("license",), ("the ",)], "pattern string")
    return recall.grep(patterns, t.chunks(), 40)


@query("WITH FIX SELECT chunk_id, regexp_replace(lower(content), '[^a-z0-9\\x{3400}-\\x{9FFF}]', '', 'g') AS norm, CAST(length(content) - length(o) + ceil(length(o) / 4) AS INT) AS tokens FROM (SELECT *, regexp_replace(content, '[\\x{3000}-\\x{9FFF}\\x{F900}-\\x{FAFF}]', '', 'g') AS o FROM ch)")
def text_measures(t):
    return t.chunks().select("chunk_id", recall.normalize_text(F.col("content")).alias("norm"), recall.estimate_tokens(F.col("content")).alias("tokens"))


@query("""SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_config_id, chunk_id) AS INT) AS rn FROM (
SELECT user_id AS query_id, event_type AS source_config_id, nullif(event_id % 7, 3) AS chunk_id, max(value) AS score FROM events GROUP BY user_id, event_type, event_id % 7, CASE WHEN event_id % 7 = 3 THEN event_id END) QUALIFY rn <= 8""")
def merge_sources(t):
    rows = t.raw("events").selectExpr("user_id AS query_id", "event_type AS source_config_id", "nullif(event_id % 7, 3) AS chunk_id", "value AS score")
    return recall.merge_sources(rows, 8)


@query(_top("""WITH FIX SELECT source_config_id, entity_id, name, coalesce(heat, 0) AS heat, CAST(row_number() OVER (PARTITION BY source_config_id ORDER BY coalesce(heat, 0) DESC, name, entity_id) AS INT) AS rn
FROM en LEFT JOIN (SELECT entity_id, count(*) AS heat FROM ee GROUP BY 1) USING (entity_id)""", 50))
def entity_heat(t):
    return graph.entity_heat(t.entities(), t.relations(), 50)


@query(f"WITH FIX SELECT event_id, count(*) AS n FROM ee WHERE {LIVE} GROUP BY 1")
def event_relation_counts(t):
    return graph.event_relation_counts(t.relations())


_ASSOC = "SELECT event_id, entity_id, id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY weight DESC NULLS LAST, created_time, entity_id, id) AS INT) AS rn FROM ee"


@query("WITH FIX SELECT * FROM (" + _ASSOC + ") WHERE rn <= 8")
def slice_associations(t):
    return graph.slice_associations(t.relations())


@query("WITH FIX, a AS (SELECT * FROM (" + _ASSOC + """) WHERE rn <= 8), b AS (SELECT event_id, entity_id, event_id||entity_id||id AS pos FROM a)
SELECT event_id, entity_id, pos, row_number() OVER (PARTITION BY event_id ORDER BY pos) = 1 OR row_number() OVER (PARTITION BY entity_id ORDER BY pos) = 1 AS covers FROM b""")
def cover_edges(t):
    return graph.cover_edges(graph.slice_associations(t.relations()).selectExpr("event_id", "entity_id", "event_id||entity_id||id AS pos"))


@query("""WITH FIX, p AS (SELECT DISTINCT event_id, entity_id FROM ee), s AS (SELECT entity_id FROM p GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT * FROM p JOIN s USING (entity_id))
SELECT a.event_id, b.event_id AS other_id, count(*) AS shared FROM r AS a JOIN r AS b ON a.entity_id = b.entity_id AND a.event_id < b.event_id GROUP BY ALL""")
def shared_entity_edges(t):
    return graph.shared_entity_edges(t.relations())


@query(f"""WITH FIX, v AS (SELECT *, event_id IN (SELECT event_id FROM ee) AS linked FROM ev WHERE {VISIBLE}),
u AS (SELECT *, CASE WHEN linked THEN 0 ELSE 1 END AS grp, CASE WHEN linked THEN 0 ELSE row_number() OVER (PARTITION BY linked, source_config_id, source_id ORDER BY rank, created_time DESC, event_id) END AS turn FROM v)
SELECT source_config_id, event_id, CAST(grp AS INT) AS grp, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_config_id ORDER BY grp, turn, rank, created_time DESC, event_id) AS INT) AS rn FROM u) WHERE rn <= 60""")
def slice_events(t):
    return graph.slice_events(t.events(), t.relations(), 60)


@query(f"""WITH FIX, v AS (SELECT *, count(*) OVER (PARTITION BY source_config_id) AS total, CAST(row_number() OVER (PARTITION BY source_config_id ORDER BY event_time DESC, rank, event_id) AS INT) AS ordinal
FROM ev WHERE {VISIBLE} AND event_time <= TIMESTAMP '{AS_OF}' AND created_time <= TIMESTAMP '{AS_OF}') SELECT source_config_id, event_id, ordinal, total, total > 24 AS has_more FROM v WHERE ordinal <= 24""")
def timeline(t):
    return graph.timeline(t.events(), AS_OF, 24)


@query(f"""WITH FIX, p AS (SELECT event_id, entity_id, max(coalesce(weight, 1.0)) AS weight, max(description) AS description FROM ee WHERE created_time <= TIMESTAMP '{AS_OF}' GROUP BY ALL),
b AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS total, CAST(row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, entity_id) AS INT) AS rn FROM p)
SELECT event_id, entity_id, weight, description, total, round(greatest(0.4, least(1.0, 0.5 + 0.08 * ln(1 + total))), 6) AS importance, round(greatest(0.3, least(1.0, 0.42 + 0.08 * weight)), 6) AS entity_importance, total <= 4 AS complete, rn FROM b WHERE rn <= 4""")
def event_bundles(t):
    return graph.event_bundles(t.relations(), AS_OF, 4)


@query(f"""WITH FIX SELECT entity_id, count(DISTINCT event_id) AS n FROM ee WHERE created_time <= TIMESTAMP '{AS_OF}' AND event_id IN (
SELECT event_id FROM ev WHERE {VISIBLE} AND event_time <= TIMESTAMP '{AS_OF}' AND created_time <= TIMESTAMP '{AS_OF}') GROUP BY 1""")
def entity_event_counts(t):
    return graph.entity_event_counts(t.relations(), t.events(), AS_OF)


@query(f"""WITH FIX, v AS (SELECT * FROM ev WHERE {VISIBLE}), s AS (SELECT source_config_id, count(*) AS n_events, min(event_time) AS first_time, max(event_time) AS last_time FROM v GROUP BY 1),
r AS (SELECT source_config_id, count(*) AS n_relations, count(DISTINCT entity_id) AS n_entities FROM (SELECT DISTINCT source_config_id, event_id, entity_id FROM ee SEMI JOIN v USING (event_id, source_config_id)) GROUP BY 1)
SELECT s.*, coalesce(n_relations, 0) AS n_relations, coalesce(n_entities, 0) AS n_entities, round(least(1.0, log10(n_events + 1) / 6), 6) AS density FROM s LEFT JOIN r USING (source_config_id)""")
def overview_stats(t):
    return graph.overview_stats(t.events(), t.relations(), t.tasks())


@query("WITH FIX SELECT source_config_id, type, normalized_name, min(entity_id) AS entity_id, count(*) AS n FROM en GROUP BY ALL")
def resolve_entities(t):
    return graph.resolve_entities(t.entities())


_GONE = "d AS (SELECT document_id FROM doc WHERE status = 'FAILED'), g AS (SELECT event_id FROM ev WHERE source_id IN (SELECT document_id FROM d))"


@query(f"""WITH FIX, {_GONE} SELECT entity_id FROM en WHERE entity_id IN (SELECT entity_id FROM ee WHERE event_id IN (SELECT event_id FROM g)) AND entity_id NOT IN (SELECT entity_id FROM ee WHERE event_id NOT IN (SELECT event_id FROM g))""")
def delete_documents_orphans(t):
    ids = t.documents().where("status = 'FAILED'").selectExpr("document_id AS source_id")
    return graph.delete_documents(t.events(), t.relations(), t.entities(), ids)["entities"]


@query(f"WITH FIX, {_GONE} SELECT id, event_id, entity_id FROM ee WHERE event_id IN (SELECT event_id FROM g)")
def delete_documents_relations(t):
    ids = t.documents().where("status = 'FAILED'").selectExpr("document_id AS source_id")
    return graph.delete_documents(t.events(), t.relations(), t.entities(), ids)["relations"]


@query("SELECT event_type AS source_config_id, count(DISTINCT event_id) AS hits, max(value) AS score, max(ts) AS latest FROM events GROUP BY 1")
def source_hits(t):
    return graph.source_hits(t.raw("events").selectExpr("event_type AS source_config_id", "event_id", "value AS score", "ts AS event_time"))


@query("""SELECT conv_id, '消息-' || count(*) || '条' AS title, '# 消息' || repeat(chr(10), 4) || string_agg('**' || CASE WHEN turn % 3 = 1 THEN 'a' || conv_id ELSE coalesce(nullif(role, ''), '消息') END || '**' || CASE WHEN turn % 2 = 0 THEN '（' || turn || '）' ELSE '' END || '：' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY 1""")
def messages_to_documents(t):
    return catalog.messages_to_documents(t.raw("conversations").selectExpr("*", "CASE WHEN turn % 3 = 1 THEN 'a' || conv_id ELSE '' END AS author", "CASE WHEN turn % 2 = 0 THEN turn END AS ts"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(t):
    return catalog.content_hash(t.raw("documents"), "doc_id", "text")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\r\\n]+', ' ', 'g')) AS title, md5(url)[1:12] AS id FROM pages")
def html_titles(t):
    return t.raw("pages").select("page_id", catalog.html_title(F.col("html")).alias("title"), F.substring(F.md5("url"), 1, 12).alias("id"))


@query("""WITH l AS (SELECT source, doc_id||'.txt' AS path, sha256(text) AS h, doc_id FROM documents)
SELECT source, path, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM l WHERE doc_id % 10 <> 0""")
def plan_folder_sync(t):
    d = t.raw("documents").selectExpr("source", "doc_id||'.txt' AS path", "doc_id", "sha2(text, 256) AS sha256")
    old = d.where("doc_id % 4 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, F.sha2("sha256", 256)).otherwise(F.upper("sha256")))
    return catalog.plan_folder_sync(d.where("doc_id % 10 <> 0"), old)


@query("""SELECT user_id, max_by(event_id, event_id) AS event_id, CASE WHEN user_id % 2 = 0 THEN 'update' ELSE 'insert' END AS change FROM events WHERE user_id % 3 <> 0 GROUP BY 1
UNION ALL SELECT user_id, -1, 'keep' FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0 AND user_id % 3 = 0)""")
def upsert_rows(t):
    e = t.raw("events")
    target = e.where("user_id % 2 = 0").select("user_id").distinct().withColumn("event_id", F.lit(-1).cast("long"))
    return catalog.upsert_rows(e.where("user_id % 3 <> 0").select("user_id", "event_id"), target, "user_id", "event_id")


@query("WITH FIX SELECT source_config_id, count(document_id) AS n, coalesce(sum(chunk_count), 0)::BIGINT AS chunks, coalesce(sum(event_count), 0)::BIGINT AS events FROM src LEFT JOIN doc ON source_id = source_config_id GROUP BY 1")
def refresh_source_counts(t):
    return catalog.refresh_source_counts(t.sources(), t.documents())


@query("""WITH FIX SELECT source_id, count(*) AS total, count(*) FILTER (status = 'READY') AS ready, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PAUSED') AS paused,
count(*) FILTER (status NOT IN ('READY', 'FAILED')) AS pending FROM doc GROUP BY 1""")
def status_counts(t):
    return catalog.status_counts(t.documents())


@query("WITH FIX SELECT document_id, filename FROM doc WHERE status = 'READY' AND contains(lower(filename), '1') ORDER BY created_at DESC, document_id LIMIT 20 OFFSET 5")
def list_documents(t):
    return catalog.list_documents(t.documents(), "READY", "1", 20, 5)


@query("WITH FIX SELECT doc_id, chunk_id, rank, substring(content, 1, 30) AS heading, CAST(length(content) AS INT) AS length FROM ch QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) <= 20")
def outline(t):
    return catalog.outline(t.chunks().withColumn("heading", F.substring("content", 1, 30)), 20)


@query("WITH FIX SELECT source_id, name, document_id, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, document_id) AS INT) AS rn FROM doc) JOIN src ON source_id = source_config_id WHERE rn <= 10")
def recent_activity(t):
    return catalog.recent_activity(t.documents(), t.sources(), 10)


@query("""SELECT conv_id, turn, CAST(cum AS BIGINT) AS cum FROM (SELECT conv_id, turn, sum(ceil(length(coalesce(text, '')) / 4)) OVER w AS cum, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE cum <= 100 OR rn = 1 OR n <= 3""")
def history_window(t):
    return catalog.history_window(t.raw("conversations"), 100, 3)


@query("""WITH FIX SELECT * FROM (SELECT source_id, document_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY list_position(['READY', 'EXTRACTING', 'FAILED', 'PAUSED', 'LOADING', 'PENDING'], status), event_count DESC, created_at DESC, document_id DESC) AS INT) AS rn FROM doc WHERE event_count > 0) WHERE rn <= 12""")
def pick_documents(t):
    return catalog.pick_documents(t.documents(), 12)


@query("""WITH FIX, j AS (SELECT 'n'||(c_nationkey + 1) AS source_id, 'c'||c_custkey AS document_id FROM customer WHERE c_custkey % 50 = 1)
SELECT source_id, bool_or(b) AS busy FROM (SELECT source_id, status IN ('PENDING', 'LOADING', 'EXTRACTING') AS b FROM doc
UNION ALL SELECT j.source_id, TRUE FROM j JOIN doc USING (document_id) WHERE status IN ('PENDING', 'LOADING', 'EXTRACTING')) GROUP BY 1""")
def ingest_busy(t):
    jobs = t.raw("customer").where("c_custkey % 50 = 1").selectExpr("'n'||(c_nationkey + 1) AS source_id", "'c'||c_custkey AS document_id", "CASE WHEN c_custkey % 2 = 0 THEN 'queued' ELSE 'running' END AS status")
    return catalog.ingest_busy(t.documents(), jobs)


@query("SELECT source, id, CAST((row_number() OVER (PARTITION BY source ORDER BY id) - 1) // 200 AS INT) AS batch FROM (SELECT DISTINCT event_type AS source, event_id AS id FROM events WHERE user_id % 10 <> 0)")
def plan_batches(t):
    ids = t.raw("events").selectExpr("event_type AS source", "event_id AS id", "user_id")
    return catalog.plan_batches(ids, 200, ids.where("user_id % 10 = 0"))


_SAMPLES = "m AS (SELECT event_type AS path, value, event_id FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 4096)"


@query(f"""WITH {_SAMPLES}, s AS (SELECT * FROM m UNION ALL SELECT NULL, value, event_id FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY value, event_id) - 1 AS pos, count(*) OVER (PARTITION BY path) AS n FROM s)
SELECT path, count(*) AS n, count(*) FILTER (value >= 90) AS slow, max(value) FILTER (pos = least(n - 1, floor(n * 0.5))) AS p50, max(value) FILTER (pos = least(n - 1, floor(n * 0.95))) AS p95, max(value) FILTER (pos = least(n - 1, floor(n * 0.99))) AS p99, max(value) AS max FROM r GROUP BY path""")
def latency_summary(t):
    return catalog.latency_summary(t.raw("events").selectExpr("event_type AS path", "value AS duration_ms", "ts", "event_id AS id"), 90)


@query(f"WITH {_SAMPLES} SELECT path, value AS duration_ms, event_id AS id FROM m WHERE value >= 90 ORDER BY value DESC, event_id LIMIT 10")
def slowest_requests(t):
    return catalog.slowest_requests(t.raw("events").selectExpr("event_type AS path", "value AS duration_ms", "ts", "event_id AS id"), 90).drop("ts")


@query(f"WITH FIX SELECT source_config_id, count(*) AS missing FROM ev WHERE {VISIBLE} AND CAST(event_id AS BIGINT) % 3 <> 0 GROUP BY 1")
def missing_vectors(t):
    return catalog.missing_vectors(t.events(), t.events().where("CAST(event_id AS BIGINT) % 3 = 0").select("event_id"))


@query(f"WITH FIX SELECT source_config_id AS source, event_id AS id FROM ev WHERE {VISIBLE} AND CAST(event_id AS BIGINT) % 3 <> 0")
def missing_vector_ids(t):
    return catalog.missing_vector_ids(t.events(), t.events().where("CAST(event_id AS BIGINT) % 3 = 0").select("event_id"))


@query(_top("""WITH FIX SELECT source_config_id, entity_id, name, coalesce(heat, 0) AS heat, CAST(row_number() OVER (PARTITION BY source_config_id ORDER BY coalesce(heat, 0) DESC, name, entity_id) AS INT) AS rn
FROM en LEFT JOIN (SELECT entity_id, count(*) AS heat FROM ee GROUP BY 1) USING (entity_id) WHERE type IN ('SMALL', 'PROMO')""", 50))
def entity_heat_of_types(t):
    return graph.entity_heat(t.entities(), t.relations(), 50, ["SMALL", "PROMO"])


@query("""WITH j AS (SELECT event_type AS status, event_type||CAST(ts AS DATE) AS job_id, json_extract_string(props, '$.k') AS id FROM events)
SELECT status, count(DISTINCT job_id) AS jobs, count(*) AS refs, count(DISTINCT id) AS unique_ids, count(*) - count(DISTINCT id) AS duplicates FROM j GROUP BY 1""")
def queue_audit(t):
    jobs = t.raw("events").selectExpr("event_type AS status", "event_type||CAST(ts AS DATE) AS job_id", "get_json_object(props, '$.k') AS id")
    return catalog.queue_audit(jobs)


from . import ingesting, more, planning, searching, walks  # noqa: E402,F401  register their queries here
