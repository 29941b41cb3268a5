"""Registered queries of relevance, exploration and work planning, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import VISIBLE
from ..operators import catalog, chunking, explore, recall, relevance, work
from ..storage import Scratch
from .registry import _BM25, _COS, AS_OF, _benchmark_queries, query

_TERMS = "list_filter(regexp_extract_all(lower(trim(text)), '[a-z0-9][a-z0-9_.+-]{1,31}|[\\x{3400}-\\x{9fff}]{2,16}'), lambda t: NOT regexp_full_match(t, '[0-9]+'))"
_FIRST4 = "list_filter(l, lambda t, i: list_position(l, t) = i)[1:4]"
_NORM = "regexp_replace(lower({}), '[^a-z0-9\\x{{3400}}-\\x{{9FFF}}]', '', 'g')"


@query(f"WITH FIX, {_BM25}, l AS (SELECT query_id, {_TERMS} AS l FROM q) SELECT query_id, array_to_string({_FIRST4}, '|') AS terms FROM l")
def query_terms(t):
    return _benchmark_queries(t).select("query_id", F.array_join(relevance.query_terms(F.col("text")), "|").alias("terms"))


_LEX = f"""l AS (SELECT query_id, text, {_TERMS} AS l FROM q), lq AS (SELECT query_id, {_NORM.format("text")} AS p, list_filter(list_transform({_FIRST4}, lambda t: {_NORM.format("t")}), lambda t: t <> '') AS ts FROM l),
lr AS (SELECT bm.query_id, bm.chunk_id, bm.rn, bm.score, p, ts, {_NORM.format("substring(content, 1, 30)")} AS h, {_NORM.format("substring(content, 1, 30)")} || {_NORM.format("content")} AS t FROM bm JOIN ch USING (chunk_id) JOIN lq USING (query_id)),
lx AS (SELECT *, CAST(length(p) >= 2 AND contains(t, p) AS INT) AS exact, CASE WHEN t = '' THEN 0 ELSE least(1.0, CASE WHEN length(p) >= 2 AND contains(t, p) THEN CASE WHEN contains(h, p) THEN 0.75 ELSE 0.55 END ELSE 0 END
  + coalesce((0.35 * len(list_filter(ts, lambda x: contains(t, x))) + 0.15 * len(list_filter(ts, lambda x: contains(h, x)))) / nullif(len(ts), 0), 0))::DOUBLE END AS lex FROM lr)"""


def _relevant(t):
    queries = _benchmark_queries(t)
    found = recall.with_rows(recall.bm25(queries, t.chunks(), 24), t.chunks().select("chunk_id", "content")).join(queries, "query_id")
    return relevance.lexical_relevance(found.withColumn("heading", F.substring("content", 1, 30)))


@query(f"WITH FIX, {_BM25}, {_LEX} SELECT query_id, chunk_id, exact, round(lex, 6) AS lex FROM lx")
def lexical_relevance(t):
    return _relevant(t).select("query_id", "chunk_id", "exact", F.round("lex", 6).alias("lex"))


@query(f"""WITH FIX, {_BM25}, {_LEX}, f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn, chunk_id) - 1 AS p0, count(*) OVER (PARTITION BY query_id) AS n FROM lx),
f2 AS (SELECT *, least(1.0, 0.5 * score + 0.2 * (1 - p0::DOUBLE / greatest(1, n - 1)) + 0.3 * lex + 0.15 * exact) AS c, bool_or(exact = 1 OR lex >= 0.2) OVER (PARTITION BY query_id) AS a, max(score) OVER (PARTITION BY query_id) AS best FROM f1),
f3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, score DESC, rn, chunk_id) AS k FROM f2 WHERE CASE WHEN a THEN exact = 1 OR lex >= 0.2 ELSE score >= greatest(0.35, 0.68 * best) END)
SELECT query_id, chunk_id AS key, round(c, 6) AS combined, CAST(k AS INT) AS rn FROM f3 WHERE k <= 8""")
def search_lexical(t):
    rows = _relevant(t).select("query_id", F.col("chunk_id").alias("key"), F.col("score").alias("raw"), "lex", "exact", F.col("rn").alias("pos"))
    return recall.fuse(rows, 8)


@query(f"""WITH FIX, {_BM25}, s AS (SELECT query_id, rn, chunk_id, content, coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM bm JOIN ch USING (chunk_id))
SELECT query_id, CAST(rn AS INT) AS rn, chunk_id, substring(content, 1, CAST(1000 - b AS BIGINT)) AS content FROM s WHERE b < 1000""")
def pack_evidence(t):
    found = recall.with_rows(recall.bm25(_benchmark_queries(t), t.chunks(), 24), t.chunks().select("chunk_id", "content"))
    return relevance.pack_evidence(found.select("query_id", "rn", "chunk_id", "content"), 1000)


@query("""WITH FIX, r AS (SELECT *, row_number() OVER (PARTITION BY source_config_id, chunk_id ORDER BY rank, event_id) AS rn FROM ev)
SELECT source_config_id, chunk_id, string_agg(event_id, ',' ORDER BY rn) AS event_ids FROM r WHERE rn <= 3 GROUP BY ALL""")
def citations(t):
    return relevance.citations(t.events())


@query("SELECT event_id, event_id % 6 BETWEEN 1 AND 4 AND user_id % 5 BETWEEN 1 AND 4 AS valid FROM events")
def validate_answers(t):
    answers = t.raw("events").selectExpr("event_id", "'see ['||(event_id % 6)||'] and ['||(user_id % 5)||']' AS answer")
    return answers.select("event_id", relevance.valid_answer(F.col("answer"), F.lit(4)).alias("valid"))


@query("""WITH FIX SELECT source_config_id, event_id, CAST(row_number() OVER (PARTITION BY source_config_id ORDER BY start_time DESC NULLS LAST, event_id) AS INT) AS rn FROM ev QUALIFY rn <= 20""")
def sort_events(t):
    return relevance.sort_events(t.events(), 20).select("source_config_id", "event_id", "rn")


@query("""WITH FIX, c AS (SELECT *, rank // 3 AS g, rank % 3 = 0 AS par FROM ch)
SELECT a.chunk_id, CASE WHEN a.par THEN NULL ELSE b.chunk_id END AS parent_id FROM c AS a LEFT JOIN c AS b ON a.doc_id = b.doc_id AND a.g = b.g AND b.par""")
def link_parents(t):
    chunks = t.chunks().selectExpr("doc_id", "chunk_id", "CASE WHEN rank % 3 = 0 THEN 'parent' ELSE 'child' END AS chunk_type", "CAST(floor(rank / 3) AS INT) AS parent_group")
    return relevance.link_parents(chunks)


@query("SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN n_chars + 5 ELSE greatest(1, ceil(n_chars / 3)) END AS BIGINT) AS tokens FROM documents")
def token_usage(t):
    total, prompt = F.expr("CASE WHEN doc_id % 3 = 0 THEN n_chars END"), F.expr("CASE WHEN doc_id % 3 = 1 THEN n_chars END")
    return t.raw("documents").select("doc_id", relevance.token_usage(total, prompt, F.lit(5), F.col("n_chars")).alias("tokens"))


_NEAR = f"SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, greatest(0.0, least(1.0, {_COS})) AS score FROM embeddings AS a, embeddings AS b WHERE a.vec_id % 100 = 0"


@query(f"""WITH e AS ({_NEAR})) WHERE rn <= 10), a AS ({_NEAR} AND b.vec_id % 5 <> 0)) WHERE rn <= 10)
SELECT e.query_id, round(count(a.id) / count(*), 6) AS recall FROM e LEFT JOIN a ON e.query_id = a.query_id AND e.id = a.id GROUP BY ALL""")
def recall_at_k(t):
    v = t.raw("embeddings").selectExpr("vec_id AS id", "embedding AS v")
    q = v.where("id % 100 = 0").selectExpr("id AS query_id", "v AS q")
    return relevance.recall_at_k(recall.knn(q, v, 10), recall.knn(q, v.where("id % 5 <> 0"), 10)).withColumn("recall", F.round("recall", 6))


@query(f"""WITH FIX, {_BM25}, e AS (SELECT item_id AS query_id, lower(string_split(text, ' ')[9]) AS x FROM benchmark)
SELECT query_id, count(*) FILTER (contains(lower(content), x)) AS matches, count(*) FILTER (contains(lower(content), x)) > 0 AS hit FROM e LEFT JOIN bm USING (query_id) LEFT JOIN ch USING (chunk_id) GROUP BY 1""")
def evaluate_retrieval(t):
    cases = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.array(F.get(F.split("text", " "), F.lit(8))).alias("expected"))
    found = recall.with_rows(recall.bm25(_benchmark_queries(t), t.chunks(), 24), t.chunks().select("chunk_id", "content"))
    return relevance.evaluate_retrieval(cases, found.select("query_id", "content"))


_PAIRS = "p AS (SELECT event_id, entity_id, max(coalesce(weight, 1.0)) AS weight FROM ee GROUP BY ALL)"


@query(f"""WITH FIX, {_PAIRS}, t AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS total FROM p)
SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, entity_id) AS INT) AS rn FROM t WHERE weight < 0.8 OR (weight = 0.8 AND entity_id > 'n3') QUALIFY rn <= 4""")
def expand_event(t):
    return explore.expand_event(t.relations(), 0.8, "n3", 4)


@query("""WITH FIX, p AS (SELECT event_id, entity_id, max(coalesce(weight, 1.0)) AS weight FROM ee WHERE created_time <= TIMESTAMP '1997-01-01' GROUP BY ALL), t AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS total FROM p),
c AS (SELECT event_id, CASE CAST(event_id AS BIGINT) % 3 WHEN 1 THEN 0.8 WHEN 2 THEN 0.4 END AS w FROM ev WHERE category <> '5-LOW')
SELECT event_id, entity_id, weight, total, CAST(row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, entity_id) AS INT) AS rn FROM t JOIN c USING (event_id) WHERE w IS NULL OR weight < w OR (weight = w AND entity_id > 'n3') QUALIFY rn <= 4""")
def expand_events(t):
    cursors = t.events().where("category <> '5-LOW'").selectExpr("event_id", "CASE CAST(event_id AS BIGINT) % 3 WHEN 1 THEN 0.8 WHEN 2 THEN 0.4 END AS weight", "'n3' AS entity_id")
    return explore.expand_events(t.relations(), cursors, 4, "1997-01-01")


@query(f"""WITH FIX, {_PAIRS} SELECT event_id, entity_id, weight, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY event_time DESC, weight DESC, event_id DESC) AS INT) AS rn
FROM p JOIN ev USING (event_id) WHERE {VISIBLE} AND event_time >= TIMESTAMP '1996-01-01' AND event_time < TIMESTAMP '{AS_OF}' QUALIFY rn <= 4""")
def expand_entity(t):
    return explore.expand_entity(t.relations(), t.events(), "1996-01-01", AS_OF, 4).select("event_id", "entity_id", "weight", "rn")


@query("""WITH FIX, e AS (SELECT source_config_id, count(*) AS n, CAST(epoch(max(created_time)) AS BIGINT) AS t FROM ev GROUP BY 1), r AS (SELECT source_config_id, count(*) AS m, CAST(epoch(max(created_time)) AS BIGINT) AS u FROM ee GROUP BY 1)
SELECT source_config_id, sha256(n||'|'||t||'|'||coalesce(m, 0)||'|'||coalesce(u, 0)) AS revision FROM e LEFT JOIN r USING (source_config_id)""")
def graph_revision(t):
    return explore.graph_revision(t.events(), t.relations())


@query("""WITH FIX, m AS (SELECT source_config_id AS source_id, CAST(substring(source_config_id, 2) AS BIGINT) AS revision, 'old' AS reason FROM src WHERE CAST(substring(source_config_id, 2) AS BIGINT) % 2 = 0),
c AS (SELECT source_id, max_by(status, document_id) AS new FROM doc WHERE event_count > 9 GROUP BY 1)
SELECT source_id, coalesce(revision, 0) + CASE WHEN new IS NULL THEN 0 ELSE 1 END AS revision, coalesce(new, reason) AS reason FROM m FULL JOIN c USING (source_id)""")
def mark_dirty(t):
    marks = t.sources().selectExpr("source_config_id AS source_id", "CAST(substring(source_config_id, 2) AS BIGINT) AS revision", "'old' AS reason").where("revision % 2 = 0")
    return explore.mark_dirty(marks, t.documents().where("event_count > 9").selectExpr("source_id", "status AS reason", "document_id AS at"))


@query(f"""WITH FIX, v AS (SELECT * FROM ev WHERE {VISIBLE}) SELECT source_config_id, CASE WHEN source_config_id IN (SELECT source_id FROM doc WHERE event_count = 10) THEN count(*) ELSE count(*) FILTER (created_time <= TIMESTAMP '{AS_OF}') END AS n FROM v GROUP BY 1""")
def overview_incremental(t):
    counts = lambda e: e.where(VISIBLE).groupBy("source_config_id").agg(F.count("*").alias("n"))
    dirty = t.documents().where("event_count = 10").selectExpr("source_id AS source_config_id").distinct()
    return explore.overview_incremental(counts(t.events().where(f"created_time <= TIMESTAMP '{AS_OF}'")), counts(t.events()), dirty, "source_config_id")


@query("""WITH s AS (SELECT user_id AS source, event_id AS id, ts AS created, event_id % 50 = 0 AS active FROM events) SELECT source, id, active FROM s WHERE active
UNION ALL SELECT source, id, active FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created DESC, id DESC) AS rn FROM s WHERE NOT active) WHERE rn <= 1""")
def keep_latest_snapshots(t):
    rows = t.raw("events").selectExpr("user_id AS source", "event_id AS id", "ts AS created", "event_id % 50 = 0 AS active")
    return explore.keep_latest_snapshots(rows, 1).select("source", "id", "active")


@query(f"""WITH FIX, n AS (SELECT source_id, count(*) AS total, count(*) FILTER ({VISIBLE}) AS visible FROM ev GROUP BY 1)
SELECT n.source_id, total - visible AS restored FROM n JOIN doc ON document_id = n.source_id WHERE visible < event_count AND total = event_count""")
def repair_hidden_events(t):
    return explore.repair_hidden_events(t.events(), t.documents())


@query(f"WITH FIX, i AS (SELECT event_id, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS ids FROM ee GROUP BY 1) SELECT event_id, title, source_config_id, source_id, category, start_time, created_time, coalesce(ids, '') AS entity_ids FROM ev LEFT JOIN i USING (event_id) WHERE {VISIBLE}")
def event_vector_rows(t):
    return explore.event_vector_rows(t.events(), t.relations())


@query("SELECT doc_id, CAST(i AS INT) AS line_no, l[i] AS line, CAST(len(l) AS INT) AS total FROM (SELECT doc_id, l, unnest(range(3, least(len(l), 7) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def read_lines(t):
    return explore.read_lines(t.raw("documents"), 2, 5)


@query("""SELECT conv_id, turn, CAST(rn AS INT) AS rn, n > 5 AS has_more FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE rn <= 5""")
def messages_page(t):
    return explore.messages_page(t.raw("conversations"), 5)


_REFS = "SELECT DISTINCT event_type AS source, json_extract_string(props, '$.k') AS id, event_type||CAST(ts AS DATE) AS job_id, day(ts) % 5 = 0 AS inflight, CAST(ts AS DATE) AS created FROM events"


def _refs(t):
    return t.raw("events").selectExpr("event_type AS source", "get_json_object(props, '$.k') AS id", "event_type||CAST(ts AS DATE) AS job_id", "day(ts) % 5 = 0 AS inflight", "CAST(ts AS DATE) AS created")


@query(f"""WITH r AS ({_REFS}), o AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY inflight DESC, created, job_id) AS rn FROM r)
SELECT source, id, job_id FROM o WHERE inflight OR (rn = 1 AND CAST(id AS BIGINT) % 2 = 0)""")
def dedupe_pending(t):
    refs = _refs(t)
    return work.dedupe_pending(refs, refs.where("CAST(id AS BIGINT) % 2 = 0"))


@query(f"""WITH r AS ({_REFS}), i AS (SELECT source, id, (row_number() OVER (PARTITION BY source ORDER BY id) - 1) // 10 AS batch FROM (SELECT DISTINCT source, id FROM r WHERE NOT inflight AND (source, id) NOT IN (SELECT (source, id) FROM r WHERE inflight)))
SELECT source, CAST(batch AS INT) AS batch, count(*) AS n, min(id) AS first_id FROM i GROUP BY ALL""")
def consolidate_jobs(t):
    return work.consolidate_jobs(_refs(t), 10)


@query("""SELECT DISTINCT event_type, user_id, (event_type, user_id) NOT IN (SELECT (event_type, user_id) FROM events WHERE event_id % 4 = 0) AS created FROM events""")
def register_items(t):
    e = t.raw("events")
    return work.register_items(e.where("event_id % 4 = 0"), e, ["event_type", "user_id"])


@query("""WITH j AS (SELECT event_type||day(ts) AS job_id, count(*) AS n, day(ts) % 10 AS attempts, day(ts) % 2 = 0 AS retryable FROM events GROUP BY ALL), s AS (SELECT *, retryable AND n > 1 AS h FROM j)
SELECT job_id, CASE WHEN h THEN 'split' WHEN attempts < 8 THEN 'retry' ELSE 'fail' END AS action, CASE WHEN NOT h AND attempts < 8 THEN [10, 30, 90, 180, 300, 600, 900, 1800][greatest(1, least(attempts, 8))] END AS delay,
CAST(part AS INT) AS part, CAST(CASE WHEN NOT h THEN n WHEN part = 0 THEN n // 2 ELSE n - n // 2 END AS INT) AS n FROM s, (SELECT unnest([0, 1]) AS part) WHERE h OR part = 0""")
def split_retry(t):
    refs = t.raw("events").selectExpr("event_type||day(ts) AS job_id", "event_id AS id", "day(ts) % 10 AS attempts", "day(ts) % 2 = 0 AS retryable")
    return work.split_retry(refs, 8).groupBy("job_id", "action", "delay", "part").agg(F.count("*").cast("int").alias("n"))


@query("""WITH m AS (SELECT event_id, 'Call ' || CASE WHEN user_id % 3 = 0 THEN 'Timed Out' ELSE 'failed' END || ' with ' || (400 + event_id % 110) AS m FROM events)
SELECT event_id, regexp_matches(lower(m), 'timed out| (429|50[0234])') AND NOT regexp_matches(m, ' 40[0134]') AS retryable FROM m""")
def classify_errors(t):
    message = F.expr("'Call ' || CASE WHEN user_id % 3 = 0 THEN 'Timed Out' ELSE 'failed' END || ' with ' || (400 + event_id % 110)")
    return t.raw("events").select("event_id", work.retryable(message).alias("retryable"))


_BACKFILL = """b AS (SELECT user_id AS source, count(*) FILTER (value > 95 AND event_id % 3 = 0) AS entity_vectors, count(*) FILTER (value > 95 AND event_id % 3 = 1) AS event_entity_vectors FROM events GROUP BY 1)
SELECT *, entity_vectors + event_entity_vectors AS pending, CASE WHEN entity_vectors + event_entity_vectors > 0 THEN 'backfilling' ELSE '{}' END AS state FROM b"""


def _backfill(t, deferred):
    items = t.raw("events").selectExpr("user_id AS source", "CASE event_id % 3 WHEN 0 THEN 'entity_vectors' WHEN 1 THEN 'event_entity_vectors' ELSE 'chunk_vectors' END AS table_name", "value > 95 AS pending")
    return work.backfill_status(items, items, deferred)


@query("WITH " + _BACKFILL.format("complete"))
def backfill_status(t):
    return _backfill(t, False)


@query("WITH s AS (WITH " + _BACKFILL.format("deferred") + ") SELECT count(*) AS sources, sum(entity_vectors)::BIGINT AS entity_vectors, sum(event_entity_vectors)::BIGINT AS event_entity_vectors, sum(pending)::BIGINT AS pending, CASE WHEN sum(pending) > 0 THEN 'backfilling' ELSE 'deferred' END AS state FROM s")
def backfill_overall(t):
    return work.backfill_overall(_backfill(t, True))


@query("""SELECT event_type AS source, count(*) FILTER (ts <= TIMESTAMP '2024-01-15' AND ts > TIMESTAMP '2024-01-14') AS recent, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS remaining,
round(count(*) FILTER (ts > TIMESTAMP '2024-01-15') * 1440 / nullif(count(*) FILTER (ts <= TIMESTAMP '2024-01-15' AND ts > TIMESTAMP '2024-01-14'), 0), 3) AS eta FROM events GROUP BY 1""")
def ingest_rates(t):
    return work.ingest_rates(t.raw("events").selectExpr("event_type AS source", "ts"), "2024-01-15 00:00:00", 1440)


_CHANNEL = "SELECT a.vec_id AS query_id, {id} AS id, greatest(0.0, least(1.0, {cos})) AS score FROM embeddings AS a, embeddings AS b WHERE a.vec_id % 100 = 0"


@query(f"""WITH t AS (SELECT * FROM ({_CHANNEL.format(id="b.vec_id", cos=_COS)}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 40),
c AS (SELECT * FROM ({_CHANNEL.format(id="b.vec_id - 1", cos=_COS)}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 40),
m AS (SELECT query_id, id, max(s) AS s, count(*) AS n FROM (SELECT query_id, id, score AS s FROM t UNION ALL SELECT query_id, id, score * 0.95 FROM c) GROUP BY ALL),
z AS (SELECT query_id, id, least(1.0, s + CASE WHEN n = 2 THEN 0.03 ELSE 0 END) AS score FROM m), f AS (SELECT *, greatest(0.2, 0.55 * max(score) OVER (PARTITION BY query_id)) AS floor FROM z)
SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rn FROM f WHERE score >= floor QUALIFY rn <= 10""")
def event_recall(t):
    v = t.raw("embeddings").selectExpr("vec_id AS id", "embedding AS v")
    q = v.where("id % 100 = 0").selectExpr("id AS query_id", "v AS q")
    return recall.event_recall(recall.knn(q, v, 40), recall.knn(q, v.withColumn("id", F.col("id") - 1), 40), 10)


_NAMED = "q AS (SELECT p_partkey AS query_id, lower(p_name) AS text FROM part WHERE p_partkey % 100 = 0)"


@query(f"""WITH FIX, {_NAMED}, s AS (SELECT DISTINCT query_id, entity_id FROM q JOIN en ON normalized_name = text), {_PAIRS},
d AS (SELECT query_id, event_id, sum(weight) AS score FROM p JOIN s USING (entity_id) GROUP BY ALL), r AS (SELECT query_id, entity_id, max(score) / 2 AS score FROM d JOIN p USING (event_id) GROUP BY ALL),
a AS (SELECT query_id, event_id, round(max(score), 6) AS score FROM (SELECT * FROM d UNION ALL SELECT query_id, event_id, score FROM r JOIN p USING (entity_id)) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS INT) AS rn FROM a QUALIFY rn <= 20""")
def hyperedge_search(t):
    queries = t.raw("part").where("p_partkey % 100 = 0").selectExpr("p_partkey AS query_id", "p_name AS text")
    return recall.hyperedge_search(queries, t.entities(), t.relations(), 20)


@query(f"""WITH FIX, {_BM25}, v AS (SELECT * FROM (SELECT item_id AS query_id, 'd'||b.vec_id AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY greatest(0.0, least(1.0, {_COS})) DESC, 'd'||b.vec_id) AS rn FROM benchmark JOIN embeddings AS a ON a.vec_id = item_id * 12, embeddings AS b) WHERE rn <= 3),
p AS (SELECT query_id, chunk_id FROM sc JOIN ch USING (chunk_id) JOIN q USING (query_id) WHERE contains(lower(content), lower(substring(text, 1, 40))))
SELECT query_id, chunk_id, FALSE AS fallback FROM p UNION ALL SELECT query_id, chunk_id, TRUE FROM v WHERE query_id NOT IN (SELECT query_id FROM p)""")
def search_with_fallback(t):
    """All lines that hold the beginning of a query word for word and share a term with it; nearest documents for queries without one."""
    queries = _benchmark_queries(t)
    begun = Scratch(t.spark, "fallback").save(recall.holding(queries.select("query_id", F.substring("text", 1, 40).alias("phrase")), t.chunks()), "begun")
    hits = recall.bm25(queries, t.chunks(), None, begun)
    precise = recall.with_rows(hits, begun, ["query_id", "chunk_id"], sent=False).select("query_id", "chunk_id")
    vectors = t.raw("embeddings").selectExpr("'d'||vec_id AS id", "embedding AS v")
    asked = queries.join(t.raw("embeddings").selectExpr("vec_id", "embedding AS q"), F.col("query_id") * 12 == F.col("vec_id")).select("query_id", "q")
    return recall.search_with_fallback(precise, recall.knn(asked, vectors, 3).select("query_id", F.col("id").alias("chunk_id")))


@query("WITH FIX SELECT source_id, CAST(sum(chunk_count) AS BIGINT) AS chunks, CAST(sum(event_count) AS BIGINT) AS events, max(created_at) AS updated_at FROM doc GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 LIMIT 16")
def candidate_sources(t):
    return recall.candidate_sources(t.documents(), 16)


@query("SELECT page_id, trim(u) AS url FROM (SELECT page_id, unnest(string_split(url || ', ftp://x/y,,' || chr(10) || url || '/a', ',')) AS u FROM pages) WHERE regexp_matches(trim(u, chr(10) || ' '), '^https?://[^/?#]+') AND NOT contains(u, chr(10)) UNION ALL SELECT page_id, url || '/a' FROM pages WHERE regexp_matches(url, '^https?://[^/?#]+')")
def url_list(t):
    rows = t.raw("pages").selectExpr("page_id", "url || ', ftp://x/y,,\\n' || url || '/a' AS config")
    return catalog.url_list(rows, "config")


def _without(tags: list[str]) -> str:
    html = "html"
    for tag in tags:
        html = f"regexp_replace({html}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return html


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace({_without(['script', 'style', 'nav', 'header', 'footer'])}, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM pages")
def html_bodies(t):
    return t.raw("pages").select("page_id", catalog.html_body(F.col("html")).alias("body"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE '# ' || source || chr(10) || chr(10) || coalesce(text, '') END AS text FROM documents")
def text_to_document(t):
    return t.raw("documents").select("doc_id", catalog.text_to_document(F.expr("CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END"), F.col("text")).alias("text"))


@query("SELECT doc_id AS document_id, sha256(CASE WHEN doc_id % 6 = 0 THEN text || '!' ELSE text END) AS sha256, n_chars + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS size_bytes, doc_id % 6 = 0 AS replaced FROM documents")
def publish_revision(t):
    docs = t.raw("documents").selectExpr("doc_id AS document_id", "sha2(text, 256) AS sha256", "n_chars AS size_bytes")
    staged = t.raw("documents").where("doc_id % 2 = 0").selectExpr("doc_id AS document_id", "sha2(text || '!', 256) AS sha256", "n_chars + 1 AS size_bytes", "doc_id % 3 = 0 AS complete")
    return catalog.publish_revision(docs, staged)


@query("SELECT doc_id AS document_id, CASE WHEN doc_id % 7 = 0 OR (doc_id % 2 = 0 AND doc_id % 3 <> 0) THEN 'run' ELSE 'skip' END AS action FROM documents")
def revision_cleanup_guard(t):
    docs = t.raw("documents")
    cleanup = docs.selectExpr("doc_id AS document_id", "CASE WHEN doc_id % 2 = 0 THEN sha2(source, 256) ELSE 'other' END AS new_hash", "'d' || doc_id AS old_derived_id")
    current = docs.where("doc_id % 7 <> 0").selectExpr("doc_id AS document_id", "sha2(source, 256) AS sha256", "CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id ELSE 'e' || doc_id END AS derived_id")
    return catalog.revision_cleanup_guard(cleanup, current)


@query("WITH FIX, i AS (SELECT DISTINCT lpad(CAST(event_id * 3 AS STRING), 10, '0') AS event_id FROM events) SELECT event_id, title, filename FROM i LEFT JOIN ev USING (event_id) LEFT JOIN doc ON document_id = ev.source_id")
def node_detail(t):
    ids = t.raw("events").selectExpr("lpad(CAST(event_id * 3 AS STRING), 10, '0') AS event_id").distinct()
    return explore.node_detail(ids, t.events(), t.documents())


@query("""SELECT c_nationkey AS owner, c_custkey AS session_id, coalesce(n, 0) AS steps, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rn FROM customer QUALIFY rn <= 20)
LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = c_custkey""")
def exploration_list(t):
    return explore.exploration_list(t.raw("customer").selectExpr("c_nationkey AS owner", "c_custkey AS session_id", "c_acctbal AS updated_at"), t.raw("conversations").withColumnRenamed("conv_id", "session_id"))


@query("""WITH FIX, s AS (SELECT DISTINCT user_id AS query_id, lpad(CAST(event_id AS STRING), 10, '0') AS event_id FROM events),
r AS (SELECT query_id, event_id, entity_id, id, name FROM ee JOIN s USING (event_id) JOIN (SELECT DISTINCT entity_id, name FROM en) USING (entity_id)),
h AS (SELECT query_id, entity_id, count(*) AS heat FROM r GROUP BY query_id, entity_id, name QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, name, entity_id) <= 12)
SELECT query_id, event_id, entity_id, id, heat FROM r JOIN h USING (query_id, entity_id)""")
def section_relations(t):
    scored = t.raw("events").selectExpr("user_id AS query_id", "lpad(CAST(event_id AS STRING), 10, '0') AS event_id")
    return explore.section_relations(scored, t.relations(), t.entities(), 12)


@query("WITH FIX SELECT source_config_id, chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'raw '||content ELSE content END AS content FROM ch WHERE rank = 1 AND doc_id IN (SELECT event_id * 2 FROM events)")
def get_chunks(t):
    ids = t.raw("events").selectExpr("event_id * 2 AS doc_id").join(t.raw("documents").select("doc_id", F.col("source").alias("source_config_id")), "doc_id")
    chunks = t.chunks().withColumn("raw_content", F.expr("'raw '||content")).withColumn("content", F.expr("CASE doc_id % 6 WHEN 0 THEN NULL WHEN 3 THEN '' ELSE content END"))
    return explore.get_chunks(ids.selectExpr("source_config_id", "doc_id||'-1' AS chunk_id"), chunks).select("source_config_id", "chunk_id", "content")


@query(None)
def cover_entities(t):
    """No SQL: every choice depends on the ones before; tested against brute force."""
    from ..operators import graph

    slice_ = graph.slice_events(t.events(), t.relations(), 60).select("source_config_id", "event_id")
    assoc = graph.slice_associations(t.relations().join(slice_.select("event_id"), "event_id", "left_semi"))
    return explore.cover_entities(assoc.join(slice_, "event_id").join(t.entities().select("entity_id", "name").distinct(), "entity_id"), 40)


@query(None)
def assemble_chunks(t):
    """No SQL: a greedy fold over the blocks of a document; tested on fixtures."""
    return chunking.assemble_chunks(t.raw("documents"))


@query("""WITH FIX, p AS (SELECT 'c'||c_custkey||'-'||k AS chunk_id, (k + 1) % 3 AS place FROM customer, (SELECT unnest([0, 1]) AS k))
SELECT event_id, source_id AS document_id, row_number() OVER (PARTITION BY source_id ORDER BY place NULLS LAST, rank, event_id) - 1 AS rank FROM ev LEFT JOIN p USING (chunk_id)""")
def chunk_document_rank(t):
    chunks = t.raw("customer").selectExpr("c_custkey", "explode(array(0, 1)) AS k").selectExpr("'c'||c_custkey||'-'||k AS chunk_id", "(k + 1) % 3 AS place")
    return catalog.chunk_document_rank(t.events().withColumnRenamed("source_id", "document_id"), chunks).select("event_id", "document_id", "rank")


@query("""WITH FIX SELECT 'documents' AS table_name, status, count(*) AS n_rows FROM doc GROUP BY status UNION ALL SELECT 'events', status, count(*) FROM ev GROUP BY status
UNION ALL SELECT 'relations', NULL, count(*) FROM ee""")
def table_profile(t):
    return catalog.table_profile({"documents": (t.documents(), "status"), "events": (t.events(), "status"), "relations": (t.relations(), None)})


_TYPED = "CASE rank % 3 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' END AS chunk_type"


@query(f"WITH FIX SELECT * FROM (SELECT chunk_id, {_TYPED} FROM ch) WHERE chunk_type IS NULL OR chunk_type <> 'parent'")
def vectorizable_chunks(t):
    return catalog.vectorizable_chunks(t.chunks().selectExpr("chunk_id", _TYPED), include_parents=False)


@query("""WITH FIX, s AS (SELECT doc_id AS query_id, CAST(rank + 1 AS BIGINT) AS position FROM ch), a AS (SELECT DISTINCT doc_id AS query_id, regexp_extract_all(md5(CAST(doc_id AS STRING)), '[0-9]+') AS l FROM documents),
n AS (SELECT query_id, i, TRY_CAST(l[i] AS BIGINT) AS position FROM (SELECT query_id, l, unnest(range(1, len(l) + 1)) AS i FROM a)), f AS (SELECT query_id, position, min(i) AS spot FROM n GROUP BY 1, 2)
SELECT query_id, position, row_number() OVER (PARTITION BY query_id ORDER BY spot NULLS LAST, position) AS place FROM s LEFT JOIN f USING (query_id, position)""")
def rerank_by_listing(t):
    answers = t.raw("documents").selectExpr("doc_id AS query_id", "md5(CAST(doc_id AS STRING)) AS answer").distinct()
    return relevance.rerank_by_listing(t.chunks().selectExpr("doc_id AS query_id", "CAST(rank + 1 AS BIGINT) AS position"), answers)
