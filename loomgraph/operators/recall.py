"""Recall: nearest neighbours, BM25, literal search, query terms, merging of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch
from .ranking import K1, B, best_by_cosine, best_of_rows

QUERY_LIMIT = 1000  # queries up to which knn sends them to every executor; beyond it they go in groups
VISIBLE = "(status IS NULL OR status <> 'DELETED')"  # events
LIVE = "(is_delete IS NULL OR is_delete = FALSE)"  # relations


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first k rows of each key; the row number stays as ``name``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def numbered(df: DataFrame, key: str, order: str, ranges: int = 64) -> DataFrame:
    """``df`` with ``place``, from 0, of each row among those of its key by the column ``order``, which is unique in a key.

    A key is cut into ranges at the values of smallest hash, so that no task holds a whole key; a place is the rows of the ranges before and
    those before it in its own. Rows with a null key or order drop out.
    """
    cuts = top(df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, order), [key], [F.xxhash64(order), F.col(order)], ranges - 1)
    parts = df.join(cuts.groupBy(key).agg(F.sort_array(F.collect_list(order)).alias("_cuts")), key)
    parts = parts.where(F.col(order).isNotNull()).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(key, "_part").agg(F.count("*").alias("_n")).select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)) - 1
    return parts.withColumn("place", inside).join(starts, [key, "_part"]).withColumn("place", F.col("place") + F.col("_start")).drop("_part", "_start")


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k of ``vectors(id, v)`` for each of ``queries(query_id, q)``; score clamped to [0, 1], ties by id.

    Queries with a ``source_config_id`` meet only vectors of that source. Ids are unique; ``merge_sources`` joins results of several tables.
    Only k rows per query and task are shuffled. Null, zero and unequal vectors drop out, and those with a component that is null or not finite.
    """
    fine = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    source = [c for c in queries.columns if c == "source_config_id"]
    q = queries.select("query_id", *[F.col(c).alias("_own") for c in source], F.col("q").cast("array<double>").alias("q")).where(fine("q")).withColumn("qn", F.sqrt(dot("q", "q"))).where("qn > 0")
    v = vectors.select("id", *source, F.col("v").cast("array<double>").alias("v")).where(fine("v")).withColumn("vn", F.sqrt(dot("v", "v"))).where("vn > 0")
    q = q.withColumnsRenamed({"_own": "source_config_id"})
    out = near_in_groups(q, v, k, source[0] if source else None)
    return top(out, ["query_id"], [F.desc("score"), F.col("id")], k)


def near_in_groups(q: DataFrame, v: DataFrame, k: int, group: str | None) -> DataFrame:
    """``best_by_cosine`` for some QUERY_LIMIT queries at a time."""
    parts, out = max(1, -(-q.select("query_id").distinct().count() // QUERY_LIMIT)), None
    for part in range(parts):
        own = q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        found = best_by_cosine(v, own, k, group)
        out = found if out is None else out.unionByName(found)
    return out


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def bm25(queries: DataFrame, chunks: DataFrame, k: int | None, only: DataFrame | None = None) -> DataFrame:
    """BM25 top-k of ``chunks(chunk_id, content)`` for ``queries(query_id, text)``; score/2 clamped to [0, 1], ties by chunk_id.

    For a single batch of queries: only their terms take part, and what is shuffled grows with the words of chunks whose id repeats, not with pairs of queries and
    chunks. Rows of one id add up. ``search.bm25_index`` keeps postings for several. With k None all chunks that share a term with a query are scored, without rn; the pairs
    ``only(query_id, chunk_id)`` can be named then, and statistics are still those of all chunks.
    """
    if only is not None and k is not None:
        raise ValueError("pairs are scored without a limit")
    scratch = Scratch(chunks.sparkSession, "bm25")
    wanted = scratch.save(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")), "wanted")
    n, tokens = chunks.agg(F.count("*"), F.sum(F.regexp_count(F.lower(F.coalesce("content", F.lit(""))), F.lit("[a-z0-9]+")))).first()
    repeated = scratch.save(chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id"), "repeated")
    words = chunks.select("chunk_id", terms(F.coalesce("content", F.lit(""))).alias("w")).select("chunk_id", F.size("w").alias("dl"), "w")
    single = words.join(repeated, "chunk_id", "left_anti")
    tf = words.join(repeated, "chunk_id", "left_semi").select("chunk_id", "dl", F.explode("w").alias("term"))
    own = F.broadcast(wanted.select("term").distinct())
    tf = tf.join(own, "term", "left_semi").groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = single.select(F.explode(F.array_distinct("w")).alias("term")).join(own, "term", "left_semi").unionByName(tf.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    avgdl = F.lit(float((tokens or 0) / (n or 1)) or 1.0)
    weights = scratch.save(wanted.join(df, "term").select("query_id", "term", idf.alias("idf"), avgdl.alias("avgdl")), "weights")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    if k is None:
        some = words if only is None else words.join(only.select("chunk_id").distinct(), "chunk_id", "left_semi")
        tf = some.select("chunk_id", "dl", F.explode("w").alias("term")).join(own, "term", "left_semi").groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
        met = tf.join(F.broadcast(weights), "term")
        met = met if only is None else met.join(only.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
        return met.groupBy("query_id", "chunk_id").agg(F.least(F.lit(1.0), F.sum(part) / 2).alias("score"))
    scored = tf.join(F.broadcast(weights), "term").groupBy("query_id", "chunk_id").agg((F.sum(part) / 2).alias("raw"))
    scored = scored.unionByName(best_of_rows(single, weights, k))
    return top(scored, ["query_id"], [F.desc(F.round("raw", 9)), F.col("chunk_id")], k).select("query_id", "chunk_id", F.least(F.lit(1.0), "raw").alias("score"), "rn")


def with_rows(found: DataFrame, rows: DataFrame, key: str | list[str] = "chunk_id", sent: bool = True) -> DataFrame:
    """``found``, k rows a query, with the columns of ``rows`` of the same key; the found ones are sent to the rows, which are not shuffled. Without ``sent`` there may be any number."""
    return rows.join(F.broadcast(found) if sent else found, key)


def holding(phrases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of ``phrases(query_id, phrase)`` and the rows of ``chunks(chunk_id, content)`` that hold the phrase word for word, in any case.

    The longest of a phrase's words that end within it leads to the chunks with that word; phrases without one are compared with all chunks. Phrases are sent to the chunks,
    which are not shuffled.
    """
    scratch = Scratch(chunks.sparkSession, "phrases")
    asked = scratch.save(phrases.select("query_id", F.lower("phrase").alias("phrase")).where("phrase IS NOT NULL"), "asked")
    inner = F.regexp_extract_all("phrase", F.lit("(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])"), 0)
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    sent = scratch.save(asked.select("phrase").distinct().withColumn("word", longest), "sent")
    rows = chunks.select("chunk_id", F.lower("content").alias("low"))
    by_word = rows.withColumn("word", F.explode(F.array_distinct(terms(F.col("low"))))).join(F.broadcast(sent.where("word IS NOT NULL")), "word").where(F.contains(F.col("low"), F.col("phrase")))
    rest = rows.join(F.broadcast(sent.where("word IS NULL")), F.contains(F.col("low"), F.col("phrase")))
    found = by_word.select("phrase", "chunk_id").unionByName(rest.select("phrase", "chunk_id"))
    return found.join(asked, "phrase").select("query_id", "chunk_id")


def grep(patterns: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Case-insensitive literal hits of ``patterns(pattern)`` in chunks: count of non-overlapping hits, most first, then rank and id. Blank patterns find nothing."""
    patterns = patterns.where("trim(pattern) <> ''")
    low, p = F.lower("content"), F.lower("pattern")
    found = chunks.join(F.broadcast(patterns), F.contains(low, p))
    hits = ((F.length(low) - F.length(F.replace(low, p, F.lit("")))) / F.length(p)).cast("int")
    return top(found.select("pattern", "chunk_id", "rank", hits.alias("hits")), ["pattern"], [F.desc("hits"), F.col("rank"), F.col("chunk_id")], limit)


def grep_snippets(patterns: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Literal hits with where to look: ``chunks(chunk_id, rank, heading, content)`` by number of hits, best position (last first), rank and id.

    Only the first max(4 limit, limit + 12) chunks by rank of a pattern take part. The best position is the first of those whose surroundings
    have most CJK characters and fewest addresses and links; the snippet begins at the last date in the 500 characters before it, else 80
    before it, and ends 700 after it, links flattened. The heading is the first line of 2 to 160 characters with the pattern.
    """
    patterns = patterns.where("trim(pattern) <> ''").withColumn("_p", F.lower("pattern"))
    found = chunks.select("chunk_id", "rank", "heading", "content").join(F.broadcast(patterns), F.contains(F.lower("content"), F.col("_p")))
    rows = top(found, ["pattern"], [F.col("rank"), F.col("chunk_id")], max(4 * limit, limit + 12), "_c").drop("_c")
    quoted = F.concat(F.lit("\\Q"), F.replace("_p", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    rows = rows.withColumn("_s", F.split(F.lower("content"), quoted, -1))
    at = F.transform(F.sequence(F.lit(1), F.size("_s") - 1), lambda k: F.length(F.array_join(F.slice("_s", 1, k), "\0")) + (k - 1) * (F.length("_p") - 1))
    times = lambda w, x: (F.length(w) - F.length(F.replace(w, F.lit(x)))) / len(x)

    def quality(p: Column) -> Column:
        lo = F.greatest(F.lit(0), p - 40)
        w = F.substr("content", lo + 1, p + 700 - lo)
        return F.length(F.regexp_replace(w, "[^\\x{3400}-\\x{9FFF}]", "")) - 40 * times(w, "http") - 15 * times(w, "](")

    rows = rows.withColumn("_at", at).withColumn("hits", F.size("_at"))
    rows = rows.withColumn("best", -F.array_max(F.transform("_at", lambda p: F.struct(quality(p).alias("q"), (-p).alias("p"))))["p"])
    lo = F.greatest(F.lit(0), F.col("best") - 500)
    dated = F.regexp_extract(F.substr("content", lo + 1, F.col("best") - lo), r"(?s)^(.*)20\d{2}(?:年\d{1,2}月\d{1,2}日|[-/]\d{1,2}[-/]\d{1,2})", 0)
    ahead = F.length(F.regexp_extract(F.substr("content", lo + 1, F.col("best") - lo), r"(?s)^(.*)20\d{2}(?:年\d{1,2}月\d{1,2}日|[-/]\d{1,2}[-/]\d{1,2})", 1))
    start = F.when(dated != "", lo + ahead).otherwise(F.greatest(F.lit(0), F.col("best") - 80))
    flat = lambda c: F.regexp_replace(F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]+)\]\([^)]*\)", "$1")
    snippet = F.trim(F.regexp_replace(flat(F.substr("content", start + 1, F.col("best") + 700 - start)), "[ \\t]+", " "))
    bare = lambda c: F.trim(F.ltrim(F.regexp_replace(F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]+)\]\([^)]*\)", "$1"), F.lit("#* -")))
    lines = F.filter(F.transform(F.split("content", "\n"), bare), lambda c: F.contains(F.lower(c), F.col("_p")) & F.length(c).between(2, 160))
    rows = rows.withColumn("snippet", snippet).withColumn("heading", F.coalesce(F.get(lines, F.lit(0)), F.trim(F.coalesce("heading", F.lit("")))))
    kept = top(rows, ["pattern"], [F.desc("hits"), F.desc("best"), F.col("rank"), F.col("chunk_id")], limit)
    return kept.select("pattern", "chunk_id", "hits", "best", "heading", "snippet", "rn")


def merge_sources(results: DataFrame, k: int) -> DataFrame:
    """Best score per (query, source, chunk), then the top k of a query; rows without a chunk id are each their own, after others of their score and source."""
    named = F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) != ""
    best = results.where(named).groupBy("query_id", "source_config_id", "chunk_id").agg(F.max("score").alias("score"))
    best = best.unionByName(results.where(~named).select(*best.columns))
    return top(best, ["query_id"], [F.desc("score"), F.asc_nulls_last("source_config_id"), F.asc_nulls_last("chunk_id")], k)


def normalize_text(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and U+3400 to U+9FFF."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\\x{3400}-\\x{9FFF}]", "")


def estimate_tokens(text: Column) -> Column:
    """CJK characters count one, the others a quarter, rounded up."""
    other = F.length(F.regexp_replace(text, "[\\x{3000}-\\x{9FFF}\\x{F900}-\\x{FAFF}]", ""))
    return (F.length(text) - other + F.ceil(other / 4)).cast("int")


def fuse(rows: DataFrame, k: int) -> DataFrame:
    """Fused ranking of ``rows(query_id, key, raw, lex, exact, pos)`` with the relevance gate.

    combined = min(1, .5 raw + .2 rank score + .3 lex + .15 exact); if any candidate of a query has a lexical signal (exact, or lex of
    .2 or more) only those stay, else those with raw of at least max(.35, .68 best).
    """
    one = rows.groupBy("query_id", "key").agg(F.max("raw").alias("raw"), F.max("lex").alias("lex"), F.max("exact").alias("exact"), F.min("pos").alias("pos"))
    q = Window.partitionBy("query_id")
    one = one.withColumn("p", F.row_number().over(q.orderBy("pos", "key")) - 1).withColumn("n", F.count("*").over(q))
    one = one.withColumn("rank_score", 1 - F.col("p") / F.greatest(F.lit(1), F.col("n") - 1)).withColumn("signal", (F.col("exact") == 1) | (F.col("lex") >= 0.2))
    one = one.withColumn("combined", F.least(F.lit(1.0), 0.5 * F.col("raw") + 0.2 * F.col("rank_score") + 0.3 * F.col("lex") + 0.15 * F.col("exact")))
    kept = one.withColumn("any", F.max("signal").over(q)).withColumn("best", F.max("raw").over(q))
    kept = kept.where(F.when(F.col("any"), F.col("signal")).otherwise(F.col("raw") >= F.greatest(F.lit(0.35), 0.68 * F.col("best"))))
    return top(kept, ["query_id"], [F.desc(F.round("combined", 9)), F.desc("raw"), F.col("pos"), F.col("key")], k).select("query_id", "key", F.round("combined", 6).alias("combined"), "rn")


def event_recall(title: DataFrame, content: DataFrame, limit: int) -> DataFrame:
    """Events from neighbours by title (weight 1) and content (weight .95) of ``(query_id, id, score)``.

    The better channel counts, both together add .03; what lies below max(.2, .55 best) of its query goes.
    """
    both = title.select("query_id", "id", F.col("score").alias("s"), F.lit(1).alias("bit")).unionByName(content.select("query_id", "id", (F.col("score") * 0.95).alias("s"), F.lit(2).alias("bit")))
    best = both.groupBy("query_id", "id").agg(F.max("s").alias("s"), F.bit_or("bit").alias("bits"))
    scored = best.withColumn("score", F.least(F.lit(1.0), F.col("s") + F.when(F.col("bits") == 3, 0.03).otherwise(0.0)))
    floor = F.greatest(F.lit(0.2), 0.55 * F.max("score").over(Window.partitionBy("query_id")))
    kept = scored.withColumn("floor", floor).where("score >= floor")
    return top(kept, ["query_id"], [F.desc("score"), F.col("id")], limit).select("query_id", "id", F.round("score", 6).alias("score"), "rn")


def search_with_fallback(precise: DataFrame, vector: DataFrame) -> DataFrame:
    """Precise rows; vector rows of the queries that have none."""
    rest = vector.join(precise.select("query_id").distinct(), "query_id", "left_anti")
    return precise.withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True)))


def hyperedge_search(queries: DataFrame, entities: DataFrame, relations: DataFrame, k: int) -> DataFrame:
    """Events of the entities that ``queries(query_id, text)`` name, then events one shared entity away at half the score.

    All events reached through one entity score alike, so the k of smallest id are all that can be among the k best, whatever the
    number of an entity's events; and only events of twice the k-th best score or more can lead to one among them. Queries of the same text are searched once.
    """
    scratch = Scratch(queries.sparkSession, "hyperedges")
    asked = scratch.save(queries.select("query_id", F.lower("text").alias("normalized_name")).where("normalized_name IS NOT NULL").distinct(), "asked")
    texts = asked.select("normalized_name").distinct()
    named = scratch.save(entities.join(texts, "normalized_name", "left_semi").select("normalized_name", "entity_id").distinct(), "named")
    links = scratch.save(relations.groupBy("event_id", "entity_id").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("w")), "links")
    direct = scratch.save(links.join(named, "entity_id").groupBy("normalized_name", "event_id").agg(F.sum("w").alias("score")), "direct")
    floors = top(direct, ["normalized_name"], [F.desc("score")], k).where(F.col("rn") == k).select("normalized_name", F.col("score").alias("floor"))
    leading = direct.join(floors, "normalized_name", "left").where("floor IS NULL OR score / 2 >= floor - 1e-5").drop("floor")  # scores are rounded to six digits
    leading = scratch.save(leading, "leading")
    led = scratch.save(leading.join(links, "event_id").groupBy("normalized_name", "entity_id").agg((F.max("score") / 2).alias("score")), "led")
    some = top(links.join(led.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "event_id"), ["entity_id"], [F.col("event_id")], k).drop("rn")
    near = led.join(some, "entity_id").select("normalized_name", "event_id", "score")
    found = direct.unionByName(near).groupBy("normalized_name", "event_id").agg(F.round(F.max("score"), 6).alias("score"))
    best = top(found, ["normalized_name"], [F.desc("score"), F.col("event_id")], k)
    return asked.join(best, "normalized_name").select("query_id", "event_id", "score", "rn")


def candidate_sources(documents: DataFrame, k: int) -> DataFrame:
    """The k sources with most chunks, then most events, then the latest document, then by id."""
    sums = documents.groupBy("source_id").agg(F.sum("chunk_count").alias("chunks"), F.sum("event_count").alias("events"), F.max("created_at").alias("updated_at"))
    return sums.orderBy(F.desc("chunks"), F.desc("events"), F.desc("updated_at"), "source_id").limit(k)


def requested_sources(requests: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Known sources of ``requests(query_id, source_ids)`` in the order asked for, repeats once; more than k of a request are one row with an error."""
    asked = requests.select("query_id", F.array_distinct("source_ids").alias("ids"))
    many = asked.where(F.size("ids") > k).select("query_id", F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("int").alias("place"), F.lit("too_many_sources").alias("error"))
    found = asked.where(F.size("ids") <= k).select("query_id", F.posexplode("ids").alias("place", "source_id")).join(sources.select("source_id").distinct(), "source_id", "left_semi")
    return found.select("query_id", "source_id", "place", F.lit(None).cast("string").alias("error")).unionByName(many)
