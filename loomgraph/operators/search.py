"""Hybrid search: a stored BM25 index, an inverted-file vector index, channels, fusion with contents, context of hits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import K1, B
from .recall import bm25, dot, knn, near_in_groups, normalize_text, terms, top, with_rows
from ..storage import Scratch
from .relevance import is_boilerplate, lexical_relevance, query_terms
from .stored import Postings

TERM_BUCKETS = 64  # folders of a stored index; a query reads those of its terms
ONE = ["query_id", "source_config_id", "chunk_id", "heading", "content", "score", "pos"]  # columns of sections


def bm25_index(chunks: DataFrame) -> DataFrame:
    """Postings (term, chunk_id, part) of ``chunks(chunk_id, content)``; ``part`` is what the term adds to a score, whatever the query.

    Null content has no terms. Repeated chunk ids are chunks of their own. An empty table has no postings.
    """
    words = chunks.select("chunk_id", terms(F.coalesce("content", F.lit(""))).alias("w"))
    whole = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))  # one row
    tf = words.select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(whole))
    idf = F.log(1 + (F.col("n").cast("double") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(df, "term").select("term", "chunk_id", part.alias("part"))


def write_index(chunks: DataFrame, path: str, now: str) -> None:
    """Stores the postings by buckets of terms, and a row about the index (rows, built_at)."""
    postings = bm25_index(chunks).withColumn("bucket", _bucket(F.col("term")))
    postings.repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    chunks.agg(F.count("*").alias("rows")).withColumn("built_at", F.lit(now).cast("timestamp")).write.mode("overwrite").parquet(f"{path}/meta")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings")


def index_stale(meta: DataFrame, rows: DataFrame) -> DataFrame:
    """Per index of ``meta(name, indexed, built_at)`` and ``rows(name, rows, now)``: stale if a tenth has been added or half an hour has passed."""
    both = meta.join(rows, "name", "left")
    old = F.unix_timestamp("now") - F.unix_timestamp("built_at") > 1800
    return both.select("name", F.coalesce((F.col("rows") > 1.1 * F.col("indexed")) | old, F.lit(True)).alias("stale"))


def bm25_search(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """BM25 top-k of an index for ``queries(query_id, text)``; score/2 clamped to [0, 1], ties by chunk_id. Stored buckets are pruned."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term"))
    keys = ["term"]
    if "bucket" in postings.columns:
        wanted, keys = wanted.withColumn("bucket", _bucket(F.col("term"))), ["bucket", "term"]
    scored = postings.join(wanted, keys).groupBy("query_id", "chunk_id").agg((F.sum("part") / 2).alias("raw"))
    return top(scored, ["query_id"], [F.desc(F.round("raw", 9)), F.col("chunk_id")], k).select("query_id", "chunk_id", F.least(F.lit(1.0), "raw").alias("score"), "rn")


def ivf_index(vectors: DataFrame, cells: int, path: str, sample: int = 100_000, seed: int = 1) -> None:
    """Stores ``vectors(id, v)`` by the cell of their nearest centroid; k-means runs on at most about ``sample`` of them, all are stored."""
    unit = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where(F.forall("v", _finite) & (dot("v", "v") > 0))
    unit = unit.withColumn("u", array_to_vector(F.transform("v", lambda x: x / F.sqrt(dot("v", "v")))))
    share = min(1.0, sample / max(unit.count(), 1))
    model = KMeans(k=cells, seed=seed, featuresCol="u", predictionCol="cell", maxIter=15).fit(unit.sample(share, seed) if share < 1 else unit)
    spark = vectors.sparkSession
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, center array<double>").write.mode("overwrite").parquet(f"{path}/centers")
    model.transform(unit).select("id", "v", "cell").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ann(queries: DataFrame, path: str, k: int, nprobes: int = 16) -> DataFrame:
    """Approximate cosine top-k: the ``nprobes`` nearest cells of each query are read, and their vectors scored exactly."""
    spark = queries.sparkSession
    q = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where(F.forall("q", _finite) & (dot("q", "q") > 0))
    near = q.crossJoin(F.broadcast(spark.read.parquet(f"{path}/centers")))  # one row per cell
    near = top(near, ["query_id"], [F.desc(dot("q", "center")), F.col("cell")], nprobes).select("query_id", "q", "cell")
    near = Scratch(spark, "ann").save(near.withColumn("qn", F.sqrt(dot("q", "q"))), "near")  # nprobes rows a query
    cells = spark.read.parquet(f"{path}/cells").withColumn("vn", F.sqrt(dot("v", "v")))
    return top(near_in_groups(near, cells, k, "cell"), ["query_id"], [F.desc("score"), F.col("id")], k)


PIECE = 256  # sections of a query that are scored together
LITERALS = 10_000  # literal terms up to which all are sent to every task; beyond them texts and terms meet by pairs of characters


def _containing(chunks: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """(term, *by, chunk_id, rank, hits) of chunks whose text contains a term of ``asked(term, *by)``, in any case of letters."""
    asked = Scratch(chunks.sparkSession, "literal").save(asked.distinct(), "asked")
    low = F.lower("content")
    hits = ((F.length(low) - F.length(F.replace(low, "term", F.lit("")))) / F.length("term")).alias("hits")
    rows = chunks.select("chunk_id", "rank", "content", *by)
    if asked.count() <= LITERALS:
        sent = asked.select("term", *[F.col(c).alias(f"_{c}") for c in by])
        same = [F.col(c) == F.col(f"_{c}") for c in by]
        found = rows.join(F.broadcast(sent), reduce(lambda x, y: x & y, same, F.contains(low, F.col("term")))).drop(*[f"_{c}" for c in by])
    else:
        pairs = F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substr(low, i, F.lit(2)))
        cut = rows.where(F.length("content") > 1).withColumn("_two", F.explode(F.array_distinct(pairs)))
        found = cut.join(asked.withColumn("_two", F.substring("term", 1, 2)), ["_two", *by]).where(F.contains(low, F.col("term")))
    return found.select("term", *by, "chunk_id", "rank", hits)


def lexical_channel(queries: DataFrame, postings: DataFrame | Postings | None, chunks: DataFrame, k: int, sources: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rn): BM25; queries without any hit look for each of their terms literally, two chunks a term.

    Without postings the chunks are scored as they are, in two passes. A stored index may be searched within ``sources(query_id, source_config_id)``; the literal search keeps to them as well.
    """
    if isinstance(postings, Postings):
        found = postings.search(queries, k, sources).drop("source_config_id")
    elif sources is not None:
        raise ValueError("a search within sources needs a stored index")
    elif postings is None:
        found = bm25(queries, chunks, k)
    else:
        found = bm25_search(queries, postings, k)
    found = Scratch(chunks.sparkSession, "channel").save(found, "found")  # k rows a query, read twice
    rest = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    asked, by = rest.select("query_id", F.posexplode(query_terms(F.col("text"))).alias("i", "term")), []
    if sources is not None:
        asked, by = asked.join(sources.select("query_id", "source_config_id").distinct(), "query_id"), ["source_config_id"]
    # The same term is looked for once.
    order = [F.desc("hits"), F.col("rank"), F.col("chunk_id")]
    hits = top(_containing(chunks, asked.select("term", *by), by), ["term", *by], order, 2).drop("rn")
    more = top(asked.join(hits, ["term", *by]), ["query_id", "term"], order, 2)
    more = more.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy("i", "rn")) - 1)
    more = more.groupBy("query_id", "chunk_id").agg(F.min("order").alias("order"))
    more = more.select("query_id", "chunk_id", F.greatest(F.lit(0.8), 1 - 0.02 * F.col("order")).alias("score"), "order")
    more = more.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("order", "chunk_id"))).where(F.col("rn") <= k)
    return found.unionByName(more.drop("order"))


def section_key(source: Column, chunk_id: Column, heading: Column, content: Column) -> Column:
    """Source and chunk id; without an id, the source and the first 240 characters of the normalized text."""
    text = F.substring(normalize_text(F.concat(F.coalesce(heading, F.lit("")), F.coalesce(content, F.lit("")))), 1, 240)
    return F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(F.nullif(chunk_id, F.lit("")), F.concat(F.lit("text:"), text)))


def fuse_sections(queries: DataFrame, semantic: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Fused sections of two channels (columns ONE), with the relevance gate, and per query n_candidates, n_relevant and has_more.

    A section of both channels counts once: its longest content (the first on ties), its best score, its first place. Sections of the lexical
    channel are exact. Boilerplate goes unless exact or of lexical relevance .35. If any section of a query has a lexical signal only those
    stay, else those of at least max(.35, .68 best). Queries without sections have no rows.
    """
    rows = semantic.select(*ONE, F.lit(0).alias("exact")).unionByName(lexical.select(*ONE[:-1], (F.col("pos") + 1_000_000).alias("pos"), F.lit(1).alias("exact")))
    rows = rows.withColumn("key", section_key(F.col("source_config_id"), F.col("chunk_id"), F.col("heading"), F.col("content")))
    content = F.max_by(F.struct("source_config_id", "chunk_id", "heading", "content"), F.struct(F.length(F.coalesce("content", F.lit(""))), -F.col("pos"))).alias("s")
    one = rows.groupBy("query_id", "key").agg(content, F.max("score").alias("raw"), F.max("exact").alias("in_lexical"), F.min("pos").alias("pos")).select("query_id", "key", "s.*", "raw", "in_lexical", "pos")
    q = Window.partitionBy("query_id")
    one = one.withColumn("n_candidates", F.count("*").over(q)).withColumn("p", F.row_number().over(q.orderBy("pos", "key")) - 1)
    one = lexical_relevance(one.join(queries.select("query_id", "text"), "query_id")).drop("exact", "text")
    one = one.where(~is_boilerplate(F.col("heading"), F.col("content")) | (F.col("in_lexical") == 1) | (F.col("lex") >= 0.35))
    place = 1 - F.col("p") / F.greatest(F.lit(1), F.col("n_candidates") - 1)
    one = one.withColumn("combined", F.least(F.lit(1.0), 0.5 * F.col("raw") + 0.2 * place + 0.3 * F.col("lex") + 0.15 * F.col("in_lexical")))
    one = one.withColumn("signal", (F.col("in_lexical") == 1) | (F.col("lex") >= 0.2)).withColumn("any", F.max("signal").over(q)).withColumn("best", F.max("raw").over(q))
    kept = one.where(F.when(F.col("any"), F.col("signal")).otherwise(F.col("raw") >= F.greatest(F.lit(0.35), 0.68 * F.col("best"))))
    kept = kept.withColumn("n_relevant", F.count("*").over(q))
    kept = top(kept, ["query_id"], [F.desc(F.round("combined", 9)), F.desc("raw"), F.col("pos"), F.col("key")], k)
    return kept.select("query_id", "source_config_id", "chunk_id", "heading", "content", F.round("combined", 6).alias("score"), F.col("rn").alias("pos"), "n_candidates", "n_relevant", (F.col("n_relevant") > k).alias("has_more"))


def rerank(sections: DataFrame, queries: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Sections in the order of ``scorer(texts, contents)``; without a score last, equal scores in the order before.

    Each query's sections, of which a search returns some fifty at most, are scored together, more than PIECE of them in pieces by ``pos``: if the scorer fails on them
    or returns another number of scores they all keep their order, whatever happens to other queries. A single section is not scored. ``place`` counts from 1.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        found, failed = [0.0] * len(f), False
        if f.n.iloc[0] > 1:
            try:
                made = [float("-inf") if s is None or s != s else float(s) for s in scorer(f.text, f.content)]
                found, failed = (made, False) if len(made) == len(f) else (found, True)
            except Exception:  # noqa: BLE001  any failure of a model keeps the order
                failed = True
        return f[["query_id", "pos"]].assign(model=found, failed=failed)

    sizes = sections.groupBy("query_id").agg(F.count("*").alias("n"))
    asked = sections.join(queries.select("query_id", "text").join(sizes, "query_id"), "query_id")
    asked = asked.select("query_id", "pos", "text", "content", "n", F.floor(F.col("pos") / PIECE).alias("piece"))
    kinds = asked.schema
    scores = asked.groupBy("query_id", "piece").applyInPandas(run, f"query_id {kinds['query_id'].dataType.simpleString()}, pos {kinds['pos'].dataType.simpleString()}, model double, failed boolean")
    whole = Window.partitionBy("query_id")
    scores = scores.withColumn("model", F.when(F.max("failed").over(whole), 0.0).otherwise(F.col("model")))
    places = scores.withColumn("place", F.row_number().over(whole.orderBy(F.desc("model"), "pos"))).select("query_id", "pos", "place")
    return sections.join(places, ["query_id", "pos"])


def parent_context(sections: DataFrame, chunks: DataFrame, include_code: bool = True) -> DataFrame:
    """A child takes its parent's heading and content and keeps its id; a child whose parent is a hit of its query goes; others stay.

    ``chunks(source_config_id, chunk_id, heading, content, chunk_type, parent_id)``.
    """
    kinds = ["child", "code_child"] if include_code else ["child"]
    marks = chunks.where(F.col("chunk_type").isin(kinds) & F.col("parent_id").isNotNull()).select("source_config_id", "chunk_id", "parent_id")
    parents = chunks.select("source_config_id", F.col("chunk_id").alias("parent_id"), F.col("heading").alias("p_heading"), F.col("content").alias("p_content"), F.lit(True).alias("known"))
    hits = sections.select("query_id", "source_config_id", F.col("chunk_id").alias("parent_id"), F.lit(True).alias("hit")).distinct()
    rows = sections.join(marks, ["source_config_id", "chunk_id"], "left").join(hits, ["query_id", "source_config_id", "parent_id"], "left").where("hit IS NULL")
    rows = rows.join(parents, ["source_config_id", "parent_id"], "left")
    known = F.coalesce("known", F.lit(False))
    return rows.withColumn("heading", F.when(known, F.col("p_heading")).otherwise(F.col("heading"))).withColumn("content", F.when(known, F.col("p_content")).otherwise(F.col("content"))).select(*sections.columns)


def drop_stale_revisions(sections: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Without code sections whose chunk has another hash than its document (by source and path) has now; unknown ones stay."""
    made = chunks.where("content_sha256 IS NOT NULL AND relative_path IS NOT NULL").select("source_config_id", "chunk_id", "relative_path", F.col("content_sha256").alias("then"))
    now = documents.where("content_sha256 IS NOT NULL").groupBy("source_config_id", "relative_path").agg(F.collect_set("content_sha256").alias("now"))
    rows = sections.join(made, ["source_config_id", "chunk_id"], "left").join(now, ["source_config_id", "relative_path"], "left")
    return rows.where("now IS NULL OR then IS NULL OR array_contains(now, then)").select(*sections.columns)


def code_context(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Code children get lines that name file, symbol path and parent; of a parent and its children in one query the better side stays.

    The parent stays if it scores at least as well as its best child, else the children do.
    ``chunks(source_config_id, chunk_id, chunk_type, parent_id, relative_path, qualified_name, signature)``.
    """
    marks = chunks.where("chunk_type = 'code_child'").select("source_config_id", "chunk_id", "parent_id", "relative_path", "qualified_name")
    parents = chunks.select("source_config_id", F.col("chunk_id").alias("parent_id"), F.col("signature").alias("p_signature"))
    rows = sections.join(marks, ["source_config_id", "chunk_id"], "left").join(parents, ["source_config_id", "parent_id"], "left")
    best = rows.where("parent_id IS NOT NULL").groupBy("query_id", "source_config_id", F.col("parent_id").alias("chunk_id")).agg(F.max("score").alias("child_score"))
    own = sections.select("query_id", "source_config_id", F.col("chunk_id").alias("parent_id"), F.col("score").alias("parent_score"))
    rows = rows.join(best, ["query_id", "source_config_id", "chunk_id"], "left").join(own, ["query_id", "source_config_id", "parent_id"], "left")
    child_best = F.max("score").over(Window.partitionBy("query_id", "source_config_id", "parent_id"))
    rows = rows.withColumn("siblings", F.when(F.col("parent_id").isNotNull(), child_best))
    rows = rows.where("(child_score IS NULL OR score >= child_score) AND (parent_score IS NULL OR siblings > parent_score)")
    lines = F.concat_ws("\n", *[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in (("File", "relative_path"), ("Symbol path", "qualified_name"), ("Parent", "p_signature"))])
    child = F.col("relative_path").isNotNull()
    return rows.withColumn("content", F.when(child, F.concat_ws("\n\n", lines, "content")).otherwise(F.col("content"))).select(*sections.columns)


def search(
    queries: DataFrame, postings: DataFrame | Postings, vectors: DataFrame, chunks: DataFrame, documents: DataFrame | None = None, k: int = 8, scorer: Callable | None = None, sources: DataFrame | None = None
) -> DataFrame:
    """Sections for ``queries(query_id, text, q)``: nearest vectors and lexical hits, fused, gated, reranked if asked, in context.

    The vector channel gets revisions, code lines and parents before fusion, the final list its parents once more. Columns: those of
    ``fuse_sections``; pos is the place in the fused (or reranked) order and has gaps where context removed a section. With ``sources(query_id, source_config_id)``
    both channels keep to the sources of a query, before they rank; ``vectors`` then have a source_config_id too.
    """
    scratch, wide = Scratch(chunks.sparkSession, "search"), min(50, max(3 * k, k + 8))
    of = chunks.select("chunk_id", "source_config_id", "heading", "content")
    asked = queries.select("query_id", "q")
    if sources is not None:
        asked = asked.join(sources.select("query_id", "source_config_id").distinct(), "query_id")
    near = scratch.save(with_rows(knn(asked, vectors, wide).withColumnsRenamed({"id": "chunk_id", "rn": "pos"}), of).select(*ONE), "near")
    words = lexical_channel(queries, postings, chunks, wide, sources).withColumnRenamed("rn", "pos")
    words = scratch.save(with_rows(words, of).select(*ONE), "words")
    # Context needs the hits and their parents; the ids of these, some tens a query, are sent to the chunks.
    hits = near.select("chunk_id").unionByName(words.select("chunk_id")).distinct()
    above = chunks.join(F.broadcast(hits), "chunk_id", "left_semi").select(F.col("parent_id").alias("chunk_id")).where("chunk_id IS NOT NULL")
    ids = scratch.save(hits.unionByName(above).distinct(), "ids")
    known = scratch.save(chunks.join(F.broadcast(ids), "chunk_id", "left_semi"), "known")
    if documents is not None:
        near = code_context(drop_stale_revisions(near, known, documents), known)
    near = parent_context(near, known)
    found = scratch.save(fuse_sections(queries, near, words, k), "found")
    if scorer is not None:
        found = rerank(found, queries, scorer).drop("pos").withColumnRenamed("place", "pos")
    return parent_context(found, known)


def entity_lookup(names: DataFrame, entities: DataFrame, relations: DataFrame, events: DataFrame, hottest: int = 200, texts: int = 6) -> DataFrame:
    """(source_config_id, name, entity_id, snippets): an equal name before one that contains it, among each source's hottest entities.

    Snippets: up to ``texts`` texts of 500 characters (summary, else content, else title) of the entity's events in order of event_id.
    """
    heat = relations.groupBy("entity_id").agg(F.count("*").alias("heat"))
    hot = top(entities.join(heat, "entity_id", "left").na.fill(0, ["heat"]), ["source_config_id"], [F.desc("heat"), F.col("name"), F.col("entity_id")], hottest, "h")
    low, own = F.lower("name"), F.lower("asked")
    found = hot.join(names.select(F.col("name").alias("asked")).where("trim(name) <> ''").distinct(), F.contains(low, own))
    best = top(found, ["source_config_id", "asked"], [F.when(low == own, 0).otherwise(1), F.col("h")], 1).select("source_config_id", "asked", "entity_id")
    pairs = relations.join(best.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "event_id").distinct()
    text = F.substring(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("summary", "content", "title")], F.lit("")), 1, 500)
    told = top(pairs.join(events.select("event_id", text.alias("snippet")), "event_id"), ["entity_id"], [F.col("event_id")], texts)
    told = told.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "snippet"))), lambda x: x.snippet).alias("snippets"))
    return best.join(told, "entity_id", "left").select("source_config_id", F.col("asked").alias("name"), "entity_id", F.coalesce(F.array_join("snippets", "|"), F.lit("")).alias("snippets"))
