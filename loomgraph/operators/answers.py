"""Texts of answers: excerpts, lists, citations that can be traced, evidence by events, prompt previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relevance import query_terms


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def best_excerpt(question: Column, content: Column, size: int = 260) -> Column:
    """The first sentence with most terms of the question, cut to ``size`` characters with an ellipsis."""
    low = F.transform(query_terms(question), lambda t: F.lower(t))
    said = F.transform(F.split(squeezed(content), "(?<=[。！？.!?])"), lambda s: F.trim(s))
    rated = F.transform(said, lambda s, i: F.struct(F.size(F.filter(low, lambda t: F.contains(F.lower(s), t))).alias("n"), (-i).alias("at"), s.alias("s")))
    best = F.array_max(rated).s
    return F.when(F.length(best) > size, F.concat(F.rtrim(F.substring(best, 1, size)), F.lit("…"))).otherwise(best)


def extractive_answer(queries: DataFrame, sections: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, answer): the best excerpt of each of the first sections of ``sections(query_id, rn, content)`` as a list with numbers."""
    rows = sections.where(F.col("rn") <= most).join(queries.select("query_id", "text"), "query_id")
    line = F.concat(F.lit("- "), best_excerpt(F.col("text"), F.col("content")), F.lit(" ["), F.col("rn").cast("string"), F.lit("]"))
    rows = rows.select("query_id", F.struct("rn", line.alias("line")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.line), "\n").alias("answer"))


def numbers(answer: Column) -> Column:
    """The n of each [n] of up to nine digits, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,9})\]"), 1), lambda n: n.cast("int"))


def finalize_citations(answers: DataFrame, citations: DataFrame, fallback: int = 3) -> dict[str, DataFrame]:
    """``answers``: texts without numbers that no citation has; ``citations``: used ones in order of first use, level claim.

    An answer without any number that can be traced gets its first ``fallback`` citations, level run.
    ``answers(query_id, answer)``, ``citations(query_id, n, ...)``.
    """
    known = citations.groupBy("query_id").agg(F.collect_set("n").alias("known"))
    rows = answers.join(known, "query_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<int>")))
    bad = F.array_distinct(F.filter(numbers(F.col("answer")), lambda n: ~F.array_contains("known", n)))
    text = F.aggregate(bad, F.coalesce("answer", F.lit("")), lambda t, n: F.replace(t, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))
    used = rows.select("query_id", F.posexplode(F.filter(numbers(F.col("answer")), lambda n: F.array_contains("known", n))).alias("at", "n"))
    used = used.groupBy("query_id", "n").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    cited = used.withColumn("place", place).join(citations, ["query_id", "n"]).drop("at").withColumn("level", F.lit("claim"))
    rest = citations.join(answers.select("query_id"), "query_id", "left_semi").join(used.select("query_id").distinct(), "query_id", "left_anti")
    rest = rest.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).where(F.col("place") <= fallback).withColumn("level", F.lit("run"))
    return {"answers": rows.select("query_id", text.alias("answer")), "citations": cited.unionByName(rest)}


def canonical_url(url: Column) -> Column:
    """http(s) URL with a lower-case scheme and host, without credentials and fragment; null for anything else."""
    u = F.trim(url)
    pattern = r"^(?i)(https?)://(?:[^/?#@\s]*@)?([^/?#@\s]+)([^#\s]*)(?:#\S*)?$"
    part = lambda k: F.regexp_extract(u, pattern, k)
    return F.when(part(2) != "", F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3)))


def external_citations(answers: DataFrame, references: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, url, title, mapped): the first of each canonical URL of ``references(query_id, pos, url, title)``, at most ``most``.

    ``mapped`` tells whether the answer holds the URL.
    """
    rows = references.withColumn("url", canonical_url(F.col("url"))).where("url IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("query_id", "url").orderBy("pos"))
    rows = rows.withColumn("first", first).where("first = 1").withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("rn") <= most)
    found = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"(?i)https?://[^\s<>()\[\]\"']+"), 0)
    named = answers.select("query_id", F.explode(F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?]+$", ""))).alias("u")).select("query_id", canonical_url(F.col("u")).alias("url")).distinct()
    return rows.join(named.withColumn("mapped", F.lit(True)), ["query_id", "url"], "left").select("query_id", "url", "title", F.coalesce("mapped", F.lit(False)).alias("mapped"), "rn")


def event_first_evidence(sections: DataFrame, events: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Evidence with sections behind events first, in event order, then the other sections.

    ``sections(query_id, source_config_id, chunk_id, content, score, pos)``, ``events(query_id, source_config_id, chunk_id, score, pos)``. A chunk
    that only an event names is fetched from ``chunks``; the score is the larger of both.
    """
    keys = ["query_id", "source_config_id", "chunk_id"]
    told = events.where("chunk_id IS NOT NULL").groupBy(*keys).agg(F.min("pos").alias("e_pos"), F.max("score").alias("e_score"))
    rows = sections.join(told, keys, "full").join(chunks.select("source_config_id", "chunk_id", F.col("content").alias("fetched")), ["source_config_id", "chunk_id"], "left")
    rows = rows.withColumn("content", F.coalesce("content", "fetched")).where("content IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy(F.col("e_pos").isNull(), F.coalesce("e_pos", "pos"), "source_config_id", "chunk_id")
    rows = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)
    return rows.select(*keys, "content", F.greatest("score", "e_score").alias("score"), F.col("e_pos").isNotNull().alias("by_event"), "rn")


def prompt_preview(messages: DataFrame, size: int = 6000) -> DataFrame:
    """(thread_id, preview): labelled messages in order; of a longer text 62 % of ``size`` from its start and 38 % from its end stay."""
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    whole = messages.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x.line), "\n\n").alias("t"))
    head, tail = int(size * 0.62), size - int(size * 0.62)
    cut = F.concat(F.substring("t", 1, head), F.lit("\n…\n"), F.expr(f"right(t, {tail})"))
    return whole.select("thread_id", F.when(F.length("t") > size, cut).otherwise(F.col("t")).alias("preview"))
