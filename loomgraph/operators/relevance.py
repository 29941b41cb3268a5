"""Query terms, lexical relevance, evidence and citations of recalled sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recall import normalize_text, top

# Phrases that carry no meaning in a query, and phrases of which two mark a page as boilerplate.
NOISE = ["知识库", "资料库", "资料中", "文档中", "告诉我", "帮我查", "搜索", "查询", "请问", "关于", "最新", "最近", "动态", "消息", "新闻", "内容", "资料", "一下", "是什么", "有哪些", "有什么"]
BOILERPLATE = ["新浪首页", "权利保护声明", "阅读排行榜", "评论排行榜", "点击加载更多", "免责声明"]


def without_noise(text: Column) -> Column:
    return reduce(lambda t, phrase: F.replace(t, F.lit(phrase), F.lit(" ")), NOISE, text)


def query_terms(text: Column) -> Column:
    """The first four distinct terms of a query that are not numbers; null text has none."""
    found = F.regexp_extract_all(without_noise(F.lower(F.trim(F.coalesce(text, F.lit(""))))), F.lit("[a-z0-9][a-z0-9_.+-]{1,31}|[\\x{3400}-\\x{9fff}]{2,16}"), 0)
    return F.slice(F.filter(F.array_distinct(found), lambda t: ~t.rlike("^[0-9]+$")), 1, 4)


def is_boilerplate(heading: Column, content: Column) -> Column:
    text = F.concat_ws("\n", heading, content)
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(m)).cast("int") for m in BOILERPLATE]) >= 2


def lexical_relevance(rows: DataFrame) -> DataFrame:
    """Adds lex and exact to ``rows(text, heading, content, ...)``: whole phrase, terms, and terms in the heading, at most 1."""
    heading, phrase = normalize_text(F.coalesce("heading", F.lit(""))), normalize_text(without_noise(F.coalesce("text", F.lit(""))))
    terms = F.filter(F.transform(query_terms(F.col("text")), normalize_text), lambda t: t != "")
    r = rows.withColumn("_h", heading).withColumn("_t", F.concat("_h", normalize_text(F.coalesce("content", F.lit(""))))).withColumn("_p", phrase).withColumn("_q", terms)
    share = lambda where: F.coalesce(F.size(F.filter("_q", lambda t: F.contains(F.col(where), t))) / F.nullif(F.size("_q"), F.lit(0)), F.lit(0.0))
    r = r.withColumn("exact", ((F.length("_p") >= 2) & F.contains("_t", F.col("_p"))).cast("int"))
    whole = F.when(F.col("exact") == 1, F.when(F.contains("_h", F.col("_p")), 0.75).otherwise(0.55)).otherwise(0.0)
    score = F.least(F.lit(1.0), whole + 0.35 * share("_t") + 0.15 * share("_h"))
    return r.withColumn("lex", F.when(F.col("_t") == "", 0.0).otherwise(score)).drop("_h", "_t", "_p", "_q")


def pack_evidence(sections: DataFrame, budget: int) -> DataFrame:
    """Sections of ``sections(query_id, rn, chunk_id, content)`` in order until the character budget is used; the last one is cut."""
    before = Window.partitionBy("query_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    rows = sections.withColumn("before", F.coalesce(F.sum(F.length("content")).over(before), F.lit(0))).where(F.col("before") < budget)
    return rows.withColumn("content", F.substr("content", F.lit(1), F.lit(budget) - F.col("before"))).drop("before")


def citations(events: DataFrame, per_section: int = 3) -> DataFrame:
    """Up to three events of each (source, chunk), in order of rank and id."""
    kept = top(events.where("chunk_id IS NOT NULL"), ["source_config_id", "chunk_id"], [F.col("rank"), F.col("event_id")], per_section)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_id"))), lambda x: x.event_id), ",")
    return kept.groupBy("source_config_id", "chunk_id").agg(listed.alias("event_ids"))


def section_citations(sections: DataFrame, events: DataFrame, per_section: int = 3) -> DataFrame:
    """Per section of ``sections(query_id, n, source_config_id, chunk_id, content, score)``: excerpt, score and up to three events of its chunk.

    An excerpt has white space collapsed and 720 characters, then an ellipsis. Events without a title are left out.
    """
    text = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))
    cut = F.concat(F.rtrim(F.rtrim(F.substring(text, 1, 720)), F.lit("…")), F.lit("…"))
    rows = sections.select("query_id", "n", "source_config_id", "chunk_id", F.when(F.length(text) > 720, cut).otherwise(text).alias("excerpt"), F.round("score", 4).alias("score"))
    refs = citations(events.where(F.trim(F.coalesce("title", F.lit(""))) != ""), per_section)
    return rows.join(refs, ["source_config_id", "chunk_id"], "left")


def valid_answer(answer: Column, sections: Column) -> Column:
    """At least one [n], and each with 1 <= n <= sections."""
    n = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit("\\[(\\d+)]"), 1), lambda x: x.cast("int"))
    return (F.size(n) > 0) & F.forall(n, lambda x: F.coalesce(x.between(1, sections), F.lit(False)))


def sort_events(events: DataFrame, k: int) -> DataFrame:
    """Latest start first, events without one last."""
    return top(events, ["source_config_id"], [F.desc_nulls_last("start_time"), F.col("event_id")], k)


def link_parents(chunks: DataFrame) -> DataFrame:
    """Parent of each child of ``chunks(doc_id, chunk_id, chunk_type, parent_group)``: the parent of its group; parents have none."""
    parents = chunks.where("chunk_type = 'parent'").groupBy("doc_id", "parent_group").agg(F.min("chunk_id").alias("p"))
    linked = chunks.join(parents, ["doc_id", "parent_group"], "left")
    return linked.select("chunk_id", F.when(F.col("chunk_type") == "child", F.col("p")).alias("parent_id"))


def token_usage(total: Column, prompt: Column, completion: Column, chars: Column) -> Column:
    return F.coalesce(total, prompt + completion, F.greatest(F.lit(1), F.ceil(chars / 3))).cast("long")


def recall_at_k(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    hit = approximate.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def recall_summary(recalls: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row over all queries: mean of ``recalls(query_id, recall)``, and mean, 50 and 95 in 100 of ``latencies(query_id, ms)``.

    A percentile is the smallest value with at least that share of all values at or below it.
    """
    rows = recalls.select("recall").unionByName(latencies.select("ms"), allowMissingColumns=True)
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY ms)")
    return rows.agg(F.count("recall").alias("queries"), F.avg("recall").alias("recall"), F.avg("ms").alias("ms_mean"), at(0.5).alias("ms_p50"), at(0.95).alias("ms_p95"))


def evaluation_rate(found: DataFrame) -> DataFrame:
    """One row over ``evaluate_retrieval``: cases, those hit, and their share (null without cases)."""
    hits = F.count(F.when(F.col("hit"), 1))
    return found.agg(F.count("*").alias("cases"), hits.alias("hits"), (hits / F.nullif(F.count("*"), F.lit(0))).alias("rate"))


def evaluate_retrieval(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Per case of ``cases(query_id, expected)`` how many results contain an expected term, whatever its case."""
    rows = cases.join(results, "query_id", "left")
    match = F.exists("expected", lambda t: F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lower(t)))
    return rows.groupBy("query_id").agg(F.count(F.when(match, 1)).alias("matches")).withColumn("hit", F.col("matches") > 0)


def rerank_by_listing(sections: DataFrame, answers: DataFrame) -> DataFrame:
    """Sections of ``sections(query_id, position)`` in the order in which ``answers(query_id, answer)`` first names their positions.

    Numbers that no section has are passed over; sections not named follow in their own order. ``place`` counts from 1.
    """
    named = answers.select("query_id", F.posexplode(F.regexp_extract_all("answer", F.lit("([0-9]+)"), 1)).alias("at", "n"))
    first = named.select("query_id", F.expr("try_cast(n AS BIGINT)").alias("position"), "at").groupBy("query_id", "position").agg(F.min("at").alias("at"))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("at"), "position")
    return sections.join(first, ["query_id", "position"], "left").withColumn("place", F.row_number().over(order)).drop("at")
