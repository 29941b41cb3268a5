"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A token budget is divided over a tree domain > language > source by weights. What a child cannot supply goes to its
siblings in proportion to their weights, and because the supply of a node is that of its leaves, no shortage leaves a
node before its children are used up. Each leaf then takes a prefix of its tokens from seeded passes (epochs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, carried

WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"
LEVELS = ("domain", "lang", "source")
# Default weights: those of domains, and those by which a domain's languages share (others 1); sources share alike.
DOMAIN_WEIGHTS = {"web": 5.0, "reference": 3.0, "other": 2.0}
LANG_WEIGHTS = {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 2.0}
DEFAULT_WEIGHTS = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
ROWS = 4096  # documents of one leaf whose running sum is one window partition, on average


def domain_of(source: Column) -> Column:
    """Domain of a source: by the number at its end, src0-src9 web, src10-src15 reference, the rest other."""
    number = F.regexp_extract(source, "^src([0-9]+)$", 1)
    n = F.when(number != "", number.cast("int"))
    return F.when(n <= 9, "web").when(n <= 15, "reference").otherwise("other")


def _lookup(column: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``nodes(*parents, name, weight, supply, budget)``, budget being the parent's: gives each its own budget.

    Children in order of supply / weight: a child is short if its weight's share of what the shorter ones leave exceeds its supply.
    """
    order = Window.partitionBy(*parents).orderBy(F.col("supply") / F.col("weight"), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumn("used", F.coalesce(F.sum("supply").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(rest))
    nodes = nodes.withColumn("per", (F.col("budget") - F.col("used")) / F.col("open"))
    # Once a child is not short, none after it is, and the rate of the first such child holds for all of them.
    nodes = nodes.withColumn("short", F.col("supply") <= F.col("per") * F.col("weight"))
    rate = F.min(F.when(~F.col("short"), F.struct(F.col("supply") / F.col("weight"), F.col(name), F.col("per").alias("per")))).over(Window.partitionBy(*parents))
    return nodes.withColumn("budget", F.when(F.col("short"), F.col("supply")).otherwise(rate["per"] * F.col("weight"))).drop("used", "open", "per", "short")


def leaf_budgets(leaves: DataFrame, share: float, epochs: int, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(domain, lang, source, tokens, budget) from ``leaves(domain, lang, source, tokens)``; the tree is one row per leaf. ``weights`` are by level and name."""
    weights = weights or DEFAULT_WEIGHTS
    total = float(leaves.agg(F.sum("tokens")).first()[0] or 0) * share
    parents, out = [], None
    for level in LEVELS:
        keys = [*parents, level]
        nodes = leaves.groupBy(*keys).agg((F.sum("tokens") * epochs).cast("double").alias("supply"))
        nodes = nodes.withColumn("weight", _lookup(level, weights.get(level, {})))
        nodes = nodes.withColumn("budget", F.lit(total)) if out is None else nodes.join(out.select(*parents, "budget"), parents)
        out, parents = _share(nodes, parents or [F.lit(0)], level), keys
    return leaves.join(out.select(*keys, "budget"), keys)


def mix(docs: DataFrame, share: float = 0.5, epochs: int = 2, seed: int = 7, domain: Column | None = None, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The chosen rows: columns of ``docs`` plus domain, n_tokens, epoch (0, 1, ...), leaf_budget.

    The tree is ``domain`` (by default that of ``domain_of(source)``) > lang > source, its weights are ``weights[level][name]``, above 0 and 1 where none is given
    (by default DEFAULT_WEIGHTS). Tokens are words between ASCII white space; the budget is ``share`` of all tokens. In epoch e a leaf's documents come in the order
    of md5(seed-e-doc_id), then text; a document is chosen if the tokens before it, earlier epochs included, are fewer than the budget,
    so the last one may pass it by less than its own tokens. Documents without words (null or blank text) carry nothing and are left
    out. Null lang or source is a leaf named "". Rows with null doc_id are ordered by a hash of their text. Repeated rows follow each other and
    each takes its own tokens of the budget; which of them are chosen is open, how many is not. Very long texts count whole. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    named = docs.select(
        carried(docs, "domain", "n_tokens", "epoch", "leaf_budget"),
        (domain_of(F.col("source")) if domain is None else F.coalesce(domain, F.lit(""))).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("th"),
        F.col("text").cast("string").alias("text"),
    )
    keys = list(LEVELS)
    counted = named.drop("row").withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    # One row for all repeats of a row in its leaf.
    slim = counted.where("n_tokens > 0").groupBy(*keys, "id", "th").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("copies"))
    slim = scratch.save(slim, "tokens")
    size = F.col("n_tokens") * F.col("copies")
    leaves = slim.groupBy(*keys).agg(F.sum(size).alias("tokens"), F.count("*").alias("rows"))
    budgets = scratch.save(leaf_budgets(leaves, share, epochs, weights), "budgets")
    dealt = slim.join(budgets, keys).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    dealt = dealt.where(F.col("epoch") * F.col("tokens") < F.col("budget"))
    dealt = dealt.withColumn("order", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce("id", F.hex("th")))))
    # Running sums in two steps: over ranges of the order key, as many as the leaf is large, then inside a range.
    dealt = dealt.withColumn("part", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.ceil(F.col("rows") / ROWS)).cast("long"))
    sums = dealt.groupBy(*keys, "epoch", "part").agg(F.sum(size).alias("s"))
    before = Window.partitionBy(*keys, "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inside = Window.partitionBy(*keys, "epoch", "part").orderBy("order", "id", "th").rowsBetween(Window.unboundedPreceding, -1)
    reached = dealt.join(sums, [*keys, "epoch", "part"]).withColumn("start", F.col("epoch") * F.col("tokens") + F.col("ahead") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    fit = F.least(F.col("copies"), F.ceil((F.col("budget") - F.col("start")) / F.col("n_tokens"))).alias("fit")
    times = F.array_sort(F.collect_list(F.struct("epoch", F.col("budget").alias("leaf_budget"), fit)))  # an entry per epoch
    taken = reached.where(F.col("start") < F.col("budget")).groupBy(*keys, "id", "th").agg(F.max("n_tokens").alias("n_tokens"), F.max("copies").alias("copies"), times.alias("times"))
    taken = scratch.save(taken.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "id", "th")], "n_tokens", "copies", "times"), "taken")
    many = scratch.save(taken.where("copies > 1"), "many")  # a table of its own, so that few repeats need no shuffle of texts
    meet = lambda t: named.drop("text").join(t, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")) & (F.col("domain") == F.col("_domain")) & (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")))
    kept = [c for c in dict.fromkeys(docs.columns) if c not in ("domain", "n_tokens", "epoch", "leaf_budget")]
    chosen = [*[F.col(f"row.`{c}`").alias(f"_own{k}") for k, c in enumerate(kept)], "domain", "n_tokens", "times"]  # columns, which are pruned one by one
    once = meet(taken.where("copies = 1")).select(*chosen, F.lit(0).cast("long").alias("copy"))
    # Repeated rows are numbered in two steps, by task and inside a task, so that no number of repeats meets in one.
    tag = [f"_{k}" for k in (*keys, "id", "th")]
    repeated = scratch.save(meet(many).select(*chosen, *tag, F.spark_partition_id().alias("task")), "repeated")
    tasks = repeated.groupBy(*tag, "task").agg(F.count("*").alias("m"))
    tasks = tasks.withColumn("first", F.coalesce(F.sum("m").over(Window.partitionBy(*tag).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tasks = tasks.select(*[F.col(k).alias(f"t{k}") for k in tag], F.col("task").alias("t_task"), "first")
    place = F.row_number().over(Window.partitionBy(*tag, "task").orderBy(F.lit(0)))
    same = F.lit(True)
    for k in tag:
        same &= F.col(k).eqNullSafe(F.col(f"t{k}"))
    names = [*[f"_own{k}" for k in range(len(kept))], "domain", "n_tokens", "times"]
    numbered = repeated.withColumn("place", place).join(tasks, same & (F.col("task") == F.col("t_task"))).select(*names, (F.col("first") + F.col("place") - 1).alias("copy"))
    out = once.unionByName(numbered).withColumn("t", F.explode("times")).where(F.col("copy") < F.col("t.fit"))
    return out.select(*[F.col(f"_own{k}").alias(c) for k, c in enumerate(kept)], "domain", "n_tokens", "t.epoch", "t.leaf_budget")
