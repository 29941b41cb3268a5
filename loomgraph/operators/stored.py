"""A stored BM25 index by sources: postings in blocks by impact, top-k within the sources that a query names, blocks skipped by their bounds.

Next to the blocks lie the chunks' words by rows. Queries whose terms have more postings together than there are words, so that blocks would be read for many of them, are
scored in one pass over the rows. Statistics are kept for each source, so that a query scores as over a table of its sources only. A block holds postings of one term and source that are near
by impact among those of a slice: a task cuts full blocks from its own slices, only what they leave over is put together (``blocks``), so no task ranks or writes a whole term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Scratch
from .blocks import cut_lots, meet
from .ranking import K1, B, best_of_rows
from .recall import terms, top

BLOCK, SLICE = 256, 1 << 20  # postings of a block, and words or postings that a task ranks at a time
FOLDER = 1 << 22  # postings of a folder of a source, on average
LISTED = 1000  # sources that are named in a filter on folders; beyond them folders are pruned by the join
SOURCE = "source_config_id"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def _folder(source: Column) -> Column:
    """Folders have a name for the empty source too."""
    return F.concat(F.lit("of-"), source)


def _impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term adds to a score, without its idf: it rises with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def write_postings(chunks: DataFrame, path: str, now: str) -> None:
    """Stores blocks, (source, term, df), (source, rows, tokens) and when it was built, of ``chunks(source_config_id, chunk_id, content)``.

    Null content has no terms, a null source is the empty one. Folders are those of sources and, where a source holds more than FOLDER postings, of buckets of terms.
    Repeated chunk ids are chunks of their own where their lengths differ. An empty table gives an index without rows.
    """
    spark, scratch = chunks.sparkSession, Scratch(chunks.sparkSession, "postings")
    rows = chunks.select(F.coalesce(SOURCE, F.lit("")).alias(SOURCE), "chunk_id", F.lower(F.coalesce("content", F.lit(""))).alias("content"))
    # The table is read once, and its texts are shuffled once, to the words' folders; all else comes from these.
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(spark.sparkContext.defaultParallelism))
    whole = rows.repartition(SOURCE, share).withColumn("folder", _folder(F.col(SOURCE))).sortWithinPartitions("folder")
    whole = whole.select("folder", SOURCE, "chunk_id", terms(F.col("content")).alias("w")).select(SOURCE, "chunk_id", F.size("w").alias("dl"), "w", "folder")
    whole.write.mode("overwrite").partitionBy("folder").option("compression", "zstd").parquet(f"{path}/words")
    read = lambda kind: spark.read.schema(_SCHEMAS[kind]).parquet(f"{path}/{kind}")
    words = read("words").drop("folder")
    stats = words.groupBy(SOURCE).agg(F.count("*").alias("rows"), F.sum("dl").alias("tokens"))
    stats.withColumn("built_at", F.lit(now).cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    # Rows of an id that repeats within a source count together where their lengths are equal; a search scores rows of the others one by one.
    repeated = scratch.save(words.groupBy(SOURCE, "chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col(SOURCE).alias("_source"), F.col("chunk_id").alias("_chunk")), "repeated")
    single = repeated.isEmpty()
    base = words.select(SOURCE, "chunk_id", "dl", F.lit(1).alias("tf"), "w").where("dl > 0")
    if not single:
        same = (F.col(SOURCE) == F.col("_source")) & F.col("chunk_id").eqNullSafe(F.col("_chunk"))
        more = words.join(repeated, same, "left_semi").select(SOURCE, "chunk_id", "dl", F.explode("w").alias("term"))
        more = scratch.save(more.groupBy(SOURCE, "chunk_id", "dl", "term").agg(F.count("*").cast("int").alias("tf")), "more")
        base = base.join(repeated, same, "left_anti").unionByName(more.withColumn("w", F.array("term")).drop("term"))
    most = base.groupBy(SOURCE).agg(F.sum(F.size(F.array_distinct("w"))).alias("n")).agg(F.max("n"), F.sum("n")).first()
    most, every = most[0] or 0, most[1] or 0
    buckets = 1 << max(0, (most // FOLDER).bit_length())
    means = spark.read.parquet(f"{path}/stats").select(SOURCE, (F.col("tokens") / F.col("rows")).alias("avgdl"))
    # Folders of a source are written by as many tasks as it has shares of terms.
    packed = cut_lots(base.join(means, SOURCE), BLOCK, SLICE, buckets, int(4 * most // (buckets * FOLDER)) + 1)
    dealt, tasks = [SOURCE, "bucket", "share"], max(int(2 * every // FOLDER), spark.sparkContext.defaultParallelism)  # by postings: packed rows are far smaller than what they hold
    blocks = meet(packed.repartition(tasks, *dealt).sortWithinPartitions(*dealt), BLOCK).withColumn("folder", _folder(F.col(SOURCE)))
    blocks.sortWithinPartitions("folder", "bucket", "term", "block").write.mode("overwrite").partitionBy("folder", "bucket").option("compression", "zstd").parquet(f"{path}/blocks")
    df = read("blocks").select(SOURCE, "term", "n", "folder", "bucket").repartition(SOURCE, "bucket").groupBy(SOURCE, "bucket", "term", "folder").agg(F.sum("n").alias("df"))
    df.sortWithinPartitions("folder", "bucket", "term").write.mode("overwrite").partitionBy("folder", "bucket").option("compression", "zstd").parquet(f"{path}/df")
    spark.createDataFrame([(buckets, single)], "buckets int, words boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    scratch.drop("")


class Postings:
    """A stored index, open for search."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.stats = spark.read.parquet(f"{path}/stats")
        self.buckets, self.words = spark.read.parquet(f"{path}/meta").first()

    def of(self, kind: str, sources: list[str] | None) -> DataFrame:
        """Rows of the index, of the folders of these sources only."""
        rows = self.spark.read.option("basePath", f"{self.path}/{kind}").schema(_SCHEMAS[kind]).parquet(f"{self.path}/{kind}")
        return rows.drop("folder") if sources is None else rows.where(F.col("folder").isin([f"of-{s}" for s in sources])).drop("folder")

    def stale(self, counts: DataFrame, now: str) -> bool:
        """Whether any source of ``counts(source_config_id, rows)`` is unknown or has grown by a tenth, or the index is older than half an hour."""
        from .search import index_stale

        meta = self.stats.select(F.col(SOURCE).alias("name"), F.col("rows").alias("indexed"), "built_at")
        rows = counts.select(F.coalesce(SOURCE, F.lit("")).alias("name"), "rows", F.lit(now).cast("timestamp").alias("now"))
        unknown = rows.join(meta, "name", "left_anti")
        return not unknown.isEmpty() or not index_stale(meta.join(rows.select("name"), "name", "left_semi"), rows).where("stale").isEmpty()

    def search(self, queries: DataFrame, k: int, sources: DataFrame | None = None) -> DataFrame:
        """(query_id, source_config_id, chunk_id, score, rn): BM25 top-k of ``queries(query_id, text)`` within ``sources(query_id, source_config_id)``.

        Without ``sources`` all are searched; a query that names none finds nothing. score/2 is clamped to [0, 1], ties go by chunk id and source. Exact:
        blocks are skipped only where no chunk of theirs can be among the k best.
        """
        found, _ = self._search(queries, k, sources)
        return found

    def _search(self, queries: DataFrame, k: int, sources: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """The result, and which blocks were read unless it comes from rows of words."""
        scratch = Scratch(self.spark, "lexical")
        within = [SOURCE] if sources is not None else []
        wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term")).distinct()
        listed = None
        if sources is None:
            n, tokens = self.stats.agg(F.sum("rows"), F.sum("tokens")).first()
            wanted = wanted.withColumn("n", F.lit(n)).withColumn("avgdl", F.lit((tokens or 0) / (n or 1)))
        else:
            scope = scratch.save(sources.select("query_id", F.coalesce(SOURCE, F.lit("")).alias(SOURCE)).distinct(), "scope")
            names = [r[0] for r in scope.select(SOURCE).distinct().limit(LISTED + 1).collect()]
            listed = names if len(names) <= LISTED else None
            sums = scope.join(self.stats, SOURCE).groupBy("query_id").agg(F.sum("rows").alias("n"), (F.sum("tokens") / F.sum("rows")).alias("avgdl"))
            wanted = wanted.join(sums, "query_id").join(scope, "query_id")
        keys = [*within, "bucket", "term"]
        wanted = wanted.withColumn("bucket", _bucket(F.col("term"), self.buckets))
        df = wanted.join(self.of("df", listed), keys).groupBy("query_id", "term").agg(F.sum("df").alias("df"), F.first("n").alias("n"), F.first("avgdl").alias("avgdl"))
        idf = F.log(1 + (F.col("n").cast("double") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = scratch.save(df.select("query_id", "term", idf.alias("idf"), "avgdl", "df"), "weights")
        if self.words and (weights.agg(F.sum("df")).first()[0] or 0) > 2 * (self.stats.agg(F.sum("tokens")).first()[0] or 0):
            raw = best_of_rows(self.of("words", listed), weights, k, scope if sources is not None else None)
            found = top(raw, ["query_id"], [F.desc(F.round("raw", 9)), F.col("chunk_id"), F.col(SOURCE)], k)
            return found.select("query_id", SOURCE, "chunk_id", F.least(F.lit(1.0), "raw").alias("score"), "rn"), None
        weights = weights.drop("df")
        wanted = wanted.select("query_id", *keys).join(weights, ["query_id", "term"])
        blocks = self.of("blocks", listed)
        bound = F.col("idf") * _impact(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"))
        heads = wanted.join(blocks.select(SOURCE, "bucket", "term", "block", F.col("n").alias("size"), "max_tf", "min_dl"), keys).select("query_id", SOURCE, "bucket", "term", "block", "size", "idf", "avgdl", bound.alias("bound"))
        heads = scratch.save(heads, "heads")
        at = [SOURCE, "bucket", "term", "block"]
        first = top(heads, ["query_id", "term"], [F.desc("bound"), F.col(SOURCE), F.col("block")], 1)
        score = F.sum(F.col("idf") * _impact(F.col("p.tf"), F.col("p.dl"), F.col("avgdl")))
        some = first.join(blocks.select(*at, "postings"), at).select("query_id", SOURCE, "idf", "avgdl", F.explode("postings").alias("p"))
        some = some.groupBy("query_id", SOURCE, "p.chunk_id").agg(score.alias("least"))
        floors = top(some, ["query_id"], [F.desc("least")], k).where(F.col("rn") == k).select("query_id", F.col("least").alias("floor"))
        # Terms of small bounds first, a budget below the floor is dealt out: a chunk that lies only in blocks within their term's share cannot reach it.
        rising = Window.partitionBy("query_id").orderBy("own", "term").rowsBetween(Window.unboundedPreceding, -1)
        best = heads.groupBy("query_id", "term").agg(F.max("bound").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(rising), F.lit(0.0)))
        best = best.join(floors, "query_id", "left").withColumn("share", F.coalesce(F.least("own", F.col("floor") * (1 - 1e-9) - 1e-9 - F.col("before")), F.lit(0.0)))
        told = heads.join(best.select("query_id", "term", "share"), ["query_id", "term"]).withColumn("open", F.col("bound") > F.col("share"))
        told = scratch.save(told.select("query_id", *at, "size", "idf", "avgdl", "open"), "told")
        read, every = told.agg(F.sum(F.when(F.col("open"), F.col("size"))), F.sum("size")).first()
        part = F.col("idf") * _impact(F.col("tf"), F.col("dl"), F.col("avgdl"))
        if 4 * (read or 0) > (every or 0):  # most postings are open: all of them are added up
            met = told.join(blocks.select(*at, "postings"), at).select("query_id", SOURCE, "idf", "avgdl", F.explode("postings").alias("p")).select("query_id", SOURCE, "idf", "avgdl", "p.*")
        else:  # candidates of a query come from its open blocks, their exact scores from all blocks of their terms
            hits = told.where("open").join(blocks.select(*at, "postings"), at).select("query_id", SOURCE, F.explode("postings.chunk_id").alias("chunk_id")).distinct()
            hits = scratch.save(hits, "hits")
            each = blocks.join(told.select(*at).distinct(), at, "left_semi").select(SOURCE, "term", F.explode("postings").alias("p")).select(SOURCE, "term", "p.*")
            met = each.join(hits, [SOURCE, "chunk_id"]).join(weights, ["query_id", "term"])
        scored = met.groupBy("query_id", SOURCE, "chunk_id").agg((F.sum(part) / 2).alias("raw"))
        found = top(scored, ["query_id"], [F.desc(F.round("raw", 9)), F.col("chunk_id"), F.col(SOURCE)], k)
        return found.select("query_id", SOURCE, "chunk_id", F.least(F.lit(1.0), "raw").alias("score"), "rn"), told


_SCHEMAS = {
    "words": f"{SOURCE} string, chunk_id string, dl int, w array<string>, folder string",
    "df": f"{SOURCE} string, term string, df long, folder string, bucket int",
    "blocks": f"{SOURCE} string, term string, block long, n long, max_tf int, min_dl int, postings array<struct<chunk_id: string, tf: int, dl: int>>, folder string, bucket int",
}
