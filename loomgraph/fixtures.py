"""The event-entity tables as views over the test tables; each expression reads the same in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators.recall import LIVE, VISIBLE  # noqa: F401  the queries take them from here

PER_TASK = 500_000  # lines of a task where there are many
SOURCES = ["'n'||n_nationkey AS source_config_id", "n_name AS name"]
DOCUMENTS = [
    "'c'||c_custkey AS document_id", "'n'||c_nationkey AS source_id", "c_name AS filename",
    "CASE c_custkey % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'LOADING' WHEN 2 THEN 'EXTRACTING' WHEN 3 THEN 'PAUSED' WHEN 4 THEN 'READY' ELSE 'FAILED' END AS status",
    "CAST(c_custkey % 7 AS INT) AS chunk_count", "CAST(c_custkey % 11 AS INT) AS event_count", "CAST(c_acctbal * 100 AS BIGINT) AS size_bytes",
    "TIMESTAMP '2024-01-01 00:00:00' + CAST(c_custkey % 97 AS INT) * INTERVAL 1 DAY AS created_at",
]
EVENTS = [
    "lpad(CAST(o_orderkey AS STRING), 10, '0') AS event_id", "'n'||c_nationkey AS source_config_id", "'c'||o_custkey AS source_id",
    "o_orderpriority||' '||(o_orderkey % 50) AS title", "o_orderpriority AS category", "CAST(o_orderkey % 5 AS INT) AS rank",
    "'c'||o_custkey||'-'||(o_orderkey % 3) AS chunk_id", "CASE o_orderstatus WHEN 'P' THEN 'DELETED' WHEN 'F' THEN 'COMPLETED' END AS status",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS start_time", "o_orderdate + INTERVAL 1 DAY AS created_time",
    "coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END, o_orderdate + INTERVAL 1 DAY) AS event_time",
]
RELATIONS = [
    "md5(l_orderkey||'-'||l_partkey||'-'||l_suppkey||'-'||l_linenumber||'-'||CAST(CAST(l_shipdate AS DATE) AS STRING)) AS id",
    "lpad(CAST(l_orderkey AS STRING), 10, '0') AS event_id", "'n'||c_nationkey||'-'||l_partkey AS entity_id", "'n'||c_nationkey AS source_config_id",
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 50 END AS weight", "l_returnflag||l_linestatus AS description", "l_shipdate AS created_time",
    "CASE WHEN l_discount = 0 THEN TRUE WHEN l_linenumber % 2 = 0 THEN NULL ELSE FALSE END AS is_delete",
]
ENTITIES = ["'n'||c_nationkey||'-'||p_partkey AS entity_id", "'n'||c_nationkey AS source_config_id", "p_type AS type", "p_name AS name", "lower(p_name) AS normalized_name"]

_ORDERS = "orders JOIN customer ON o_custkey = c_custkey"
_LINES = f"lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
CTE = f"""
src AS (SELECT {", ".join(SOURCES)} FROM nation),
doc AS (SELECT {", ".join(DOCUMENTS)} FROM customer),
ev AS (SELECT {", ".join(EVENTS)} FROM {_ORDERS}),
ee AS (SELECT {", ".join(RELATIONS)} FROM {_LINES}),
en AS (SELECT DISTINCT {", ".join(ENTITIES)} FROM {_LINES} JOIN part ON l_partkey = p_partkey),
ch AS (SELECT doc_id, source AS source_config_id, CAST(i - 1 AS INT) AS rank, doc_id||'-'||(i - 1) AS chunk_id, l[i] AS content
  FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(l[i]) <> '')"""


class Tables:
    """The derived tables of one test directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "documents" and len(df.inputFiles()) == 1:  # a single file may be one row group, which one task would read
            return df.repartition(self.spark.sparkContext.defaultParallelism)
        return df

    def _orders(self) -> DataFrame:
        return self.raw("orders").join(self.raw("customer"), _on("o_custkey", "c_custkey"))

    def _lines(self) -> DataFrame:
        """Lines are shuffled once, as orders meet customers before; a task gets some PER_TASK of them, however many there are."""
        return self._dealt(self.raw("lineitem"), "l_orderkey").join(self._orders(), _on("l_orderkey", "o_orderkey"))

    def tasks(self) -> int | None:
        """Tasks that all lines, and what is as many, are dealt over; None leaves it to Spark, where there are few."""
        n = self.raw("lineitem").count() // PER_TASK  # read from the footers
        return max(n, int(self.spark.conf.get("spark.sql.shuffle.partitions"))) if n > self.spark.sparkContext.defaultParallelism else None

    def _dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        n = self.tasks()
        return df.repartition(n, *keys) if n else df

    def sources(self) -> DataFrame:
        return self.raw("nation").selectExpr(*SOURCES)

    def documents(self) -> DataFrame:
        return self.raw("customer").selectExpr(*DOCUMENTS)

    def events(self) -> DataFrame:
        return self._orders().selectExpr(*EVENTS)

    def relations(self) -> DataFrame:
        return self._lines().selectExpr(*RELATIONS)

    def entities(self) -> DataFrame:
        """Keys are made distinct before they get their names, so that no long row is shuffled or held more often than it counts."""
        keys = self._dealt(self._lines().select("c_nationkey", "l_partkey"), "c_nationkey", "l_partkey").distinct()
        parts = self.raw("part").select("p_partkey", "p_type", "p_name").distinct()
        rows = keys.join(parts, _on("l_partkey", "p_partkey")).selectExpr(*ENTITIES)
        # Without a nation an entity has no id, and those of several parts may be equal.
        return rows if self.raw("customer").where("c_nationkey IS NULL").isEmpty() else rows.distinct()

    def chunks(self) -> DataFrame:
        lines = self.raw("documents").selectExpr("doc_id", "source AS source_config_id", "posexplode(split(text, '\\n')) AS (rank, content)")
        return lines.where("trim(content) <> ''").selectExpr("doc_id", "source_config_id", "rank", "doc_id||'-'||rank AS chunk_id", "content")


def _on(a: str, b: str):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)
