"""The stored overview: refreshes equal a full one, read the folders of dirty sources only, and keep the other buckets."""

import glob

from pyspark.sql import functions as F

from loomgraph.operators import overview
from loomgraph.operators.graph import overview_stats

EVENTS = "event_id string, source_config_id string, status string, event_time timestamp_ntz"
RELATIONS = "event_id string, entity_id string, source_config_id string"
MARKS = "source_config_id string, revision long"


def stored(spark, path, n, sources=12):
    """Events and relations by source; source s0 has ``n`` events more."""
    rows = [(f"e{s}-{i}", f"s{s}") for s in range(sources) for i in range(5 + (n if s == 0 else 0))]
    events = spark.createDataFrame(rows, "event_id string, source_config_id string").selectExpr("event_id", "source_config_id", "CAST(NULL AS STRING) AS status", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS event_time")
    relations = events.selectExpr("event_id", "'x' || hash(event_id) % 3 AS entity_id", "source_config_id")
    for name, df in (("events", events), ("relations", relations)):
        df.write.mode("overwrite").partitionBy("source_config_id").parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/relations")


def told(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def names(spark, *sources):
    return spark.createDataFrame([(s,) for s in sources], "source_config_id string")


def test_a_refresh_reads_and_rewrites_dirty_sources_only(spark, tmp_path, monkeypatch):
    path, every = str(tmp_path / "overview"), names(spark, *[f"s{s}" for s in range(12)], None)
    events, relations = stored(spark, str(tmp_path / "a"), 0)
    nothing = spark.createDataFrame([], MARKS)
    overview.refresh_overview(every, events, relations, path, nothing)
    assert told(overview.stored_overview(spark, path, every)) == told(overview_stats(events, relations))
    before = set(glob.glob(f"{path}/data/**/*.parquet", recursive=True))
    events, relations = stored(spark, str(tmp_path / "b"), 7)
    marks = spark.createDataFrame([("s0", 3), ("gone", 1), (None, 1)], MARKS)
    read = []
    real = overview.overview_stats
    monkeypatch.setattr(overview, "overview_stats", lambda e, r: (read.append((e, r)), real(e, r))[1])
    taken = overview.refresh_overview(every, events, relations, path, marks)
    for df in read[0]:
        assert all("source_config_id=s0" in f for f in [r[0] for r in df.select(F.input_file_name()).distinct().collect()])
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "source_config_id" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert told(overview.stored_overview(spark, path, every)) == told(overview_stats(events, relations))
    new = set(glob.glob(f"{path}/data/**/*.parquet", recursive=True)) - before
    assert len({f.rsplit("/", 2)[1] for f in new}) == 1
    # A mark that was set again meanwhile stays.
    now = spark.createDataFrame([("s0", 4), ("gone", 1)], MARKS)
    assert [tuple(r) for r in overview.clear_marks(now, taken).collect()] == [("s0", 4)]


def test_missing_empty_and_removed_sources(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "overview")
    events, relations = stored(spark, str(tmp_path / "a"), 0, 4)
    none = spark.createDataFrame([], MARKS)
    assert overview.stored_overview(spark, path, names(spark, "s0")) is None
    overview.refresh_overview(names(spark, "s0", "s1"), events, relations, path, none)
    shown = lambda *s: {r.source_config_id for r in overview.stored_overview(spark, path, names(spark, *s)).collect()}
    assert shown("s0", "s1", "s2") == {"s0", "s1"} and shown("s1") == {"s1"}
    # s2 is not marked but missing; s1 lost its events; beyond the listed number sources are joined.
    monkeypatch.setattr(overview, "LISTED", 0)
    left = events.withColumn("status", F.when(F.col("source_config_id") == "s1", "DELETED"))
    overview.refresh_overview(names(spark, "s0", "s1", "s2"), left, relations, path, spark.createDataFrame([("s1", 1)], MARKS))
    assert shown("s0", "s1", "s2") == {"s0", "s2"}
    # Without marks all are computed again.
    overview.refresh_overview(names(spark, "s0", "s1", "s2"), events, relations, path, none)
    assert shown("s0", "s1", "s2") == {"s0", "s1", "s2"}
    overview.refresh_overview(names(spark).limit(0), events, relations, path, none)
    assert shown("s0", "s1", "s2") == {"s0", "s1", "s2"}
