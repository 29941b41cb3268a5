"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomgraph.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(str(tuple(plain(x) for x in r)) for r in df.select(*columns).collect())
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = sorted(str(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert ours == theirs


def test_fusion_keeps_the_lexical_match(spark):
    from loomgraph.operators.recall import fuse

    rows = spark.createDataFrame([(1, "a", 0.9, 0.0, 0, 1), (1, "b", 0.4, 0.5, 0, 2), (1, "c", 0.8, 0.0, 0, 3), (2, "x", 0.9, 0.0, 0, 1), (2, "y", 0.2, 0.1, 0, 2)], "query_id int, key string, raw double, lex double, exact int, pos int")
    assert [(r.query_id, r.key) for r in fuse(rows, 8).orderBy("query_id", "rn").collect()] == [(1, "b"), (2, "x")]


def test_relation_counts_take_null_and_false_as_live(spark):
    from loomgraph.operators.graph import event_relation_counts

    rows = spark.createDataFrame([("a", None), ("a", False), ("b", True), ("b", None), ("c", False)], "event_id string, is_delete boolean")
    assert {r.event_id: r.n for r in event_relation_counts(rows).collect()} == {"a": 2, "b": 1, "c": 1}


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
