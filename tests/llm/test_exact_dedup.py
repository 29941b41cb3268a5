"""Exact duplicates against brute force, the code of fingerprints, and odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import exact_dedup
from loomgraph.llm.common import bit_set, may_hold

DELETE = dict.fromkeys(map(ord, exact_dedup.BLANKS))


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(DELETE)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        out += [(m[3], members[0][3], len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, m in enumerate(members)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(df).collect()), key=repr)


@pytest.mark.parametrize("n,span", [(1, 3), (7, 7), (100, 1 << 20), (3000, 1 << 41), (1, 1 << 55)])
def test_rice_code_round_trip(n, span):
    r = np.random.default_rng(n)
    values = np.sort(r.choice(min(span, 1 << 20), n, replace=False)).astype(np.int64) * max(span >> 20, 1)
    k, code = exact_dedup.rice_encode(values, span)
    assert (exact_dedup.rice_decode(n, k, code) == values).all()
    assert len(code) * 8 <= n * (np.log2(span / n) + 2.5) + 16


def test_odd_rows_equal_brute_force(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (5, "ab"), (5, "ab"), (6, "a  b"), (None, "ab"), (None, "only"), (7, "a b"), (8, "ẞ" * 200_000), (9, "ẞ " * 200_000), (10, "A b"), (11, "tie x"), (12, "tiex "), (None, "n"), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("x")).withColumn("sha", F.lit(1)).withColumn("place", F.lit(None).cast("int"))
    assert found(df) == brute(rows)
    assert found(df.repartition(5)) == brute(rows)
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_copies_across_lots_and_false_suspects(spark, monkeypatch):
    """Small lots, and fingerprints so short that unlike texts share them: bytes decide."""
    monkeypatch.setattr(exact_dedup, "SPARE", -4)
    rows = [(i, f"text {i % 150}" + " " * (i % 7)) for i in range(1500)] + [(5000 + i, "hot copy") for i in range(900)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)) == brute(rows)


def test_messages_hold_no_texts_and_suspects_only_are_grouped(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(2000)] + [(9001, "t5")], "doc_id long, text string").withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("chars", F.length("text"))
    sent = exact_dedup.send(docs.repartition(4), 31, 4).cache()
    rows = exact_dedup.suspects(sent.where("kind = 0").select("sender", "doc_id", "rid", "chars", "fp", "sha"), exact_dedup.answer(sent.where("kind = 1")))
    assert {5, 9001} <= {r.doc_id for r in rows.where("suspect").collect()} and rows.where("suspect").count() < 10
    assert sent.where("kind = 1").selectExpr("sum(length(code)) AS s").first().s < 2001 * 4


def test_bit_set_loses_nothing_when_full(spark, monkeypatch):
    from loomgraph.llm import common

    monkeypatch.setattr(common, "MOST_BITS", 15)
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    pages, bits = bit_set(keys, 5000)
    assert bits == 15 and may_hold(keys, F.col("key"), pages, bits).count() == 5000
    monkeypatch.setattr(common, "MOST_BITS", 28)
    pages, bits = bit_set(keys, 5000)
    other = spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id").alias("key"))
    assert may_hold(keys, F.col("key"), pages, bits).count() == 5000 and may_hold(other, F.col("key"), pages, bits).count() < 600
