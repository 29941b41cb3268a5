"""The conversation trie against brute force; subtree sums on chains, stars and random forests."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import prefix_trie
from loomgraph.llm.common import Scratch


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for key, cs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        kids = sum(len(k) == len(key) + 1 for k in below)
        leaves = sum(not any(len(m) == len(k) + 1 and m[: len(k)] == k for m in below) for k in below)
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(key))))
        out.append((min(cs), len(key), min(members[key[:-1]]) if key else None, len(cs), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("x")).withColumn("words", F.lit(None).cast("int")).withColumn("i", F.lit(0))
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df.repartition(parts)).collect()), key=repr)


def test_odd_rows_equal_brute_force(spark):
    rows = [(None, 0, "user", "lost"), (0, 0, "user", "hi there"), (0, 1, "assistant", "a  b c"), (0, None, None, None), (1, 5, "user", "x"), (2, 0, "user", ""), (3, 2, "user", "hi there"), (3, 2, "user", "hi there"),
            (25, 0, "user", "alone"), (26, 0, "user", "alone"), (26, 1, "user", "two"), (-7, 0, "user", "hi there"), (-20, 0, "user", "w " * 50_000), (-27, 3, "x", "y"), (19, 0, "user", "hi there"), (10**15, 0, "a", "b")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == []
    short = [(c, 0, "user", "z") for c in range(21, 30)]  # without the first of their group some have no turns left
    assert found(spark, short) == brute(short)


def test_long_and_hot_conversations(spark, monkeypatch):
    """Components, runs and pieces so small that all of them are split; a third of all turns are one conversation, another third share the first turn."""
    for name, value in (("LOCAL", 24), ("RUN", 7), ("PIECE", 60)):
        monkeypatch.setattr(prefix_trie, name, value)
    r = np.random.default_rng(0)
    rows = [(40, i, "user", f"long {i}") for i in range(60)] + [(41, i, "user", f"long {i}") for i in range(60)]
    rows += [(100 + c, i, "user", "same first" if i < 2 else f"t{r.integers(4)} w") for c in range(120) for i in range(int(r.integers(1, 5)))]
    rows += [(1000 + 20 * c, i, "user", f"copy {i}") for c in range(60) for i in range(3)]
    assert found(spark, rows, 7) == brute(rows)


def sums_of(parent, value):
    out = np.array(value)
    for k in range(len(parent) - 1, -1, -1):  # parents come before their children
        if parent[k] >= 0:
            out[parent[k]] += out[k]
    return out


def forests():
    r = np.random.default_rng(7)
    yield "chain", np.arange(-1, 2999)
    yield "star", np.append(-1, np.zeros(3000, int))
    yield "random", np.array([int(r.integers(-1, k)) if k else -1 for k in range(3000)])
    yield "brush", np.array([k - 1 if k < 1000 else int(r.integers(0, k)) for k in range(3000)])
    yield "alone", np.full(50, -1)


@pytest.mark.parametrize("name,parent", list(forests()), ids=[n for n, _ in forests()])
def test_local_sums(name, parent):
    value = np.arange(len(parent)) * 7 % 11
    order = np.random.default_rng(1).permutation(len(parent))
    moved = np.empty(len(parent), int)
    moved[order] = np.where(parent >= 0, order[parent], -1)
    out = prefix_trie.local_sums(moved, value[np.argsort(order)][None, :], np.zeros((1, len(parent)), np.int64))
    assert (out[0, order] == sums_of(parent, value)).all()


@pytest.mark.parametrize("name", ["chain", "brush"])
def test_large_components_are_split_by_joins(spark, name):
    parent = dict(forests())[name][:150]
    value = np.arange(len(parent)) * 7 % 11
    rows = [(f"n{k}", f"n{p}" if p >= 0 else None, int(v), 1) for k, (p, v) in enumerate(zip(parent, value, strict=True))]
    df = spark.createDataFrame(rows, "id string, parent string, a long, b long")
    got = {r.id: (r.a, r.b) for r in prefix_trie.subtree_sums(df, ["a", "b"], Scratch(spark, "t"), 40).collect()}
    a, b = sums_of(parent, value), sums_of(parent, np.ones(len(parent), int))
    assert got == {f"n{k}": (a[k], b[k]) for k in range(len(parent))}
    assert prefix_trie.subtree_sums(df.limit(0), ["a"], Scratch(spark, "t")).count() == 0
