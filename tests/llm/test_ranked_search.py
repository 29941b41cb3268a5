"""Ranked search against brute force, bounds against exact scores, and odd rows."""

import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ranked_search

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall((text or "").encode().lower())


def brute(docs, items, k=20):
    docs = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, tf, size in docs:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in words(text))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, r, s[2], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit("x")).withColumn("term", F.lit(1)).repartition(parts)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0)).withColumn("iid", F.lit(""))
    rows = ranked_search.ranked(d, q, k).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=repr)


def made(seed, n):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["ÀÉ", "à", "Ω7"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    return [(i, " ".join(r.choice(vocabulary, int(r.integers(0, 60) if i % 50 else 3000), p=weights / weights.sum()))) for i in range(n)]


def test_odd_rows_equal_brute_force(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "Tie word"), (5, "tie WORD"), (5, "tie WORD"), (None, "tie word"), (6, "ÀÉ àé word-word_word"), (7, "long " * 100_000 + "tie"), (8, "a b"), (9, "k1 K1 k1")]
    items = [(1, "tie word tie"), (1, "tie word tie"), (2, None), (3, ""), (4, "missing"), (5, "ÀÉ à word"), (6, "a B k1 long"), (7, "k1")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs[:3], items) == [] and found(spark, docs, items[2:4]) == []


def test_blocks_of_queries_and_copies(spark, monkeypatch):
    """Several blocks of queries and of documents; a third of the documents are one text, another part near copies."""
    monkeypatch.setattr(ranked_search, "QUERIES", 7)
    monkeypatch.setattr(ranked_search, "COLUMNS", 48)
    docs = made(1, 500)
    docs += [(1000 + i, docs[7][1]) for i in range(300)] + [(2000 + i, docs[9][1] + f" w{i}") for i in range(100)]
    items = [(i, t) for i, t in made(2, 25)] + [(100, docs[7][1]), (101, docs[9][1])]
    assert found(spark, docs, items, 5) == brute(docs, items, 5)


@pytest.mark.parametrize("bits", [2, 10])
def test_bounds_are_never_below_scores(bits, monkeypatch):
    monkeypatch.setattr(ranked_search, "BITS", bits)
    docs = made(3, 300)
    lot = ranked_search._Lot()
    for i, t in docs:
        lot.add(i, i, t.encode())
    rows = [r for b in lot.batches(20) for r in b.to_pylist()]
    df = {r["term"]: r["df"] for r in rows if r["kind"] == 1}
    n, total = next((r["df"], r["total"]) for r in rows if r["kind"] == 2)
    pairs = [SimpleNamespace(iid=i, term=w, n=c, df=df[w]) for i, t in made(4, 20) for w, c in Counter(words(t)).items() if w in df]
    q = ranked_search.Compiled(pairs, n, total)
    text, slack = {i: t.encode() for i, t in docs}, []
    for r in (r for r in rows if r["kind"] == 0):
        bound = q.bounds(r["size"], r["bits"], np.array(r["sizes"]))
        for c, rid in enumerate(r["rids"]):
            exact = np.array(q.exact(text[rid], q.iids))
            assert (bound[:, c] >= exact).all()
            slack.append((bound[:, c] - exact).sum() / max(exact.sum(), 1))
    assert len(slack) == len({i for i, t in docs if words(t)}) and (bits < 10 or np.median(slack) < 0.2)


def test_few_documents_are_scored_exactly(spark):
    docs = made(5, 3000)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.col("doc_id"))
    index = ranked_search.index(d, 10).cache()
    n, total = index.where("kind = 2").agg(F.sum("df"), F.sum("total")).first()
    items = spark.createDataFrame([(i, t) for i, t in made(6, 12) if t], "item_id long, text string")
    pairs = ranked_search.queries(items).join(index.where("kind = 1").groupBy("term").agg(F.sum("df").alias("df")), "term").collect()
    q = ranked_search.Compiled(pairs, n, total)
    exact = {iid: sorted((-s, i) for (i, t) in docs for s in q.exact(t.encode(), [iid])) for iid in q.iids}
    q.floors = np.array([-exact[iid][9][0] for iid in q.iids], np.float64)
    chosen = ranked_search._bounded(index.where("kind = 0"), lambda: q, 10).collect()
    assert {(iid, d) for iid in q.iids for _, d in exact[iid][:10]} <= {(r.iid, r.rid) for r in chosen}
    assert len(chosen) < 0.1 * len(docs) * len(q.iids)
