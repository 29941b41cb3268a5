"""Repeated rows, thresholds, odd vectors and long conversations against brute force."""

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, line_dedup, mixing, queries, rp_forest

SAID = "\\### Assistant: </turn> ok"


def mixed(rows, budgets, epochs, seed=7):
    """(id, domain, lang, source, epoch) of chosen rows, one by one, for leaves' known budgets; repeats follow each other."""
    out = []
    for leaf, budget in budgets.items():
        own = [(i, len(t.split())) for i, t, *k in rows if tuple(k) == leaf]
        total = sum(n for _, n in own)
        for e in range(epochs):
            start = e * total
            for i, n in sorted(own, key=lambda r: (hashlib.md5(f"{seed}-{e}-{r[0]}".encode()).hexdigest(), r)):
                if start < budget:
                    out.append((i, *leaf, e))
                start += n
    return sorted(out)


def test_mixing_repeated_rows(spark):
    rows = [(1, "a b c", "en", "src1"), (1, "a b c", "en", "src12"), (7, "x " * 9, "fr", "src3")] + [(5, "w x y z", "en", "src1")] * 10 + [(k, "one two", "en", "src1") for k in range(20, 29)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("budget", F.lit("clash")).withColumn("task", F.lit(1)).repartition(5)
    for share, epochs in ((0.5, 1), (0.5, 2), (1.4, 2), (2.0, 2)):
        got = mixing.mix(df, share=share, epochs=epochs).collect()
        supply = {k: sum(len(t.split()) for _, t, *own in rows if tuple(own) == k) for k in {(r[2], r[3]) for r in rows}}
        slim = spark.createDataFrame([("web" if s != "src12" else "reference", lang, s, n) for (lang, s), n in supply.items()], "domain string, lang string, source string, tokens long")
        budgets = {(r.lang, r.source): r.budget for r in mixing.leaf_budgets(slim, share, epochs).collect()}
        assert sorted((r.doc_id, r.lang, r.source, r.epoch) for r in got) == mixed(rows, budgets, epochs)
        for leaf, budget in budgets.items():
            sizes = [r.n_tokens for r in got if (r.lang, r.source) == leaf]
            assert budget <= sum(sizes) + 1e-6 and sum(sizes) - (max(sizes) if sizes else 0) < budget


def test_mixing_many_copies_without_an_id(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"))
    got = mixing.mix(df.repartition(6), share=0.5, epochs=1)
    assert got.count() == 1500 and got.agg(F.sum("n_tokens")).first()[0] == 3000


@pytest.mark.parametrize("least", [3, 40, 60])
def test_line_dedup_brute_force(spark, least):
    r = np.random.default_rng(1)
    sites = {k: int(n) for k, n in enumerate([1, 2, 3, 4, 5, 38, 39, 40, 41, 44, 59, 60, 61, 75, 150])}
    pages = [(s, f"http://www.h{s}.org/x", "".join(f"<p>line {k}</p>" for k, n in sites.items() if s < n) + f"<p>own {s}</p>\n\n") for s in range(150)]
    pages += pages[:30] + [(900, None, "<p>line 14</p>"), (901, "http://h1.org", None), (902, "no url", ""), (903, "http://a.b", "<p>" + "word " * 50000 + "</p>")] + [(904 + k, "http://one.site/", "<p>own line of one site</p>") for k in range(200)]
    df = spark.createDataFrame([pages[i] for i in r.permutation(len(pages))], "page_id long, url string, html string").withColumn("hashes", F.lit(0)).withColumn("rid", F.lit(0))
    text, site = line_dedup.page_text(F.col("html")), line_dedup.site_of(F.col("url"))
    got = line_dedup.remove_boilerplate(df, text, site, min_sites=least).collect()
    plain = {x.page_id: (x.t or "", x.s) for x in df.select("page_id", text.alias("t"), site.alias("s")).collect()}
    where: dict[str, set] = {}
    for t, s in plain.values():
        for line in t.split("\n"):
            if line.strip() and s:
                where.setdefault(" ".join(line.split()), set()).add(s)
    gone = {k for k, v in where.items() if len(v) >= least}
    assert len(got) == len(pages) and len(gone) == sum(n >= least for n in sites.values())
    for x in got:
        lines = plain[x.page_id][0].split("\n")
        kept = [y for y in lines if " ".join(y.split()) not in gone]
        assert (x.n_lines, x.n_removed, x.kept) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    marks = spark.createDataFrame([(k, f"s{i}") for k, n in sites.items() for i in range(n)], "h long, site string")
    found = {x.h: x for x in line_dedup.boilerplate_lines(marks, least).collect()}
    assert set(found) == {k for k, n in sites.items() if n >= least}
    assert all(x.n_sites == sites[x.h] for x in found.values() if x.exact) and (least > 40 or any(not x.exact for x in found.values()))
    assert line_dedup.remove_boilerplate(df.limit(0), text, site, min_sites=least).count() == 0


def links_of(rows, least=0.9):
    n, x = len(rows), []
    for _, v in rows:
        fine = v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x.append(np.array(v) / np.linalg.norm(v) if fine else None)
    near = [[i != j and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= least for j, b in enumerate(x)] for i, a in enumerate(x)]
    label = [r[0] for r in rows]
    for _ in range(n):
        for i in range(n):
            label[i] = min([label[i]] + [label[j] for j in range(n) if near[i][j]])
    return sorted((rows[i][0], sum(near[i]), label[i], label[i] == rows[i][0]) for i in range(n))


@pytest.mark.parametrize("leaf_rows", [512, 8])
def test_forest_lengths_and_odd_vectors(spark, leaf_rows, monkeypatch):
    monkeypatch.setattr(rp_forest, "CHUNK", 16)
    r = np.random.default_rng(6)
    rows = [(i, [float(v) for v in r.normal(size=2)]) for i in range(40)] + [(100 + i, [float(v) for v in r.normal(size=3)]) for i in range(30)]
    rows += [(300, [1.0, 2.0, 3.0]), (301, [2.0, 4.0, 6.0]), (302, [1e200, 2e200, 3e200]), (303, [1e-9, 2e-9, 3e-9]), (304, None), (305, []), (306, [0.0, 0.0]), (307, [1.0, None]), (308, [float("inf"), 1.0]), (309, [float("nan")] * 3), (310, [1.0]), (311, [5.0]), (312, [-5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("d", F.lit(0)).withColumn("codes", F.lit("x"))
    got = sorted(tuple(x) for x in rp_forest.embedding_links(df, trees=8, leaf_rows=leaf_rows).select("vec_id", "n_links", "component_id", "kept").collect())
    usual = [x for x in rows if x[0] != 302]  # whose squares overflow in the comparison below
    want = {x[0]: x for x in links_of(usual)}
    if leaf_rows == 512:
        for x in got:
            if x[0] not in (300, 301, 302, 303) and 302 not in x:
                near = {i for i, v in usual if v and len(v) == 3}
                assert x == want[x[0]] or x[0] in near
    assert len(got) == len(rows) and all(n == 0 and kept for i, n, _, kept in got if 304 <= i < 310)
    assert {x[0]: x[1] for x in got}[310] == 1 and {x[0]: x[2] for x in got}[311] == 310 and {x[0]: x[1] for x in got}[312] == 0
    some = {x[0]: x for x in got}
    assert some[300][1] >= 2 and some[301][2] == some[300][2]


def test_forest_recall_at_depth(spark, monkeypatch):
    """Planted pairs at three cosines, trees of depth 6, several leaves over CHUNK: what is linked, counted and named against brute force."""
    monkeypatch.setattr(rp_forest, "CHUNK", 64)
    r, n = np.random.default_rng(3), 6000
    x = r.normal(size=(n, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k, cosine in enumerate((0.905, 0.92, 0.95)):
        at = np.arange(k * 300, k * 300 + 300)
        other = r.normal(size=(300, 48))
        other -= (other * x[at]).sum(axis=1, keepdims=True) * x[at]
        other /= np.linalg.norm(other, axis=1, keepdims=True)
        x[3000 + at] = cosine * x[at] + np.sqrt(1 - cosine**2) * other
    center = r.normal(size=48)
    x[4500:5200] = center / np.linalg.norm(center) + r.normal(size=(700, 48)) * 0.04  # a hot cluster, many links each
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(rp_forest.embedding_links(df, leaf_rows=64).collect())
    links = np.array([g.n_links for g in got])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.97 * near.sum()
    label = np.arange(n)
    while not np.array_equal(label, after := np.minimum(label, np.where(near, label[None, :], n).min(axis=1))):
        label = after
    assert np.mean([g.component_id == label[g.vec_id] for g in got]) > 0.99 and all(g.kept == (g.component_id == g.vec_id) for g in got)


def test_chat_query_digests(spark, tmp_path):
    rows = [(1, 1, "assistant", SAID), (1, 0, "user", "hi: ### a"), (2, 0, "system", None), (2, 2, "assistant", "x" * 300000), (2, 3, "assistant", ""), (3, None, None, "\\"), (-1, 0, "assistant", "a\\"), (-1, 0, "assistant", "a\\")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op3_chat_formatting(spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows += [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]
    for c in {r[0] for r in rows}:
        turns = [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), digest(loss)) and got[c].formatted_chars == len(chat.template(turns))
    assert len(got) == 5
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).count() == 0


def test_chat_long_conversation():
    turns, began = [("user" if k % 2 else "assistant", f"{k} said: " + "word " * 40) for k in range(3000)], time.time()
    whole, spans, rewrites = chat.locate(chat.template, turns)
    assert not rewrites and [chat.unescape(whole[s["text_start"] : s["text_end"]]) for s in spans] == [t for _, t in turns] and time.time() - began < 60
    cut = lambda turns: "".join(t[:3] for _, t in turns)  # noqa: E731  a template that changes texts
    assert chat.locate(cut, [("u", "abcdef")])[1][0]["text_start"] in (0, 3)
    upper = lambda turns: "".join(f"<{t.upper()}>" for _, t in turns)
    assert [(s["text_start"], s["text_end"]) for s in chat.locate(upper, [("u", "ab"), ("u", "")])[1]] == [(1, 3), (5, 5)]
