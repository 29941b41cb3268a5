"""Search, answers, pages, files and extraction on small cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import answers, chunking, extract, graph, pages, recall, search
from loomgraph.plans.registry import QUERIES
from loomgraph.sources import files

DATA = "/root/testdata/sf0.001"
HIT = "query_id int, source_config_id string, chunk_id string, heading string, content string, score double, pos int"


def test_knn_and_grep_odd_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [1.0]), (8, [1.0, 1.0])], "id int, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0])], "query_id int, q array<double>")
    assert [(r.query_id, r.id, round(r.score, 4)) for r in recall.knn(q, v, 5).orderBy("rn").collect()] == [(1, 1, 1.0), (1, 8, 0.7071)]
    chunks = spark.createDataFrame([("a", "x X x", 0), ("b", None, 1), ("c", "", 2)], "chunk_id string, content string, rank int")
    got = recall.grep(spark.createDataFrame([("x",), ("",), (" ",), (None,)], "pattern string"), chunks, 5).collect()
    assert [(r.pattern, r.chunk_id, r.hits) for r in got] == [("x", "a", 3)]


def test_index_equals_plain_bm25_and_falls_back(spark, tmp_path):
    rows = [(f"c{i}", f"word{i % 7} common the word{i % 5} the" + " special-thing" * (i == 3), i) for i in range(60)] + [("n", None, 99)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, rank int")
    queries = spark.createDataFrame([(1, "word3 the"), (2, "word1 word4 missing"), (3, "ecial-th"), (4, None)], "query_id int, text string")
    search.write_index(chunks, str(tmp_path / "i"), "2024-01-01")
    for postings in (search.bm25_index(chunks), search.read_index(spark, str(tmp_path / "i"))):
        got = {(r.query_id, r.chunk_id, r.rn): r.score for r in search.bm25_search(queries, postings, 6).collect()}
        want = {(r.query_id, r.chunk_id, r.rn): r.score for r in recall.bm25(queries, chunks, 6).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    found = search.lexical_channel(queries, search.bm25_index(chunks), chunks, 6).where("query_id = 3").collect()
    assert [(r.chunk_id, r.score, r.rn) for r in found] == [("c3", 1.0, 1)]
    plan = search.bm25_search(queries, search.read_index(spark, str(tmp_path / "i")), 6)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters" in plan


def test_ann_recall(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 24))[r.integers(0, 40, 4000)] + r.normal(size=(4000, 24)) * 0.6
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(9999, [float("nan")] * 24), (9998, None)], "id int, v array<double>")
    search.ivf_index(v, 32, str(tmp_path / "ivf"))
    q = v.where("id % 40 = 0").selectExpr("id AS query_id", "v AS q")
    exact = {(a.query_id, a.id) for a in recall.knn(q, v, 10).collect()}
    near = search.ann(q, str(tmp_path / "ivf"), 10, nprobes=8)
    assert len(exact & {(a.query_id, a.id) for a in near.collect()}) >= 0.95 * len(exact)


def test_fusion_gate_content_and_boilerplate(spark):
    queries = spark.createDataFrame([(1, "steam engine"), (2, "nothing alike"), (3, "steam engine")], "query_id int, text string")
    semantic = spark.createDataFrame([
        (1, "s", "a", "", "about a steam engine", 0.6, 1), (1, "s", "b", "", "weather", 0.9, 2), (1, "s", "", "h", "same text", 0.5, 3), (1, "s", None, "h", "same text", 0.7, 4),
        (2, "s", "x", "", "strong", 0.9, 1), (2, "s", "y", "", "weak", 0.3, 2), (3, "s", "p", "", "新浪首页 权利保护声明", 0.9, 1), (3, "s", "k", "", "steam engine", 0.2, 2),
    ], HIT)
    lexical = spark.createDataFrame([(1, "s", "a", "", "about a steam engine and more", 0.4, 1), (3, "s", "q", "", "新浪首页 权利保护声明 x", 0.3, 1)], HIT)
    got = search.fuse_sections(queries, semantic, lexical, 8).orderBy("query_id", "pos").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "a"), (2, "x"), (3, "k"), (3, "q")] or [(r.query_id, r.chunk_id) for r in got] == [(1, "a"), (2, "x"), (3, "q"), (3, "k")]
    first = got[0]
    assert first.content == "about a steam engine and more" and (first.n_candidates, first.n_relevant, first.has_more) == (3, 1, False)
    assert first.score == pytest.approx(min(1, 0.5 * 0.6 + 0.2 * 1 + 0.3 * (0.55 + 0.35) + 0.15))
    one = search.fuse_sections(queries.where("query_id = 1"), semantic, lexical, 8).select("chunk_id", "score").collect()
    assert [tuple(r) for r in one] == [(first.chunk_id, first.score)]  # alone as in the batch


def test_parent_and_code_context(spark):
    chunks = spark.createDataFrame([
        ("s", "p", "PH", "parent text", "parent", None, None, None, "def f"), ("s", "c1", "", "child", "child", "p", None, None, None), ("s", "c2", "", "child two", "child", "gone", None, None, None), ("s", "n", "", "plain", None, None, None, None, None),
        ("s", "k", "", "code", "code_child", "q", "a.py", "m.f", None), ("s", "q", "", "class", "code_parent", None, "a.py", "m", "class A"), ("s", "k2", "", "code2", "code_child", "q2", "b.py", None, None), ("s", "q2", "", "whole", "code_parent", None, "b.py", "m", "class B"),
    ], "source_config_id string, chunk_id string, heading string, content string, chunk_type string, parent_id string, relative_path string, qualified_name string, signature string")
    hits = lambda *ids: spark.createDataFrame([(1, "s", c, "", t, s, i) for i, (c, t, s) in enumerate(ids)], HIT)
    got = {r.chunk_id: (r.heading, r.content) for r in search.parent_context(hits(("c1", "child", 0.5), ("c2", "child two", 0.4), ("n", "plain", 0.3), ("u", "unknown", 0.1)), chunks).collect()}
    assert got == {"c1": ("PH", "parent text"), "c2": ("", "child two"), "n": ("", "plain"), "u": ("", "unknown")}
    assert {r.chunk_id for r in search.parent_context(hits(("c1", "child", 0.5), ("p", "parent text", 0.4)), chunks).collect()} == {"p"}
    kept = {r.chunk_id: r.content for r in search.code_context(hits(("k", "code", 0.9), ("q", "class", 0.5), ("k2", "code2", 0.3), ("q2", "whole", 0.3), ("n", "plain", 0.1)), chunks).collect()}
    assert kept == {"k": "File: a.py\nSymbol path: m.f\nParent: class A\n\ncode", "q2": "whole", "n": "plain"}
    docs = spark.createDataFrame([("s", "a.py", "new")], "source_config_id string, relative_path string, content_sha256 string")
    marked = chunks.withColumn("content_sha256", F.lit("old"))
    assert {r.chunk_id for r in search.drop_stale_revisions(hits(("k", "code", 1.0), ("k2", "code2", 1.0), ("n", "plain", 1.0)), marked, docs).collect()} == {"k2", "n"}


def test_rerank_keeps_order_on_failure(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "bbb"), (1, 3, "bb")], "query_id int, pos int, content string")
    queries = spark.createDataFrame([(1, "t")], "query_id int, text string")
    order = lambda scorer: [r.content for r in search.rerank(rows.coalesce(1), queries, scorer).orderBy("place").collect()]
    assert order(lambda t, c: c.str.len()) == ["bbb", "bb", "a"]
    assert order(lambda t, c: [float("nan")] * len(c)) == ["a", "bbb", "bb"] == order(lambda t, c: 1 / 0) == order(lambda t, c: [1.0])


def test_answers(spark):
    rows = spark.createDataFrame([("steam engine power", "It rained. The steam engine gave power! End.\n\nMore", "x"), (None, "one two", "x"), ("q", None, "x"), ("long", "long " * 100, "x")], "q string, c string, x string")
    got = [r.e for r in rows.select(answers.best_excerpt(F.col("q"), F.col("c")).alias("e")).collect()]
    assert got[0] == "The steam engine gave power!" and got[1] == "one two" and got[2] == "" and len(got[3]) <= 261 and got[3].endswith("…")
    queries = spark.createDataFrame([(1, "steam")], "query_id int, text string")
    made = answers.extractive_answer(queries, spark.createDataFrame([(1, i, f"Nothing. Steam {i}.") for i in range(1, 7)], "query_id int, rn int, content string")).first().answer
    assert made.split("\n") == [f"- Steam {i}. [{i}]" for i in range(1, 5)]
    cites = spark.createDataFrame([(q, n) for q in (1, 2) for n in (1, 2, 3, 4)], "query_id int, n int")
    said = spark.createDataFrame([(1, "see [3] and [9] and [1], [3]"), (2, "none [7]")], "query_id int, answer string")
    out = answers.finalize_citations(said, cites)
    assert {r.query_id: r.answer for r in out["answers"].collect()} == {1: "see [3] and  and [1], [3]", 2: "none "}
    assert sorted((r.query_id, r.place, r.n, r.level) for r in out["citations"].collect()) == [(1, 1, 3, "claim"), (1, 2, 1, "claim"), (2, 1, 1, "run"), (2, 2, 2, "run"), (2, 3, 3, "run")]
    refs = spark.createDataFrame([(1, 1, "HTTP://u:p@Example.org/A#x", "a"), (1, 2, "http://example.org/A", "again"), (1, 3, "ftp://no", "n"), (1, 4, "https://b.org", "b"), (1, 5, None, "z")], "query_id int, pos int, url string, title string")
    got = answers.external_citations(spark.createDataFrame([(1, "as in (http://Example.org/A#y).")], "query_id int, answer string"), refs).orderBy("rn").collect()
    assert [(r.url, r.title, r.mapped) for r in got] == [("http://example.org/A", "a", True), ("https://b.org", "b", False)]
    sections = spark.createDataFrame([(1, "s", "c1", "one", 0.5, 1), (1, "s", "c2", "two", 0.4, 2)], "query_id int, source_config_id string, chunk_id string, content string, score double, pos int")
    events = spark.createDataFrame([(1, "s", "c9", 0.3, 1), (1, "s", "c2", 0.9, 2), (1, "s", None, 1.0, 3), (1, "s", "missing", 1.0, 0)], "query_id int, source_config_id string, chunk_id string, score double, pos int")
    chunks = spark.createDataFrame([("s", "c9", "nine")], "source_config_id string, chunk_id string, content string")
    assert [(r.chunk_id, r.content, r.score, r.by_event) for r in answers.event_first_evidence(sections, events, chunks, 5).orderBy("rn").collect()] == [("c9", "nine", 0.3, True), ("c2", "two", 0.9, True), ("c1", "one", 0.5, False)]


def test_timeline_pages_walk_the_whole_order(spark):
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k // 3)  # noqa: E731  three events an instant
    rows = [(f"e{k:02d}", f"s{k % 2}", day(k), k % 2, None if k else "DELETED", day(k)) for k in range(46)]
    events = spark.createDataFrame(rows, "event_id string, source_config_id string, event_time timestamp, rank int, status string, created_time timestamp")
    want = {s: [r[0] for r in sorted((r for r in rows if r[1] == s and r[4] is None), key=lambda r: (-r[2].timestamp(), r[3], r[0]))] for s in ("s0", "s1")}
    got, cursor, first = {"s0": [], "s1": []}, None, {}
    for _ in range(6):
        page = pages.timeline_page(events, "2025-01-01", 5, cursor).orderBy("ordinal").collect()
        for r in page:
            assert r.ordinal == len(got[r.source_config_id]) + 1 and r.total == len(want[r.source_config_id])
            got[r.source_config_id].append(r.event_id)
        last = {r.source_config_id: r for r in page}
        cursor = spark.createDataFrame([(s, r.event_time, r.rank, r.event_id) for s, r in last.items()], "source_config_id string, event_time timestamp, rank int, event_id string")
        if not any(r.has_more for r in last.values()):
            break
        first = last
    assert got == want and first
    newer = pages.timeline_page(events, "2025-01-01", 50, cursor, newer=True).orderBy("ordinal").collect()
    for s in want:
        at = [r.event_id for r in newer if r.source_config_id == s]
        assert at == want[s][: len(at)] and len(at) == len(want[s]) - 1 and not any(r.has_more for r in newer)


def test_hubs_lose_no_pairs(spark):
    rows = [(f"e{i}", "hub") for i in range(40)] + [("e1", "x"), ("e2", "x"), ("e3", "y"), ("e1", "hub")]
    df = spark.createDataFrame(rows, "event_id string, entity_id string")
    for chunk in (7, 512):
        got = {(r.event_id, r.other_id): r.shared for r in graph.shared_entity_edges(df, chunk).collect()}
        assert len(got) == 780 and got[("e1", "e2")] == 2 and sum(got.values()) == 781


def test_files(spark, tmp_path):
    text = "这是一个用于测试的文本，包含许多汉字。" * 5
    for raw, name in ((b"\xef\xbb\xbfa\r\nb", "utf-8-sig"), (text.encode(), "utf-8"), (text.encode("gb18030"), "gb18030"), ("naïve café".encode("latin-1"), "cp1252"), ("ab".encode("utf-16"), "utf-16")):
        found = files.decoded(raw)
        assert found[1] == name and found[3] is None, name
    assert files.decoded(b"\xef\xbb\xbfa\r\nb")[0] == "a\nb" and files.decoded(text.encode("gb18030"))[0] == text
    assert [files.decoded(x)[3] for x in (b"a\0b", b"", b" None ", b"{}", b"\x01" * 50)] == ["nul", "empty", "empty", "empty", "control characters"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello")
    (tmp_path / "in/b.bin").write_bytes(b"\0")
    got = {r.path.split("/")[-1]: (r.text, r.rejected_reason) for r in files.load_text_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": ("hello", None), "b.bin": (None, "nul")}
    paths = [("/etc/x", None), ("C:\\x", None), ("a/../b", None), ("a\x01b", None), ("con.txt", None), ("src/a.cpp", None), ("x/.gitignore", None), ("a.ipynb", None), ("a.pdf", None), ("a.xlsx", None), ("what", "plain words"), ("what2", "\x01\x02\x03a"), (None, None), ("k/id_rsa", None)]
    routes = {r.path: (r.route, r.reason, r.selected) for r in files.route_files(spark.createDataFrame(paths, "path string, head string")).collect()}
    assert [routes[p][0] for p, _ in paths] == ["skip"] * 5 + ["code", "skip", "skip", "pdf", "office", "text", "skip", "skip", "skip"] and routes["k/id_rsa"][1] == "secret"
    df = spark.createDataFrame([("s", 1), (None, 2)], "source_config_id string, n int")
    for kind in ("parquet", "json"):
        files.write_result(df, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 2
    files.load_table(spark, str(tmp_path / "parquet"), "n int, source_config_id string")
    with pytest.raises(ValueError):
        files.load_table(spark, str(tmp_path / "parquet"), "n long")
    with pytest.raises(ValueError):
        files.load_table(spark, str(tmp_path / "parquet"), "m int")


def test_extraction_checkpoints_and_embedding(spark):
    chunks = spark.createDataFrame([("a", "Ann met Bob"), ("b", "no names"), ("c", "Boom"), ("d", None)], "chunk_id string, content string")

    def fn(text):
        if text == "Boom":
            raise ValueError("model")
        return extract.capitalized(text)

    first = extract.extract_events(chunks, fn).cache()
    assert {(r.chunk_id, tuple(r.entities or ()), bool(r.error)) for r in first.collect()} == {("a", ("Ann", "Bob"), False), ("b", (), False), ("c", (), True), ("d", (), False)}
    again = extract.extract_events(chunks, extract.capitalized, extract.finished(first)).collect()
    assert [(r.chunk_id, r.entities) for r in again] == [("c", ["Boom"])]
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "b a")], "doc_id int, text string")
    v = {r.doc_id: r.v for r in extract.embed(docs, "text").collect()}
    assert v[1] == v[3] and abs(sum(x * x for x in v[1]) - 1) < 1e-9 and not any(v[2])


def test_a_model_gets_few_texts_at_a_time(spark):
    docs = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("text"))
    rows = extract.embed(docs, "text", lambda: lambda texts: [[float(len(texts)), float(t or -1)] for t in texts]).collect()
    assert [(r.id, r.v[1]) for r in rows] == [(k, float(k) if k % 7 else -1.0) for k in range(1000)]
    assert max(r.v[0] for r in rows) <= 256


def test_chunks_keep_their_cap_and_parents(spark):
    text = "\n".join(f"line {i} " + "words " * (i % 9) for i in range(200)) + "\n# Head\n```\ncode\n\n  more\n```\n" + "| a | b |\n|---|---|\n| 1 | 2 |\n" + "Part one. Part two."
    for cap in (20, 64, 200):
        for _, _, content in chunking.assemble(text, cap, cap, True):
            assert chunking.tokens(content) <= cap or "\n" not in content or content.startswith("```")
    kinds = [(k, t) for k, _, t in chunking.split_blocks("a. b\n```\nc. d\n```\ne. f", r"\. ")]
    assert kinds == [("TEXT", "a"), ("TEXT", "b"), ("CODE", "```\nc. d\n```"), ("TEXT", "e"), ("TEXT", "f")]
    docs = spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string")
    rows = chunking.parent_child_chunks(docs, 100, 30).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(len(rows))) and {r.doc_id for r in rows} == {1}
    for g in {r.parent_group for r in rows}:
        own = [r for r in rows if r.parent_group == g]
        assert own[0].chunk_type == "parent" and all(r.chunk_type == "child" for r in own[1:]) and len(own) > 1
        assert "".join("".join(r.content.split()) for r in own[1:]) == "".join(own[0].content.split())


@pytest.mark.parametrize("name", ["ann", "extractive_answers", "decode_files", "extract_events", "embed_documents", "parent_child_chunks"])
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
