"""Numbering, documents, folders, versions, snippets and states on small fixtures."""

import itertools

from pyspark.sql import functions as F

from loomgraph.operators import catalog, chunking, explore, extract, recall, relevance, work
from loomgraph.streaming import streams


def test_numbered_hot_key_and_odd_rows(spark):
    rows = spark.range(5000).selectExpr("'hot' AS source", "lpad(CAST(id * 7 % 5000 AS STRING), 5, '0') AS id").unionByName(spark.createDataFrame([("one", "x"), ("none", None), (None, "y")], "source string, id string"))
    found = recall.numbered(rows, "source", "id", ranges=16).collect()
    assert sorted((r.id, r.place) for r in found if r.source == "hot") == [(f"{i:05d}", i) for i in range(5000)]
    assert [(r.source, r.place) for r in found if r.source != "hot"] == [("one", 0)]
    assert recall.numbered(rows.where("false"), "source", "id").count() == 0


def test_batches_leave_out_scheduled_ids(spark):
    ids = spark.createDataFrame([("s", i % 9) for i in range(30)], "source string, id int")
    found = catalog.plan_batches(ids, 2, ids.where("id < 3")).collect()
    assert sorted((r.id, r.batch) for r in found) == [(3, 0), (4, 0), (5, 1), (6, 1), (7, 2), (8, 2)]


def test_split_retry_halves(spark):
    rows = [("a", 1, 1, True), ("a", 2, 1, True), ("a", 3, 1, True), ("b", 1, 1, True), ("c", 1, 9, False), ("c", 2, 9, False)]
    refs = spark.createDataFrame(rows, "job_id string, id int, attempts int, retryable boolean")
    found = {(r.job_id, r.id): (r.action, r.delay, r.part) for r in work.split_retry(refs, 8).collect()}
    assert found == {("a", 1): ("split", None, 0), ("a", 2): ("split", None, 1), ("a", 3): ("split", None, 1), ("b", 1): ("retry", 10, 0), ("c", 1): ("fail", None, 0), ("c", 2): ("fail", None, 0)}


def test_stall_reasons(spark):
    names = ["per_minute", "total", "pending", "paused", "queued", "running"]
    cases = [(0.0, 5, 5, 0, 0, 0), (0.0, 5, 5, 0, 2, 1), (0.0, 5, 5, 0, 0, 1), (0.0, 5, 0, 0, 0, 0), (0.0, 5, 4, 1, 0, 0), (1.0, 5, 5, 0, 0, 0), (0.0, 0, 0, 0, 0, 0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, per_minute double, total int, pending int, paused int, queued int, running int")
    found = [r.s for r in rows.withColumn("s", work.stall_reason(*map(F.col, names))).orderBy("i").collect()]
    assert found == ["no_worker", "queued_waiting", "running_in_progress", "idle", "paused", None, None]


def test_backfill_states(spark):
    items = spark.createDataFrame([("a", "entity_vectors", True), ("a", "chunk_vectors", True), ("b", "entity_vectors", False), ("c", "chunk_vectors", True)], "source string, table_name string, pending boolean")
    sources = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "source string")
    state = lambda d: {r.source: (r.pending, r.state) for r in work.backfill_status(items, sources, d).collect()}
    assert state(False) == {"a": (1, "backfilling"), "b": (0, "complete"), "c": (0, "complete"), None: (0, "unknown")}
    assert state(True)["b"] == (0, "deferred")
    over = lambda s: work.backfill_overall(work.backfill_status(items.where("false"), s, False)).first().state
    assert over(sources) == "complete" and over(sources.where("source IS NULL")) == "unknown" and over(sources.where("false")) == "unknown"


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "query_id int, recall double")
    assert relevance.recall_summary(none, none.selectExpr("query_id", "recall AS ms")).first().recall is None
    assert tuple(relevance.evaluation_rate(spark.createDataFrame([], "hit boolean")).first()) == (0, 0, None)


def test_grep_snippets(spark):
    text = "intro\n## [Big](http://x) Needle line\n" + "a" * 600 + " 2021-03-04 then needle here [see](http://y) end" + "b" * 900
    rows = [("c1", 0, "old", text), ("c2", 1, " own ", "x" * 200 + "needle"), ("c3", 2, None, None), ("c4", 3, "", "nothing")]
    chunks = spark.createDataFrame(rows, "chunk_id string, rank int, heading string, content string")
    patterns = spark.createDataFrame([("NEEDLE",), (" ",), ("a.b",), ("\\E",)], "pattern string")
    found = recall.grep_snippets(patterns, chunks, 5).orderBy("rn").collect()
    assert [(r.chunk_id, r.hits) for r in found] == [("c1", 2), ("c2", 1)]
    one, two = found
    assert one.best == text.lower().find("needle", 100) and one.snippet.startswith("2021-03-04 then needle here see end") and one.heading == "Big Needle line"
    assert two.best == 200 and two.snippet == "x" * 80 + "needle" and two.heading == "own"


def test_documents_from_pages_and_messages(spark):
    pages = spark.createDataFrame([(1, "https://h.org:8/a/b?q=1", "<title> T\n x</title><style>s</style><p>body</p>"), (2, "https://h.org/", "<script>x</script>"), (3, None, None)], "page_id int, url string, html string")
    one, two, three = catalog.html_document(pages).orderBy("page_id").collect()
    assert one.filename == "h.org:8-a-b.md" and one.content == "# T x\n\n> 来源：https://h.org:8/a/b?q=1\n\nT\n x body\n"
    assert (two.content, two.error, two.filename, three.error) == (None, "no body", "h.org-h.org.md", "no body")
    talk = spark.createDataFrame([(1, 2, "user", None, None), (1, 1, None, "Ann", "hi")], "conv_id int, turn int, role string, author string, text string")
    assert catalog.messages_to_documents(talk).first().text == "# 消息\n\n\n\n**Ann**：hi\n\n**user**："


def test_folder_caps(spark):
    listing = spark.createDataFrame([("s", f"r/{i}.txt", "a" * 64, 10) for i in range(3)] + [("t", None, None, None)], "source string, path string, sha256 string, size_bytes long")
    reasons = lambda **k: sorted((r.source, r.status, r.reason) for r in catalog.folder_plan(listing, listing.where("false"), "r", **k).collect() if r.reason)
    assert reasons() == [("t", "rejected", "path")]
    assert [r[2] for r in reasons(most_items=2)] == ["too many files"] * 3 + ["path"] and [r[2] for r in reasons(most_total=29)] == ["too many bytes"] * 3 + ["path"]


def test_upsert_writes_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(x, "id int, v string, at int")
    assert catalog.upsert(rows((1, "a", 1), (1, "b", 2), (2, "c", 1)), path, "id", "at") == {"inserted": 2, "updated": 0, "kept": 0}
    assert catalog.upsert(rows((2, "d", 5), (3, "e", 5)), path, "id", "at") == {"inserted": 1, "updated": 1, "kept": 1}
    assert sorted((r.id, r.v) for r in catalog.upserted(spark, path).collect()) == [(1, "b"), (2, "d"), (3, "e")]


def test_explorations_are_appended(spark, tmp_path):
    steps = spark.createDataFrame([("s1",)], "session_id string")
    for i in (1, 2):
        explore.save_exploration(spark.createDataFrame([(f"s{i}", "u", " q" * 60, i)], "session_id string, owner string, title string, updated_at int"), steps, str(tmp_path))
    found = explore.exploration_list(spark.read.parquet(f"{tmp_path}/sessions"), spark.read.parquet(f"{tmp_path}/steps")).orderBy("rn").collect()
    assert [(r.session_id, r.steps) for r in found] == [("s2", 0), ("s1", 2)]


def test_overview_without_marks_is_fresh(spark):
    old, new = (spark.createDataFrame([("a", i), ("b", i)], "k string, n int") for i in (1, 2))
    dirty = spark.createDataFrame([("a",)], "k string")
    counts = lambda p, d: sorted(map(tuple, explore.overview_incremental(p, new, d, "k").collect()))
    assert counts(old, dirty) == [("a", 2), ("b", 1)] and counts(old, dirty.where("false")) == counts(None, dirty) == [("a", 2), ("b", 2)]


def test_block_offsets(spark):
    parts = ["# A\n", "\n", "```\ncode\n", "```\n", "| a |\n|---|\n| b |\n", "text", " more\n", "~~~\nopen"]
    for n in range(1, len(parts) + 1):
        for chosen in itertools.combinations(parts, n):
            text = "".join(chosen)
            assert all(text[at : at + len(body)] == body for _, _, body, at in chunking.placed_blocks(text))
    rows = chunking.split_blocks_table(spark.createDataFrame([(1, "x\n```\ny\n```"), (2, None), (3, "")], "doc_id long, text string")).orderBy("n").collect()
    assert [(r.doc_id, r.kind, r.start, r.end) for r in rows] == [(1, "TEXT", 0, 1), (1, "CODE", 2, 11)]


def test_children_are_repaired(spark):
    raw = '{"name": "a", "type": "x", "children": [{"person": "b", "name": "b", "children": [{"person": "c", "name": "c"}]}]}'
    tree = spark.createDataFrame([(raw,), ('{"name": "q"}',), (None,)], "raw string").select(extract.normalize_tree(F.col("raw"), ["person"]).alias("t")).collect()
    child = tree[0].t.children[0]
    assert child.entity["type"] == "person" and child.children[0].entity["type"] == "person" and tree[1].t.children is None


def test_ingested_documents_are_cut_once(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
        streams.stream_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp", f"{tmp_path}/pieces").start().awaitTermination(120)
    assert [(r.doc_id, r.content) for r in spark.read.parquet(f"{tmp_path}/pieces").collect()] == [(1, "a\nb")]
