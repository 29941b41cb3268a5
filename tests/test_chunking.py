"""Chunks and covers against small cases and brute force."""

from loomgraph.operators import chunking, explore
from loomgraph.plans.registry import QUERIES

TEXT = "intro\n# A\none two\n```py\nx = 1\n\n# no heading\n```\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n## B\nlast"


def test_blocks_protect_code_and_tables():
    assert [(k, h) for k, h, _ in chunking.blocks(TEXT)] == [("TEXT", ""), ("TEXT", "A"), ("CODE", "A"), ("TABLE", "A"), ("TEXT", "A"), ("TEXT", "B")]
    assert "\n".join(b for _, _, b in chunking.blocks(TEXT)) == TEXT
    assert list(chunking.blocks("")) == [] and [k for k, _, _ in chunking.blocks("~~~\nopen")] == ["CODE"]


def test_chunks_keep_every_line(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "\n".join(f"line {i} of it" for i in range(100)))], "doc_id long, text string")
    got = chunking.assemble_chunks(rows, 50, 50).orderBy("doc_id", "rank").collect()
    assert {r.doc_id for r in got} == {1, 4}
    assert "\n".join(r.content for r in got if r.doc_id == 4) == rows.where("doc_id = 4").first().text
    assert all(r.tokens <= 50 + 1 + r.content.count("\n") for r in got)
    assert [r.rank for r in got if r.doc_id == 4] == list(range(sum(r.doc_id == 4 for r in got)))


def test_whole_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["assemble_chunks"](spark, "/root/testdata/sf0.001").orderBy("doc_id", "rank").collect()
    kept = {}
    for r in got:
        kept.setdefault(r.doc_id, []).append(r.content)
    plain = lambda s: [x for x in s.split("\n") if x.strip()]
    assert {k: plain("\n".join(v)) for k, v in kept.items()} == {k: plain(v) for k, v in docs.items() if v and v.strip()}


def test_cover_prefers_uncovered_events(spark):
    pairs = [(e, "popular") for e in "123"] + [(e, "second") for e in "12"] + [("4", "rare-4"), ("5", "rare-5")]
    rows = spark.createDataFrame([("s", e, x, x) for e, x in pairs], "source_config_id string, event_id string, entity_id string, name string")
    assert [r.entity_id for r in explore.cover_entities(rows, 3).orderBy("pos").collect()] == ["popular", "rare-4", "rare-5"]
    assert [r.entity_id for r in explore.cover_entities(rows, 4).orderBy("pos").collect()] == ["popular", "rare-4", "rare-5", "second"]


def test_cover_query_has_budget(spark):
    got = QUERIES["cover_entities"](spark, "/root/testdata/sf0.001").groupBy("source_config_id").count().collect()
    assert got and max(r["count"] for r in got) <= 40
