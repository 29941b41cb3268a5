"""Rows that repeat one row many times, and a page of very many lines: results stay whole and work stays linear."""

import hashlib
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, gru_lm, line_dedup, suffix_dedup, token_output


def repeated(spark, text, n, doc_id=7):
    return spark.range(n).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(8)


def test_suffix_dedup_of_one_repeated_row(spark):
    text = " ".join(f"w{k}" for k in range(250))
    more = spark.createDataFrame([(1, "a clean text of its own " * 3), (2, "start " + text)], "doc_id long, text string")
    began = time.time()
    rows = suffix_dedup.remove_repeats(repeated(spark, text, 20_000).unionByName(more)).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in rows} == {(7, len(text), 1, 20_000), (1, 0, 0, 1), (2, len(text), 1, 1)}
    assert time.time() - began < 120  # a quadratic step took 36 s for 4,000 rows


def test_long_page_of_lines(spark):
    lines = [f"line {k}" if k % 2 else f"own {k}" for k in range(100_000)]
    pages = spark.createDataFrame([(p, f"http://site{p}.org/x", "\n".join(x if k % 2 else f"{x} {p}" for k, x in enumerate(lines))) for p in range(12)], "page_id long, url string, html string")
    began = time.time()
    rows = line_dedup.remove_boilerplate(pages, F.col("html"), line_dedup.site_of(F.col("url"))).collect()
    assert all((r.n_lines, r.n_removed) == (100_000, 50_000) for r in rows) and len(rows) == 12
    assert all(r.kept == "\n".join(f"{x} {r.page_id}" for k, x in enumerate(lines) if not k % 2) for r in rows)
    assert time.time() - began < 120


def test_decontamination_of_one_repeated_row_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", -1)
    item = " ".join(f"b{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = repeated(spark, f"{item} tail", 5_000).unionByName(spark.createDataFrame([(8, "clean " * 30)], "doc_id long, text string"))
    rows = decontaminate.contamination(docs, bench).groupBy("doc_id", "n_hit", "n_words", "contaminated").count().collect()
    assert {tuple(r) for r in rows} == {(7, 20, 21, True, 5_000), (8, 0, 30, False, 1)}


def test_token_files_of_one_repeated_row(spark):
    docs = repeated(spark, "the same words again", 30_000).unionByName(spark.createDataFrame([(9, "last"), (1, "first")], "doc_id long, text string"))
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_output.token_output(docs, path).orderBy("start").collect()
    each = rows[1].n_tokens
    assert [r.doc_id for r in rows] == [1] + [7] * 30_000 + [9]
    assert [r.start for r in rows[1:]] == [rows[0].n_tokens + each * k for k in range(30_001)] and len({r.ids_crc32 for r in rows[1:-1]}) == 1
    made = f"{token_output.Scratch(spark, 'copies').root}/files"
    token_output.write_tokens(docs, made, path, 8)
    assert spark.read.parquet(made).select("part").distinct().count() > 4  # one key is cut over several writers


def test_gru_learns_from_a_stream_that_fills_no_lanes(monkeypatch):
    seen = []
    model = gru_lm.GatedLM(np.ones(6), hidden=4)
    real = model.gradient
    monkeypatch.setattr(model, "gradient", lambda source, target, h: seen.append(target.size) or real(source, target, h))
    model.train([np.tile([2, 3, 0], 100)[:271]], lanes=64, epochs=1)
    assert sum(seen) == 271
    assert hashlib.sha256(model.state().tobytes()).hexdigest() != hashlib.sha256(gru_lm.GatedLM(np.ones(6), hidden=4).state().tobytes()).hexdigest()
