"""Streams against the same rows in batch."""

import datetime as dt

from loomgraph.streaming import streams

SCHEMA = "id long, source string, ts timestamp"
ROWS = [(i % 40, f"s{i % 3}", dt.datetime(2024, 1, 1, 0, i % 30, tzinfo=dt.UTC)) for i in range(90)]


def collect(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_dedup_and_rates(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    assert sorted((r.id, r.source) for r in collect(streams.stream_dedup(stream, ["id", "source"]), "dedup", "append")) == sorted({(a, b) for a, b, _ in ROWS})
    rates = {(r.source, r.start.minute): r.per_minute for r in collect(streams.stream_rates(stream), "rates", "complete") if r.start.hour == 0 and r.start.day == 1}
    assert rates["s0", 5] == sum(s == "s0" and 5 <= t.minute < 15 for _, s, t in ROWS) / 10


def test_ingest_writes_each_version_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/docs")
    for _ in range(2):
        streams.stream_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp").start().awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_ingest_keeps_one_version_across_batches(spark, tmp_path):
    schema = "doc_id long, text string"
    for k, rows in enumerate([[(1, "a"), (2, "b")], [(1, "a"), (1, "c"), (3, None)], [(3, None), (2, "b"), (1, "a")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/docs/part={k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/docs/part=*")
        streams.stream_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp").start().awaitTermination(120)
    got = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "a"), (1, "c"), (2, "b"), (3, "")]


def test_microbatches_and_overview(spark, tmp_path):
    schema = "source string, id long"
    for k in range(3):
        spark.createDataFrame([(f"s{i % (k + 2)}", i) for i in range(10)] * 2, schema).coalesce(1).write.parquet(f"{tmp_path}/docs/part={k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/docs/part=*")
        for _ in range(2):  # the second run finds nothing new
            streams.stream_microbatch(stream, f"{tmp_path}/plan", f"{tmp_path}/cp1", size=2, once=True).start().awaitTermination(120)
            streams.stream_overview(stream, f"{tmp_path}/over", f"{tmp_path}/cp2").start().awaitTermination(120)
    counts = {r.source: r.n for r in streams.overview(spark, f"{tmp_path}/over").collect()}
    want: dict = {}
    for k in range(3):
        for i in range(10):
            want[f"s{i % (k + 2)}"] = want.get(f"s{i % (k + 2)}", 0) + 2
    assert counts == want
    planned = spark.read.parquet(f"{tmp_path}/plan").groupBy("trigger", "source", "batch").count().collect()
    assert all(r["count"] <= 2 for r in planned) and sum(r["count"] for r in planned) == 30


def test_conversations_across_triggers_are_one_document(spark, tmp_path):
    from loomgraph.operators.catalog import messages_to_documents

    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    at = lambda minutes: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minutes)
    said = [(c, k, "user" if k % 2 else "assistant", f"m{c}-{k}" if k else None, at(c * 3 + k * 7)) for c in range(6) for k in range(5)]
    end = [(99, 0, "x", "last", at(600))]
    triggers = [said[::3], said[1::3], said[2::3], end, [(99, 1, "x", "later", at(601))]]
    for k, rows in enumerate(triggers):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = streams.stream_conversations(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part=*"), delay="3 hours")
        for _ in range(1 + (k == 4)):  # run again: nothing is written twice
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(tuple(r) for r in messages_to_documents(spark.createDataFrame(said, schema)).collect()) and len(got) == 6


def test_open_batches_are_filled_by_later_triggers(spark, tmp_path):
    import time

    schema = "source string, id long"
    out = f"{tmp_path}/out"
    stream = streams.stream_batches(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part=*"), size=4, flush_ms=8000)
    (tmp_path / "in" / "part=x").mkdir(parents=True)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    try:
        for k in range(3):
            spark.createDataFrame([("a", 10 * k + i) for i in range(3)] + [("b", k)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
            for _ in range(120):
                if sum(p.numInputRows for p in query.recentProgress) == 4 * (k + 1):
                    break
                time.sleep(0.25)
        full = [r for r in spark.read.schema(streams.BATCHES).parquet(out).collect() if len(r.ids) == 4]
        assert [r.source for r in full] == ["a", "a"] and sorted(i for r in full for i in r.ids) == [0, 1, 2, 10, 11, 12, 20, 21]
        for _ in range(60):
            rows = spark.read.schema(streams.BATCHES).parquet(out).collect()
            if sum(len(r.ids) for r in rows) == 12:
                break
            time.sleep(0.5)
        assert sorted((r.source, r.batch, sorted(r.ids)) for r in rows)[2:] == [("a", 2, [22]), ("b", 0, [0, 1, 2])]
    finally:
        query.stop()
