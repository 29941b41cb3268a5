"""From chunks to events, entities, their relations and vectors, in batches that a later run goes on from."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch
from .catalog import chunk_document_rank, missing_vector_ids
from .extract import embed, hashed, normalize_entities
from .merge import _files, merge_rows, merged

CHUNK = "chunk_id string, source_config_id string, document_id string, place long"
RAW = f"{CHUNK}, position int, title string, entities array<struct<raw: string, weight: double>>, error string"
PER_TASK = 4096  # chunks of a batch for each task; a batch is what a broken-off run loses at most
Found = list[tuple[str, list[tuple[dict, float]]]]  # (title, [(entity, weight)]) of each event


def typed_words(text: str) -> Found:
    """A stand-in for a model: one event whose entities are the capitalised words, weighted by how often they occur; none without such a word.

    Words without small letters are initials. The type is given as a model sometimes does, as a key of its own.
    """
    counts: dict[str, int] = {}
    for w in (text or "").split():
        if w[:1].isupper():
            w = w.strip(".,;:!?")
            counts[w] = counts.get(w, 0) + 1
    title = (text or "").split("\n")[0][:60]
    made = [({"initials" if w == w.upper() else "word": w, "name": w, "description": title}, float(n)) for w, n in counts.items()]
    return [(title, made)] if made else []


TYPES = ["initials", "word"]


def id_of(*parts: Column) -> Column:
    """The same for the same parts, in every run."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def extracted(spark: SparkSession, path: str) -> DataFrame:
    """Rows RAW of the finished batches below ``path``. A chunk that failed in one batch and not in a later one has rows of both."""
    where, files = _files(spark, f"{path}/raw")
    files.mkdirs(where)
    return spark.read.schema(f"{RAW}, batch string").parquet(f"{path}/raw").drop("batch")


def _extract(batch: DataFrame, fn: Callable[[str], Found]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for chunk in f.itertuples(index=False):
                head = (chunk.chunk_id, chunk.source_config_id, chunk.document_id, chunk.place)
                try:
                    found = [(i, title, [{"raw": json.dumps(e), "weight": w} for e, w in entities], None) for i, (title, entities) in enumerate(fn(chunk.content))]
                    out += [head + x for x in found] or [(*head, None, None, None, None)]
                except Exception as e:  # noqa: BLE001  a failure concerns its chunk only
                    out.append((*head, None, None, None, f"{type(e).__name__}: {e}"))
            names = ["chunk_id", "source_config_id", "document_id", "place", "position", "title", "entities", "error"]
            yield pd.DataFrame(out, columns=names).astype({"place": "Int64", "position": "Int32"})

    return batch.mapInPandas(run, RAW)


def extract_batches(chunks: DataFrame, path: str, fn: Callable[[str], Found] = typed_words, per_task: int = PER_TASK, pause: Callable[[], bool] = lambda: False) -> dict[str, int | bool]:
    """Extracts ``chunks(chunk_id, source_config_id, document_id, place, content)`` into ``path``; counts of chunks of the table.

    Each batch takes its place in one step once it is written, and the finished batches are the checkpoint: a run that was broken off, or paused (``pause`` is asked
    before each batch), goes on with the chunks that have no rows there or only an error. Chunks with the same id count once (the smallest row), a null id is the
    empty one, null texts are given to ``fn`` as they are. One run at a time for a path.
    """
    spark = chunks.sparkSession
    scratch = Scratch(spark, "extraction")
    rest = F.struct("source_config_id", F.col("document_id").cast("string").alias("document_id"), F.col("place").cast("long").alias("place"), "content")
    keyed = chunks.select(F.coalesce(F.col("chunk_id").cast("string"), F.lit("")).alias("chunk_id"), rest.alias("c"))
    done = extracted(spark, path).where("error IS NULL").select("chunk_id").distinct()
    left = keyed.join(done, "chunk_id", "left_anti").groupBy("chunk_id").agg(F.min("c").alias("c")).select("chunk_id", "c.*")
    left = scratch.save(left, "left")
    n, tasks = left.count(), spark.sparkContext.defaultParallelism
    batches = -(-n // (per_task * tasks))
    # A batch is cut over as many files as there are tasks to read it.
    cut = left.withColumn("batch", F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, batches)))).withColumn("_part", F.pmod(F.hash("chunk_id"), F.lit(tasks)))
    cut.repartition("batch", "_part").drop("_part").write.partitionBy("batch").parquet(f"{scratch.root}/cut")
    scratch.drop("left")
    # Each batch is read by its folder: a filter on the whole cut would list all files for every batch, and send the lists to the driver.
    where, files = _files(spark, f"{scratch.root}/cut")
    folders = sorted(str(s.getPath()) for s in files.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith("batch="))
    for folder in folders:
        if pause():
            break
        batch = spark.read.schema(f"{CHUNK}, content string").parquet(folder)
        new = f"{path}/raw/_{uuid.uuid4().hex}"  # readers pass over such names
        _extract(batch, fn).write.parquet(new)
        source, files = _files(spark, new)
        if not files.rename(source, _files(spark, f"{path}/raw/batch={uuid.uuid4().hex}")[0]):
            raise RuntimeError(f"a batch of {path} was not put in its place")
    scratch.drop("cut")
    return progress(keyed.select("chunk_id"), path)


def progress(chunks: DataFrame, path: str) -> dict[str, int | bool]:
    """Chunks, processed ones, those of them without events, failed ones, events; paused if chunks are left that were not tried."""
    state = extracted(chunks.sparkSession, path).groupBy("chunk_id").agg(F.max(F.col("error").isNull()).alias("ok"), F.count("position").alias("events"))
    rows = chunks.select(F.coalesce("chunk_id", F.lit("")).alias("chunk_id")).distinct().join(state, "chunk_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    r = rows.agg(F.count("*").alias("chunks"), n(F.col("ok")).alias("processed"), n(F.col("ok") & (F.col("events") == 0)).alias("eventless"), n(~F.col("ok")).alias("failed"), F.coalesce(F.sum("events"), F.lit(0)).alias("events")).first().asDict()
    return {**r, "paused": r["processed"] + r["failed"] < r["chunks"]}


def event_tables(raw: DataFrame, types: list[str]) -> dict[str, DataFrame]:
    """The tables events, entities and event_entity of rows RAW; ids depend on chunks and names only, so a run that is repeated gives the same.

    Events are numbered in their document by place of chunk, position and id. Entities are one per (source, type, normalized name): blanks are one, case does
    not count, ``types`` repairs types as ``normalize_entities`` does, a missing one is "unknown". Entities without a name are none. An entity has the smallest
    of its names, a relation its largest weight (1 where there is none); both have the description of the first event that gives one.
    """
    source = F.coalesce("source_config_id", F.lit("")).alias("source_config_id")
    rows = raw.where("position IS NOT NULL").withColumn("source_config_id", source).withColumn("event_id", id_of(F.col("chunk_id"), F.col("position")))
    flat = rows.select("event_id", "source_config_id", "document_id", "chunk_id", "title", F.col("position").alias("rank"))
    places = raw.groupBy("chunk_id").agg(F.min("place").alias("place"))
    events = chunk_document_rank(flat, places).withColumn("status", F.lit(None).cast("string")).select("event_id", "source_config_id", "document_id", "chunk_id", "title", "rank", "status")
    entity = normalize_entities(F.col("e.raw"), types)
    told = rows.select("event_id", "source_config_id", F.explode("entities").alias("e")).select("event_id", "source_config_id", F.col("e.weight").alias("weight"), entity.alias("m"))
    at = lambda k: F.nullif(F.trim(F.element_at("m", F.lit(k))), F.lit(""))
    told = told.select("event_id", "source_config_id", "weight", at("name").alias("name"), F.coalesce(at("type"), F.lit("unknown")).alias("type"), at("description").alias("description")).where("name IS NOT NULL")
    told = told.withColumn("normalized_name", F.lower(F.regexp_replace("name", r"\s+", " ")))
    told = told.withColumn("entity_id", id_of(F.col("source_config_id"), F.col("type"), F.col("normalized_name")))
    first = F.min_by("description", F.when(F.col("description").isNotNull(), F.struct("event_id", "description"))).alias("description")
    entities = told.groupBy("entity_id", "source_config_id", "type", "normalized_name").agg(F.min("name").alias("name"), first)
    relations = told.groupBy("event_id", "entity_id", "source_config_id").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.min("description").alias("description"))
    relations = relations.withColumn("id", id_of(F.col("event_id"), F.col("entity_id")))
    return {"events": events, "entities": entities, "event_entity": relations}


KEYS = {"events": "event_id", "entities": "entity_id", "event_entity": "id"}


def write_vectors(events: DataFrame, path: str, make: Callable = lambda: hashed, buckets: int = 64) -> int:
    """Embeds the titles of visible events that ``path``, a table in buckets of event_id, has no vector of; returns how many."""
    known = merged(events.sparkSession, path)
    known = events.select("event_id").limit(0) if known is None else known.select("event_id")
    wanted = missing_vector_ids(events, known).select(F.col("id").alias("event_id"), F.col("source").alias("source_config_id"))
    texts = wanted.join(events.select("event_id", "title"), "event_id")
    # Saved, since a merge reads its batch more than once and a model is dear.
    made = Scratch(events.sparkSession, "vectors").save(embed(texts, "title", make).drop("title"), "made")
    return merge_rows(made, path, "event_id", "event_id", buckets)["inserted"] if made.limit(1).count() else 0


def ingest(
    chunks: DataFrame, path: str, fn: Callable[[str], Found] = typed_words, types: list[str] = TYPES, make: Callable = lambda: hashed,
    per_task: int = PER_TASK, buckets: int = 64, pause: Callable[[], bool] = lambda: False,
) -> dict[str, int | bool]:
    """Extraction, tables and vectors of ``chunks`` below ``path``; what ``progress`` tells, and the vectors written.

    A paused run keeps its batches and writes no tables yet, as places in documents are not known before all chunks were tried. All steps may be repeated: tables are
    merged by their ids, vectors are made for events that have none.
    """
    told = extract_batches(chunks, path, fn, per_task, pause)
    if told["paused"]:
        return {**told, "vectors": 0}
    spark = chunks.sparkSession
    for name, table in event_tables(extracted(spark, path), types).items():
        merge_rows(Scratch(spark, name).save(table, "rows"), f"{path}/{name}", KEYS[name], KEYS[name], buckets)
    return {**told, "vectors": write_vectors(merged(spark, f"{path}/events"), f"{path}/vectors", make, buckets)}
