"""Extraction with a function of the user: events and entities of chunks, checkpoints, repair, embeddings, code plans."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 256  # texts that a model is given at once
EVENTS = "chunk_id string, position int, title string, entities array<string>, error string"


def capitalized(text: str) -> list[tuple[str, list[str]]]:
    """A stand-in for a model: one event whose entities are the capitalised words; none without such a word."""
    found = list(dict.fromkeys(w.strip(".,;:!?") for w in (text or "").split() if w[:1].isupper()))
    return [(text.split("\n")[0][:60], found)] if found else []


def extract_events(chunks: DataFrame, fn: Callable[[str], list[tuple[str, list[str]]]] = capitalized, done: DataFrame | None = None) -> DataFrame:
    """Rows EVENTS of ``chunks(chunk_id, content)`` that ``done(chunk_id)`` does not hold.

    A chunk without events has one row with null position, one on which ``fn`` failed has one with the error: together they are the
    checkpoint of a run, and ``done`` of the next is every chunk without an error.
    """
    rest = chunks if done is None else chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for c, text in zip(f.chunk_id, f.content, strict=True):
                try:
                    found = fn(text)
                    out += [(c, i, t, list(e), None) for i, (t, e) in enumerate(found)] or [(c, None, None, None, None)]
                except Exception as e:  # noqa: BLE001  a failure concerns its chunk only
                    out.append((c, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["chunk_id", "position", "title", "entities", "error"]).astype({"position": "Int32"})

    return rest.select("chunk_id", "content").mapInPandas(run, EVENTS)


def finished(events: DataFrame) -> DataFrame:
    return events.where("error IS NULL").select("chunk_id").distinct()


def normalize_entities(raw: Column, types: list[str]) -> Column:
    """JSON object of an entity as a map, with {type: name, name: name} repaired to type and name.

    Repaired only if exactly one key is unknown, it is one of ``types``, there is no type yet, and its value equals the name.
    """
    m = F.from_json(raw, "map<string,string>")
    known = ["name", "type", "description", "children"]
    unknown = F.filter(F.map_keys(m), lambda k: ~k.isin(known))
    key = F.get(unknown, F.lit(0))
    fits = (F.size(unknown) == 1) & key.isin(types) & (F.element_at(m, key) == F.element_at(m, F.lit("name"))) & ~F.map_contains_key(m, "type")
    fixed = F.map_concat(F.map_filter(m, lambda k, _: k.isin(known)), F.create_map(F.lit("type"), key))
    return F.when(F.coalesce(fits, F.lit(False)), fixed).otherwise(m)


def normalize_tree(raw: Column, types: list[str], depth: int = 2) -> Column:
    """``normalize_entities`` of an entity and of its children, down to ``depth`` levels of them: (entity, children)."""
    entity = normalize_entities(raw, types)
    if depth == 0:
        return F.struct(entity.alias("entity"))
    inner = F.from_json(F.element_at(entity, F.lit("children")), "array<string>")
    return F.struct(entity.alias("entity"), F.transform(inner, lambda c: normalize_tree(c, types, depth - 1)).alias("children"))


def checkpoint_restore(events: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Events that a checkpoint names are visible again if they were deleted."""
    named = checkpoint.select("event_id").distinct().withColumn("named", F.lit(True))
    rows = events.join(named, "event_id", "left")
    return rows.withColumn("status", F.when(F.col("named") & (F.col("status") == "DELETED"), F.lit(None)).otherwise(F.col("status"))).drop("named")


def code_extraction_plan(chunks: DataFrame, mode: str) -> DataFrame:
    """What to extract from ``chunks(chunk_id, chunk_type, content, llm_extraction_text)``: (chunk_id, text); code by ``mode`` off, comments or all."""
    if mode not in ("off", "comments", "all"):
        raise ValueError(f"no mode {mode}")
    code = F.coalesce(F.col("chunk_type").startswith("code"), F.lit(False))
    text = F.when(~code, F.col("content"))
    if mode == "comments":
        text = F.when(code, F.nullif(F.trim("llm_extraction_text"), F.lit(""))).otherwise(F.col("content"))
    elif mode == "all":
        text = F.when(F.coalesce(F.col("chunk_type") != "code_parent", F.lit(True)), F.col("content"))
    return chunks.select("chunk_id", text.alias("text")).where("text IS NOT NULL")


def hashed(texts: pd.Series, size: int = 64) -> list[list[float]]:
    """A stand-in for a model: signed feature hashing of words, at length 1."""
    out = []
    for t in texts:
        v = np.zeros(size)
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % size] += 1 if h >> 63 else -1
        out.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
    return out


def embed(df: DataFrame, column: str, make: Callable[[], Callable[[pd.Series], list[list[float]]]] = lambda: hashed, name: str = "v") -> DataFrame:
    """``df`` with vectors of a text column; ``make`` loads the model, once for each task, and gets up to PIECE texts at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for texts in batches:
            for k in range(0, len(texts), PIECE):
                yield pa.array(model(texts.slice(k, PIECE).to_pandas()), pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(name, F.arrow_udf(run, "array<double>")(column))
