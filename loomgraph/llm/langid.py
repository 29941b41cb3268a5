"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit one binary classifier over hashed byte n-grams of the whole text tells the
languages with a 1 from those with a 0. Decoding adds up, for each codeword, the logistic loss of every bit's margin and takes
the codeword of least loss; a small lead over the next one is flagged as ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, carried, shipped

UNKNOWN = "und"
BUCKETS = 4096
SAMPLE_ROWS = 2400  # labelled rows that the classifiers are fitted on at most, spread evenly over the languages
AMBIGUOUS = 0.2  # lead in probability under which a decision is flagged
_FOLD = np.full(256, 32, np.uint8)  # ASCII other than letters counts as a blank
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """k distinct rows of +1 and -1: every split of up to seven languages, else random splits, about ten per doubling."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        bits = (np.arange(1, 1 << (k - 1))[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.vstack([np.zeros((1, bits.shape[1]), int), bits]) * 2.0 - 1
    r = np.random.default_rng(seed)
    while True:
        code = r.integers(0, 2, (k, 10 * k.bit_length())) * 2.0 - 1
        if len(np.unique(code, axis=0)) == k and (np.abs(code.sum(axis=0)) < k).all():
            return code


def features(text: bytes) -> np.ndarray | None:
    """Unit vector of square-rooted n-gram counts (n = 1 to 3); None for a text without a letter."""
    raw = np.frombuffer(text, np.uint8)
    b = _FOLD[raw]
    letters = b != 32
    if not letters.any() or not ((b > 96) & (b < 123)).any() and not any(c.isalpha() for c in text.decode("utf-8", "ignore")):
        return None
    b = np.concatenate([[32], b[letters | np.concatenate([[True], letters[:-1]])], [32]]).astype(np.uint32)
    counts = np.bincount(b, minlength=BUCKETS).astype(np.float32)
    for gram in (b[:-1] * np.uint32(257) + b[1:] + np.uint32(7919), (b[:-2] * np.uint32(66049) + b[1:-1] * np.uint32(257) + b[2:]) + np.uint32(104729)):
        counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    counts = np.sqrt(counts)
    return counts / np.sqrt((counts * counts).sum())


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 300, rate: float = 60.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one logistic classifier per bit, by gradient descent with momentum on balanced rows."""
    target = (code[y] + 1) / 2
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, share = np.zeros_like(w), np.zeros_like(b), (1 / np.bincount(y, minlength=len(code))[y] / max(len(np.unique(y)), 1))[:, None]
    for _ in range(steps):
        error = (share * (1 / (1 + np.exp(-(x @ w + b))) - target)).astype(np.float32)
        vw = 0.9 * vw - rate / 10 * (x.T @ error + decay * w)
        vb = 0.9 * vb - rate / 100 * error.sum(axis=0)
        w += vw
        b += vb
    return w, b


class LanguageModel:
    def __init__(self, langs: list[str], weights: np.ndarray | None = None, bias: np.ndarray | None = None):
        self.langs, self.code, self.weights, self.bias = langs, codewords(len(langs)), weights, bias

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, its probability, whether the lead is small) per row of features."""
        if len(self.langs) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        return p.argmax(axis=1), top[:, -1].clip(0, 1), top[:, -1] - top[:, -2] < AMBIGUOUS


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 3 == 1


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Model from ``docs(text, lang)``; rows with null lang teach nothing. At most ``sample_rows`` rows are fitted on."""
    known = docs.where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([])
    rate = F.lit(0.0)
    for k in langs:
        rate = F.when(F.col("lang") == k, min(1.0, sample_rows / len(langs) / counts[k])).otherwise(rate)

    def vectors(batches):
        for b in batches:
            rows = [(k, v.astype(np.float16).tobytes()) for k, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True) if (v := features(t)) is not None]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "x"])

    drawn = known.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < rate * (1 << 20)).select("lang", "text").limit(sample_rows)
    rows = drawn.mapInArrow(vectors, "lang string, x binary").collect()
    y = np.array([langs.index(r[0]) for r in rows], int)
    if len(np.unique(y)) < 2:
        return LanguageModel(langs[:1] if not len(y) else [langs[y[0]]])
    x = np.array([np.frombuffer(r[1], np.float16) for r in rows], np.float32)
    return LanguageModel(langs, *fit(x, y, codewords(len(langs))))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Columns of ``docs`` plus lang_pred, score, ambiguous; only the text counts.

    Null text and texts without a letter: lang_pred und, score 0, not ambiguous; so is everything if the model has learned no language. Very
    long texts are read whole. Repeated rows get equal results. Columns named like a result are replaced.
    """
    own = ("lang_pred", "score", "ambiguous")
    sent = shipped(docs.sparkSession, model)

    def run(batches):
        m = sent()
        for b in batches:
            found = [features(t) if m.langs else None for t in as_bytes(b.column(0).field("text"))]
            at = [i for i, v in enumerate(found) if v is not None]
            lang, score, flag = [UNKNOWN] * len(found), np.zeros(len(found)), np.zeros(len(found), bool)
            if at:
                k, p, close = m.decode(np.array([found[i] for i in at]))
                score[at], flag[at] = p, close
                for i, x in zip(at, k.tolist(), strict=True):
                    lang[i] = m.langs[x]
            yield pa.record_batch([b.column(0), pa.array(lang), pa.array(score), pa.array(flag)], names=["row", *own])

    rows = docs.withColumn("text", F.col("text").cast("string")).select(carried(docs, *own))
    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return made.select(*[F.col(f"row.`{c}`").alias(c) for c in dict.fromkeys(docs.columns) if c not in own], *own)
