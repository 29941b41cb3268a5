"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A window is a run of 13 item words (or a whole shorter item). The words of a window are ordered by how rare they are in
the corpus. Containment is exact, so all words of a window must be present and the prefix that a document has to share is
the one rarest word. A shared word fixes where the window would have to lie: its offset gives the length and positional
bounds, and the slice of the document there is compared with the window word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried

# Fixed by the word definition: ASCII other than digits and letters separates words; A-Z count as a-z. The classes are
# spelled out character by character, which Java looks up in a bit set instead of testing range after range.
_CLASS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
SEPARATORS, WORD = f"[{_CLASS}]+", f"[^{_CLASS}]+"
PLAIN = "".join(f"\\x{c:02X}" for c in (*range(128), 0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100)))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_CHARS = 64_000_000  # characters of all windows up to which they, and words from them, go to every executor


def words(text: Column) -> Column:
    """Words of a text, with an empty one before or after them where it begins or ends with a separator.

    lower() serves unless the text has a character other than ASCII and small Latin-1 letters.
    """
    simple = (F.length(text) == F.octet_length(text)) | ~text.rlike(f"[^{PLAIN}]")
    return F.split(F.when(simple, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), SEPARATORS)


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, win, words) with one row per window of an item that has words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.array_remove(words(F.col("text").cast("string")), "").alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("words")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """One row per row of ``docs``: its columns, n_words, n_hit, n_items, items (sorted ids), contaminated.

    A word inside any occurrence of a window is hit; contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null text has no
    words; an item without words has no window; an empty benchmark hits nothing, empty ``docs`` give an empty result. Very long texts are read whole. Repeated rows
    and items with equal texts all count. Other columns of ``docs``
    pass through, except those named like a result.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    parsed = docs.select(carried(docs, "n_words", "n_hit", "n_items", "items", "contaminated"), F.coalesce(words(F.col("text").cast("string")), F.array().cast("array<string>")).alias("w"))
    windows = scratch.save(item_windows(benchmark, size), "windows")
    small = (windows.agg(F.sum(F.length(F.array_join("words", " ")))).first()[0] or 0) <= BROADCAST_CHARS
    sent = F.broadcast if small else (lambda df: df)
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    texts = docs.select(words(F.col("text").cast("string")).alias("w"))
    counts = texts.select(F.explode("w").alias("word")).join(sent(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    counts = scratch.save(counts, "counts")
    # The prefix of each window: its rarest word (then the smaller word), at its first place.
    ranked = windows.select("item_id", "words", F.posexplode("words").alias("at", "word")).join(sent(counts), "word", "left").na.fill(0, ["n"])
    prefix = ranked.groupBy("item_id", "words").agg(F.min(F.struct("n", "word", "at")).alias("p"), F.min("n").alias("least")).where("least > 0")
    prefix = scratch.save(prefix.groupBy(F.col("p.word").alias("word"), F.col("p.at").alias("at"), "words").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "prefix")
    keyed = parsed.select(F.xxhash64("row.doc_id", "row.text").alias("rid"), F.xxhash64("row.text").alias("rid2"), "w")
    if small:
        at = keyed.select("rid", "rid2", "w", F.posexplode("w").alias("pos", "word")).join(sent(prefix), "word")
    else:  # places are shuffled without their texts, which only those with a prefix word meet again; repeated rows have the places of one
        keyed = keyed.dropDuplicates(["rid", "rid2"])
        at = keyed.select("rid", "rid2", F.posexplode("w").alias("pos", "word")).join(prefix, "word").join(keyed, ["rid", "rid2"])
    found = (
        at.where((F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.size("words") <= F.size("w")))
        .where(F.slice("w", F.col("pos") - F.col("at") + 1, F.size("words")) == F.col("words"))
        .select("rid", "rid2", (F.col("pos") - F.col("at")).alias("first"), F.size("words").alias("len"), "items")
    )
    # Repeated rows give equal places: sets, one per document and no longer than the document.
    hits = found.groupBy("rid", "rid2").agg(F.collect_set(F.struct("first", "len")).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        F.array_sort("places"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s.end, x.first + x.len).alias("end"), (s.n + F.greatest(F.lit(0), x.first + x.len - F.greatest(s.end, x.first))).alias("n")),
    ).n
    hits = hits.select("rid", "rid2", covered.alias("n_hit"), "items")
    n_words = F.coalesce(F.regexp_count(F.col("row.text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = parsed.select("row", n_words.alias("n_words"), F.xxhash64("row.doc_id", "row.text").alias("rid"), F.xxhash64("row.text").alias("rid2"))
    out = rows.join(hits, ["rid", "rid2"], "left").select(
        *[F.col(f"row.`{c}`").alias(c) for c in dict.fromkeys(docs.columns) if c not in ("n_words", "n_hit", "n_items", "items", "contaminated")],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
