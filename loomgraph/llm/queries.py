"""The registered query of each corpus operator, over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, gru_lm, langid, line_dedup, mixing, prefix_trie, ranked_search, rp_forest, simhash, suffix_dedup, token_output
from .sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.drop("lang"), model).drop("text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def _chat_digest(frames):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for f in frames:
        out = []
        for conv_id, formatted, spans in zip(f.conv_id, f.formatted, f.spans, strict=True):
            turns = chat.parse(formatted)
            loss = "".join(chat.unescape(formatted[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == "assistant")
            out.append((conv_id, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(formatted)))
        made = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        yield made.astype({"conv_id": "Int64"})


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chat.format_chats(rows).mapInPandas(_chat_digest, kinds)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op5_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.embedding_links(_table(spark, sf_dir, "embeddings"))


def op6_gru_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(_table(spark, sf_dir, "pages"), line_dedup.page_text(F.col("html")), line_dedup.site_of(F.col("url")))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return chosen.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", F.round("leaf_budget", 3).alias("leaf_budget"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_decontaminate": op4_decontaminate,
    "op5_embedding_forest": op5_embedding_forest,
    "op6_gru_scoring": op6_gru_scoring,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_output": op8_token_output,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}
