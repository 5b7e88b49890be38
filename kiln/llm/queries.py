"""The registered queries of the operators, and their DuckDB SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import ctw, divergence, egojoin, htmltext, langid, linededup, maxscore, mixing, packing, prefixtrie, quality, simhash, tokencount


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return maxscore.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


def op3_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs, "doc_id", 3, 1))
    return langid.identify(docs, model).select("doc_id", langid.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, langid.training_rows(_read(spark, sf_dir, "labels"), "doc_id", 5, 0))
    return quality.score(docs, model).select("doc_id", langid.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_read(spark, sf_dir, "documents")).drop("row")


def op11_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    scored = ctw.score(_read(spark, sf_dir, "documents"), train)
    return scored.select("doc_id", langid.held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(_read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_top_k": op2_top_k,
    "op3_ego_join": op3_ego_join,
    "op4_langid": op4_langid,
    "op5_pack": op5_pack,
    "op6_mix": op6_mix,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_line_dedup": op10_line_dedup,
    "op11_ctw_score": op11_ctw_score,
    "op12_source_divergence": op12_source_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op2_top_k": maxscore.ORACLE,
    "op3_ego_join": egojoin.ORACLE,
    "op6_mix": mixing.ORACLE,
    "op10_line_dedup": linededup.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_prefix_trie": prefixtrie.ORACLE,
}
