"""The dealt operators as queries over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texteval.llm import embeddings, jaccard, langid, licenses, lmscore, mixing, packing_bfd, packing_nnls, pii, quality, secrets, spelling, whitening
from texteval.llm.oracle import ORACLE as ORACLE
from texteval.llm.shared import fold

TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    filters = langid.train(docs.filter(fold(F.col("doc_id"), 5) != 0))
    return langid.predict(docs, filters, [F.col("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out")])


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_bfd.pack_matrix(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_texts(_read(spark, sf_dir, "documents"), ["doc_id"]).drop("redacted")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(quality.measure(_read(spark, sf_dir, "documents"), ["doc_id"]))


def op6_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_read(spark, sf_dir, "documents"), ["doc_id"]).drop("found")


def op7_pack_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_nnls.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents")).drop("text_key")


def op10_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op11_license_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"), ["doc_id"])


def op12_index_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_filters, op2_best_fit_packing, op3_secret_layers, op4_mix_sources,
        op5_rule_ledger, op6_disclosing_terms, op7_pack_combinations, op8_context_mixing, op9_ngram_jaccard, op10_embedding_duplicates,
        op11_license_blocks, op12_index_variants, op13_block_whitening,
    )
}
