"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinledger.llm import ann, bpe, conversations, jaccard, langid, licenses, line_dedup, media, packing, quality, spelling, token_output, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """A vocabulary file; SPINLEDGER_TOKENIZERS names another folder than the installed one."""
    folder = os.environ.get("SPINLEDGER_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def op2_documents(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 2048, 0)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return op2_documents(table(spark, folder, "documents"))


@query("op3_token_matrix")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return token_output.packed_matrix(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), 2048, 0)


@query("op5_webp_media")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_digests(table(spark, folder, "documents"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op7_line_dedup", line_dedup.ORACLE)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


@query("op9_license_scan", licenses.oracle())
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_texts(table(spark, folder, "documents"))


@query("op4_prefix_forest")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("op8_ngram_jaccard", jaccard.ORACLE)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op10_quality_cotraining")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_digests(table(spark, folder, "conversations"))


@query("op13_toxicity")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
