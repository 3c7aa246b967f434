"""From raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor kept, as Parquet in the shared folder. Stages that
decide rows keep all columns of ``documents``; the last one gives a row for each piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinledger.llm import jaccard, langid, line_dedup, quality
from spinledger.llm.common import materialize
from spinledger.llm.queries import op2_documents, table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    return langid.keep_identified(docs, tokenizer_path("piece_bpe_32k.model"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality by both views."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of three lines or more that stood earlier; ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; documents without an id stay."""
    parts = jaccard.jaccard_components(docs)
    first = parts.filter("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(first, F.col("doc_id") == F.col("__id"), "left").filter("doc_id is null or __id is not null").drop("__id")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048."""
    return op2_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identified),
    ("quality_classifier", good),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("best_fit_packing", packed),
]

#: Learned decisions have no SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
