"""Chunks to ranked catalog candidates, and clips to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spinledger.config import FingerprintConfig, MatcherConfig
from spinledger.operators.features import fingerprint
from spinledger.operators.matching import chunk_landmarks, match, with_hash_counts
from spinledger.operators.validation import validate_manifests


def match_chunks(
    manifests: DataFrame,
    index: DataFrame,
    schema_id: str,
    cfg: FingerprintConfig = FingerprintConfig(),
    matcher: MatcherConfig = MatcherConfig(),
    **options: object,
) -> DataFrame:
    """Candidates for every valid manifest of the schema; the others give no rows.

    Of several rows of one chunk id the earliest counts, then the smallest digest.
    """
    valid, _ = validate_manifests(manifests)
    of_chunk = Window.partitionBy("edge_chunk_id").orderBy("started_at", "content_sha256", F.size("landmarks"))
    once = valid.withColumn("_n", F.row_number().over(of_chunk)).where("_n = 1").drop("_n")
    queries = chunk_landmarks(once, schema_id)
    return match(queries, index.where(F.col("schema_id") == schema_id), cfg, matcher, **options)


def index_clips(clips: DataFrame, schema_id: str, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """An index of catalog clips, ready to enrol."""
    _, landmarks = fingerprint(clips, cfg)
    return with_hash_counts(
        landmarks.withColumnRenamed("clip_id", "track_id").withColumn("schema_id", F.lit(schema_id))
    )


def match_clips(
    clips: DataFrame,
    index: DataFrame,
    schema_id: str,
    cfg: FingerprintConfig = FingerprintConfig(),
    matcher: MatcherConfig = MatcherConfig(),
) -> DataFrame:
    """Candidates for captured audio."""
    queries = index_clips(clips, schema_id, cfg).select(
        F.col("track_id").alias("query_id"),
        "schema_id",
        F.col("hash_index").alias("query_index"),
        "anchor_frame",
        "ratio_bin",
        "delta_frames",
        F.col("track_hashes").alias("query_hashes"),
    )
    return match(queries, index, cfg, matcher)
