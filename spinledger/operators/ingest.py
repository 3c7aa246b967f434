"""Idempotent receipt of chunk manifests and the candidate rows they produce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.config import FingerprintConfig, MatcherConfig
from spinledger.functions.columns import seconds_between, stable_id
from spinledger.functions.lineage import cut
from spinledger.functions.skew import salted_lookup
from spinledger.operators.matching import chunk_landmarks, match


def resolve_source(chunks: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with their ``source_id``, chunks whose code is not provisioned)."""
    known = sources.select("source_code", "source_id")
    spread = ["edge_chunk_id"]
    found = salted_lookup(chunks, known, ["source_code"], spread_by=spread, how="inner")
    lost = salted_lookup(chunks, known.select("source_code"), ["source_code"], spread_by=spread, how="left_anti")
    return found, lost.withColumn(
        "reason", F.format_string("source_code '%s' is not provisioned", "source_code")
    )


def candidate_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("capture_chunk_id").agg(F.count(F.lit(1)).alias("candidate_count"))


def split_replays(
    manifests: DataFrame, receipts: DataFrame, sources: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first accepted rows with their ``source_id``, rows of unknown sources, later rows).

    A chunk id with a receipt is a replay whatever its source. Of the other rows only
    those of known sources count: the first of them (by ``arrival``) is accepted and the
    later rows of its id are replays of it, so a delivery that failed on its source does
    not stand in the way of the next one. Later rows carry ``receipt_id`` and, where the
    receipt is older than the batch, ``_old_source``.
    """
    old = receipts.select("edge_chunk_id", "receipt_id", F.col("source_id").alias("_old_source"))
    # Every result below reads these rows, most of them several times; manifests are costly to validate.
    met = cut(salted_lookup(manifests, old, ["edge_chunk_id"], spread_by=["arrival"], salts=1))
    before = met.where(F.col("receipt_id").isNotNull())
    found, lost = resolve_source(met.where(F.col("receipt_id").isNull()).drop("receipt_id", "_old_source"), sources)
    first = found.groupBy("edge_chunk_id").agg(F.min("arrival").alias("_first"))
    placed = salted_lookup(found, first, ["edge_chunk_id"], spread_by=["arrival"], salts=1, how="inner")
    is_first = F.col("arrival") == F.col("_first")
    accepted = placed.where(is_first).drop("_first")
    # a row of an unknown source behind the accepted one is a replay, as it would be in the next batch
    behind = salted_lookup(lost, first, ["edge_chunk_id"], spread_by=["arrival"], salts=1)
    unknown = behind.where(F.col("_first").isNull() | (F.col("arrival") < F.col("_first"))).drop("_first")
    late = behind.where(F.col("arrival") > F.col("_first")).drop("_first", "reason")
    again = before.unionByName(
        placed.where(~is_first).drop("_first", "source_id").unionByName(late), allowMissingColumns=True
    )
    return accepted, unknown, again


def replays_of(again: DataFrame, received: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """Replays with the stored source and candidate count, of earlier batches or of this one."""
    new = received.select("edge_chunk_id", F.col("receipt_id").alias("_new_receipt"), F.col("source_id").alias("_new_source"))
    counts = candidate_counts(known.select("capture_chunk_id").unionByName(found.select("capture_chunk_id"))).withColumnRenamed(
        "capture_chunk_id", "receipt_id"
    )
    met = salted_lookup(again, new, ["edge_chunk_id"], spread_by=["arrival"], salts=1)
    named = met.withColumn("receipt_id", F.coalesce("receipt_id", "_new_receipt"))
    return (
        salted_lookup(named, counts, ["receipt_id"], spread_by=["arrival"], salts=1)
        .select(
            "edge_chunk_id",
            "arrival",
            "receipt_id",
            F.coalesce("_old_source", "_new_source").alias("source_id"),
            F.size("landmarks").alias("landmark_count"),
            F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        )
        .withColumn("replayed", F.lit(True))
    )


def receipts_of(chunks: DataFrame, schema_id: str) -> DataFrame:
    """Receipt rows of accepted chunks; the id is a hash of the chunk id."""
    return chunks.select(
        stable_id("edge_chunk_id").alias("receipt_id"),
        "edge_chunk_id",
        "source_id",
        "device_id",
        "started_at",
        "ended_at",
        "byte_count",
        "content_sha256",
        "capture_policy",
        "fingerprint_schema_id",
        F.size("landmarks").alias("landmark_count"),
        F.col("fingerprint_schema_id").eqNullSafe(F.lit(schema_id)).alias("schema_compatible"),
        F.lit("received").alias("status"),
    )


def detections_of(candidates: DataFrame, receipts: DataFrame) -> DataFrame:
    """Detection rows: times and duration come from the chunk, the status is candidate."""
    chunk = receipts.select(
        F.col("edge_chunk_id").alias("query_id"),
        F.col("receipt_id").alias("capture_chunk_id"),
        "source_id",
        "started_at",
        "ended_at",
    )
    return candidates.join(chunk, "query_id").select(
        stable_id("query_id", "track_id", "schema_id").alias("detection_id"),
        stable_id("query_id", "track_id", "schema_id").alias("idempotency_key"),
        "capture_chunk_id",
        "source_id",
        F.col("track_id").alias("recording_id"),
        "started_at",
        "ended_at",
        seconds_between("started_at", "ended_at").cast("decimal(10,3)").alias("duration_seconds"),
        F.col("schema_id").alias("matcher_version"),
        F.col("schema_id").alias("fingerprint_schema_id"),
        F.col("votes").alias("matched_hash_count"),
        F.col("confidence_hint").cast("decimal(6,5)").alias("match_confidence"),
        F.col("tempo_scale").cast("decimal(7,5)").alias("reference_per_query_tempo_scale"),
        "offset_seconds",
        F.lit("candidate").alias("status"),
    )


def ingest_audit(receipts: DataFrame, chunks: DataFrame, detections: DataFrame) -> DataFrame:
    """One ``capture.ingested`` row per receipt with its counts."""
    counts = candidate_counts(detections).withColumnRenamed("capture_chunk_id", "receipt_id")
    codes = chunks.select("edge_chunk_id", "source_code")
    return (
        receipts.join(counts, "receipt_id", "left")
        .join(codes, "edge_chunk_id")
        .select(
            F.lit("capture.ingested").alias("action"),
            F.lit("capture_chunk").alias("entity_type"),
            F.col("receipt_id").alias("entity_id"),
            F.col("device_id").alias("actor_id"),
            F.to_json(
                F.struct(
                    "edge_chunk_id",
                    "source_code",
                    "device_id",
                    F.col("fingerprint_schema_id").alias("schema_id"),
                    F.col("landmark_count").alias("landmarks"),
                    F.coalesce("candidate_count", F.lit(0)).alias("candidates"),
                    "schema_compatible",
                )
            ).alias("metadata"),
        )
    )


def ingest(
    manifests: DataFrame,
    receipts: DataFrame,
    detections: DataFrame,
    sources: DataFrame,
    index: DataFrame | None,
    schema_id: str,
    cfg: FingerprintConfig = FingerprintConfig(),
    matcher: MatcherConfig = MatcherConfig(),
) -> dict[str, DataFrame]:
    """Validated manifests to receipts, replays, rejects, candidate detections and audit.

    ``manifests`` carry an ``arrival`` number. A chunk of another schema is received but
    not matched.
    """
    accepted, unknown, again = split_replays(manifests, receipts, sources)
    received = receipts_of(accepted, schema_id)
    if index is None:
        found = detections.limit(0)
    else:
        ranked = match(chunk_landmarks(accepted, schema_id), index.where(F.col("schema_id") == schema_id), cfg, matcher)
        found = detections_of(ranked, received)
    return {
        "receipts": received,
        "replays": replays_of(again, received, detections, found),
        "unknown_sources": unknown,
        "detections": found,
        "audit": ingest_audit(received, accepted, found),
    }
