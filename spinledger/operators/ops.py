"""Outbox, registry, payout and pilot reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinledger.functions.columns import ratio
from spinledger.functions.quantiles import exact_medians
from spinledger.functions.skew import salted_lookup
from spinledger.operators.catalog import id_totals
from spinledger.schemas import BASIS_POINTS

# The retry clock.
FIRST_DELAY_SECONDS, LONGEST_DELAY_SECONDS = 30, 21_600


def outbox_backlog(outbox: DataFrame, now: Column) -> DataFrame:
    """Bytes not yet acknowledged, chunks waiting and the age of the oldest, per source."""
    waiting = F.col("status").isin("pending", "retry")
    open_row = F.col("status") != "uploaded"
    oldest = F.min(F.when(open_row, F.unix_micros("created_at")))
    return outbox.groupBy("source_id").agg(
        F.coalesce(F.sum(F.when(open_row, F.col("byte_count"))), F.lit(0)).alias("queued_bytes"),
        F.count_if(waiting).alias("pending_count"),
        ((F.unix_micros(now) - oldest) / F.lit(1e6)).alias("oldest_age_seconds"),
    )


def retry_schedule(outbox: DataFrame, now: Column) -> DataFrame:
    """Failed uploads with their next attempt: 30 s doubling per attempt, at most 6 h.

    ``retry_after_seconds``, where given, replaces the delay; zero asks for the usual one.
    Error texts are kept whole.
    """
    doublings = F.least(F.greatest(F.col("attempts") - 1, F.lit(0)), F.lit(30))
    delay = F.least(F.lit(LONGEST_DELAY_SECONDS), F.lit(FIRST_DELAY_SECONDS) * F.pow(F.lit(2.0), doublings))
    seconds = F.coalesce(F.nullif(F.col("retry_after_seconds").cast("double"), F.lit(0.0)), delay.cast("double"))
    failed = outbox.where(F.col("status") == "uploading")
    return failed.withColumns(
        {
            "status": F.lit("retry"),
            "delay_seconds": seconds,
            "next_attempt_at": F.timestamp_micros(F.unix_micros(now) + (seconds * 1e6).cast("bigint")),
        }
    )


def due_outbox(outbox: DataFrame, now: Column, limit: int) -> DataFrame:
    """The next chunks to upload, oldest first."""
    due = F.col("status").isin("pending", "retry") & (F.col("next_attempt_at") <= now)
    return outbox.where(due).orderBy("created_at", "chunk_id").limit(limit)


def registry_reconcile(lookups: DataFrame, records: DataFrame) -> DataFrame:
    """Each lookup with its provider's answer; no answer means unavailable."""
    key = ["provider", "identifier_type", "identifier_value"]
    newest = records.groupBy(*key).agg(
        F.max(
            F.struct("retrieved_at", "state", "external_record_id", "source_payload_sha256", "message")
        ).alias("r")
    )
    message = F.format_string(
        "No approved adapter is configured for %s; queue this lookup for registry reconciliation.", "provider"
    )
    return salted_lookup(lookups, newest, key, spread_by=["lookup_id"], salts=1).select(
        *lookups.columns,
        F.coalesce("r.state", F.lit("unavailable")).alias("state"),
        F.col("r.external_record_id").alias("external_record_id"),
        F.col("r.source_payload_sha256").alias("source_payload_sha256"),
        F.coalesce("r.message", message).alias("message"),
    )


def payout_reconcile(payouts: DataFrame, events: DataFrame) -> DataFrame:
    """Each payout with the provider's first answer for its idempotency key.

    Later duplicates are counted and ignored, an answer for another amount is flagged,
    and silence is unknown, not failed. No money moves here.
    """
    answers = events.groupBy("idempotency_key").agg(
        F.min(F.struct("received_at", "event_id", "state", "provider_reference")).alias("first"),
        (F.count(F.lit(1)) - 1).alias("duplicates"),
    )
    first_of_key = payouts.groupBy("idempotency_key").agg(F.min("payout_id").alias("_first"))
    positive = F.col("amount_ugx") > 0
    state = (
        F.when(~positive, "refused")
        .when(F.col("payout_id") != F.col("_first"), "duplicate")
        .otherwise(F.coalesce("first.state", F.lit("unknown")))
    )
    merged = first_of_key.join(answers, "idempotency_key", "left")
    return salted_lookup(payouts, merged, ["idempotency_key"], spread_by=["payout_id"], salts=1).select(
        "payout_id",
        "idempotency_key",
        "amount_ugx",
        state.alias("state"),
        F.when(positive, F.col("first.provider_reference")).alias("provider_reference"),
        F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
    )


# Pilot metrics ----------------------------------------------------------------------


def quality_by_class(candidates: DataFrame, gaps: DataFrame, sources: DataFrame) -> DataFrame:
    """Precision and recall per source class; missed known plays are the false negatives."""
    classes = sources.select("source_code", "source_type")
    reviewed = candidates.groupBy("source_code").agg(
        F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
    )
    missed = gaps.where("is_known").groupBy("source_code").agg(F.count(F.lit(1)).alias("missed"))
    totals = (
        classes.join(reviewed, "source_code", "left")
        .join(missed, "source_code", "left")
        .na.fill(0, ["verified", "rejected", "missed"])
        .groupBy("source_type")
        .agg(*[F.sum(c).alias(c) for c in ("verified", "rejected", "missed")])
    )
    return totals.withColumn("precision", ratio("verified", F.col("verified") + F.col("rejected"))).withColumn(
        "recall", ratio("verified", F.col("verified") + F.col("missed"))
    )


def active_split_validity(sheets: DataFrame, lines: DataFrame) -> DataFrame:
    """Active sheets, how many total exactly 10 000 and the share of those."""
    active = id_totals(sheets.where(F.col("status") == "active"), lines)
    return active.agg(
        F.count(F.lit(1)).alias("active_sheets"),
        F.count_if(F.col("total_basis_points") == BASIS_POINTS).alias("valid_sheets"),
    ).withColumn("valid_ratio", ratio("valid_sheets", "active_sheets"))


def dispute_metrics(disputes: DataFrame) -> DataFrame:
    """Dispute volume per reason with the mean and the exact median of resolution hours."""
    timed = disputes.withColumn("_hours", (F.unix_micros("resolved_at") - F.unix_micros("created_at")) / F.lit(3.6e9))
    counts = timed.groupBy("reason").agg(
        F.count(F.lit(1)).alias("disputes"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.round(F.avg("_hours"), 4).alias("mean_hours"),
    )
    medians = exact_medians(timed, ["reason"], "_hours", "median_hours").withColumnRenamed("reason", "_reason")
    return counts.join(medians, F.col("reason").eqNullSafe(F.col("_reason")), "left").drop("_reason")


def reconciliation_rate(detections: DataFrame, statement_lines: DataFrame) -> DataFrame:
    """Share of verified detections that reached a statement."""
    listed = statement_lines.select("detection_id").distinct().withColumn("_listed", F.lit(1))
    return (
        detections.where(F.col("status") == "verified")
        .join(listed, "detection_id", "left")
        .agg(F.count(F.lit(1)).alias("verified"), F.count("_listed").alias("on_statement"))
        .withColumn("rate", ratio("on_statement", "verified"))
    )
