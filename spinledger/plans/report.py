"""The weekly shadow report: manifests, logs, candidates and reviews to per-source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spinledger.functions.columns import stable_id
from spinledger.functions.lineage import cut
from spinledger.operators.reconciliation import (
    agreed_only,
    chunk_counts,
    classify_gap,
    log_gaps,
    precision_slices,
    reconcile_log,
    reconciliation_rows,
    review_outcomes,
    scorecard,
    split_gaps,
    top_supplied,
)
from spinledger.operators.validation import validate_manifests, with_report_device


def shadow_report(
    manifests: DataFrame,
    candidates: DataFrame,
    logs: DataFrame,
    reviews: DataFrame,
    catalog: DataFrame,
    sources: DataFrame,
    *,
    period: tuple[str, str],
    tolerance_seconds: float = 90.0,
) -> dict[str, DataFrame]:
    """Every table of the report. ``candidates`` may be supplied or come from the matcher.

    The period is printed, not filtered on; use ``filter_period`` for that. Repeated
    chunk ids are reported as often as they occur. Logs of unlisted sources are ignored;
    a listed source that did not agree still gets a row, without candidates.
    """
    valid, rejected = validate_manifests(with_report_device(manifests))
    agreed, excluded = agreed_only(valid, sources)
    # the rows of one chunk id are few; numbering them keeps ids free of the file layout
    of_chunk = Window.partitionBy("edge_chunk_id").orderBy("started_at", "source_code", "content_sha256")
    chunks = agreed.withColumn("position", F.row_number().over(of_chunk))
    plays = top_supplied(chunks, candidates, catalog).join(
        reviews.select("edge_chunk_id", F.col("status").alias("_status")), "edge_chunk_id", "left"
    ).withColumns(
        {
            "status": F.coalesce("_status", F.lit("candidate")),
            "detection_id": stable_id("edge_chunk_id", "position"),
        }
    ).drop("_status")
    listed_logs = logs.join(sources.select("source_code"), "source_code", "left_semi")
    # Ten tables are made from these two.
    reconciled = cut(reconcile_log(plays, listed_logs, catalog, tolerance_seconds))
    gaps = cut(classify_gap(log_gaps(listed_logs, reconciled), catalog))
    local, _ = split_gaps(gaps)
    rows = reconciliation_rows(sources, reconciled, gaps)
    regions = reconciled.join(sources.select("source_code", "region"), "source_code")
    counts = chunk_counts(valid)
    cards = scorecard(sources, reconciled, rows)
    per_source = (
        sources.select("source_code", "display_name", "region")
        .join(counts, "source_code", "left")
        .na.fill(0, ["chunk_count"])
        .join(cards, "source_code")
    )
    warnings = excluded.select("warning").unionByName(
        rejected.select(
            F.concat(F.lit("chunk "), F.coalesce("edge_chunk_id", F.lit("without id")), F.lit(" skipped: "), F.get("errors", F.lit(0))).alias("warning")
        )
    )
    header = sources.agg(F.count(F.lit(1)).alias("source_count")).select(
        F.concat(F.lit("shadow-"), F.date_format(F.lit(period[0]).cast("timestamp"), "yyyyMMdd")).alias("report_id"),
        F.lit("shadow_monitoring").alias("kind"),
        F.lit(True).alias("non_financial"),
        F.lit(period[0]).alias("period_start"),
        F.lit(period[1]).alias("period_end"),
        "source_count",
    )
    return {
        "header": header,
        "sources": per_source,
        "slices": precision_slices(regions),
        "candidates": reconciled.select(
            "detection_id", "recording_id", "title", "source_code", "started_at", "votes", "confidence_hint",
            "log_reconciliation", F.col("status").alias("review_status"),
        ),
        "log_reconciliation": rows,
        "unmatched_local_repertoire": local.select("source_code", "title", "artist", "aired_at", "recording_id"),
        "review_outcomes": review_outcomes(reconciled),
        "warnings": warnings,
    }


def report_summary(report: dict[str, DataFrame]) -> DataFrame:
    """One row: the header with the totals of the report's parts."""
    totals = report["sources"].agg(
        F.sum("chunk_count").alias("chunks"), F.sum("total_candidates").alias("candidates")
    )
    return report["header"].select(
        "*",
        totals.select("chunks").scalar().alias("chunks"),
        totals.select("candidates").scalar().alias("candidates"),
        report["warnings"].agg(F.count(F.lit(1))).scalar().alias("warnings"),
        report["unmatched_local_repertoire"].agg(F.count(F.lit(1))).scalar().alias("local_repertoire"),
    )
