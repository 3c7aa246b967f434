"""Checking a batch before it is published, and publishing it whole."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.operators.audits import AUDITS, audit_foreign_keys, audit_row_checks, audit_unique_keys, row_checks

# The tables each cross-table rule reads.
NEEDS = {
    "split_total": ("split_sheets", "split_lines"),
    "release_catalog": ("release_recordings", "releases", "recordings"),
    "sheet_catalog": ("split_sheets", "recordings", "music_works"),
    "work_catalog": ("recording_works", "recordings", "music_works"),
    "capture_source": ("capture_chunks", "edge_nodes"),
    "detection_capture": ("detection_events", "capture_chunks"),
    "usage_links": (
        "royalty_usage_items", "royalty_runs", "detection_events", "recordings", "split_sheets", "recording_works",
    ),
    "allocation_snapshot": ("royalty_allocations", "royalty_usage_items", "split_lines"),
    "payout_account": ("payouts", "payment_accounts", "payout_batches"),
    "payout_item": ("payout_allocation_items", "payouts", "royalty_allocations"),
    "payout_total": ("payouts", "payout_allocation_items"),
    "run_totals": ("royalty_runs", "royalty_usage_items", "royalty_allocations"),
    "weight_overlap": ("source_weights",),
}


def skipped_rules(tables: dict[str, DataFrame]) -> list[str]:
    """Cross-table rules that concern a given table but miss another one they read."""
    return [rule for rule, needs in NEEDS.items() if any(n in tables for n in needs) and not all(n in tables for n in needs)]


def violations(tables: dict[str, DataFrame]) -> DataFrame | None:
    """All violations the given tables allow to be checked; see ``skipped_rules`` for the others."""
    parts = [AUDITS[rule](tables) for rule, needs in NEEDS.items() if all(n in tables for n in needs)]
    parts += [part for part in (audit_unique_keys(tables), audit_foreign_keys(tables)) if part is not None]
    parts += [audit_row_checks(name, tables[name], tables[name].columns[:1]) for name in row_checks() if name in tables]
    merged = None
    for part in parts:
        merged = part if merged is None else merged.unionByName(part)
    return merged


POINTER = "number bigint, batch string"


def publish(tables: dict[str, DataFrame], path: str, batch: str, waived: Collection[str] = ()) -> DataFrame | None:
    """Stage the tables, audit what was staged, and name the batch current if it is clean.

    A batch that a rule concerns but whose tables do not let it be checked is refused
    unless the rule is waived by name, and so is a batch name that exists. Readers follow
    the highest number under ``{path}/current``; a pointer is added last and none is ever
    overwritten, so they see the old batch or the new one. Returns the violations, or
    None when the batch was published.
    """
    unchecked = sorted(set(skipped_rules(tables)) - set(waived))
    if unchecked:
        raise ValueError(f"rules that cannot be checked on these tables: {', '.join(unchecked)}")
    spark = next(iter(tables.values())).sparkSession
    staged = {}
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{batch}/{name}")
        staged[name] = spark.read.parquet(f"{path}/{batch}/{name}")
    found = violations(staged)
    if found is not None and not found.isEmpty():
        return found
    pointers = f"{path}/current"
    folder = spark._jvm.org.apache.hadoop.fs.Path(pointers)
    number = 0
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        number = spark.read.schema(POINTER).json(pointers).agg(F.max("number")).first()[0] or 0
    spark.createDataFrame([(number + 1, batch)], POINTER).coalesce(1).write.mode("append").json(pointers)
    return None


def current(spark, path: str, name: str) -> DataFrame:
    """Table ``name`` of the published batch."""
    batch = spark.read.schema(POINTER).json(f"{path}/current").orderBy(F.desc("number")).first()["batch"]
    return spark.read.parquet(f"{path}/{batch}/{name}")
