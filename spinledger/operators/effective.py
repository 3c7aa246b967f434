"""Tariffs, weights and splits in force on the day of use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinledger.functions.slices import scan_slices, slice_of

def disjoint_versions(
    versions: DataFrame, on: Sequence[str], payload: Sequence[str], prefer: Sequence[Column] = ()
) -> DataFrame:
    """The version in force for each stretch of days of a key: ``on``, ``_begin``, ``_end`` (null: open), ``_v``.

    Stretches of a key do not overlap. Where several versions are in force ``prefer``
    decides, then the latest ``valid_from``. The versions of one key are few.
    """
    end = F.date_add("valid_to", 1)
    points = versions.select(*on, F.explode(F.array("valid_from", end)).alias("_begin")).where("_begin is not null").distinct()
    stretches = points.withColumn("_end", F.lead("_begin").over(Window.partitionBy(*on).orderBy("_begin")))
    rank = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prefer)], F.col("valid_from"))
    ranked = versions.select(*on, "valid_from", "valid_to", F.struct(rank.alias("rank"), F.struct(*payload).alias("v")).alias("_ranked"))
    covering = stretches.join(ranked, list(on)).where(
        (F.col("valid_from") <= F.col("_begin")) & (F.col("valid_to").isNull() | (F.col("_begin") <= F.col("valid_to")))
    )
    return covering.groupBy(*on, "_begin", "_end").agg(F.max("_ranked")["v"].alias("_v"))


def effective_at(
    facts: DataFrame,
    versions: DataFrame,
    on: Sequence[str],
    *,
    at: str,
    payload: Sequence[str],
    prefer: Sequence[Column] = (),
) -> DataFrame:
    """Left as-of join: each fact, equal ones included, with the version valid on its day.

    Versions are made disjoint first, so a fact meets at most one. The days that facts of
    a key ask for and the days on which its versions begin go into one table, and in the
    order of days the last version is carried forward; a key has as many rows there as
    days and versions, however many facts it has, and no version is copied. The answers,
    one for each key and day, then join the facts on equal keys and days, a join that
    Spark broadcasts when small and whose hot keys it splits when not.
    """
    asked = facts.where(F.col(at).isNotNull()).select(*on, F.col(at).alias("_begin")).distinct()
    version = F.struct("_end", "_v").alias("_version")
    begins = disjoint_versions(versions, on, payload, prefer).select(*on, "_begin", F.lit(0).alias("_asked"), version)
    none = F.lit(None).cast(begins.schema["_version"].dataType).alias("_version")
    merged = begins.unionByName(asked.select(*on, "_begin", F.lit(1).alias("_asked"), none))
    through = Window.partitionBy(*on).orderBy("_begin", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    carried = merged.withColumn("_last", F.last("_version", ignorenulls=True).over(through)).where(
        "_asked = 1 and _last is not null and (_last._end is null or _begin < _last._end)"
    )
    answers = carried.select(*[F.col(c).alias(f"_on_{c}") for c in on], F.col("_begin").alias("_on_day"), F.col("_last._v").alias("_v"))
    same = F.col(at) == F.col("_on_day")
    for c in on:
        same = same & (F.col(c) == F.col(f"_on_{c}"))
    met = facts.join(answers, same, "left")
    return met.select(*facts.columns, *[F.col(f"_v.{c}").alias(c) for c in payload])


def effective_weight(usage: DataFrame, weights: DataFrame) -> DataFrame:
    return effective_at(usage, weights, ["source_id"], at="used_on", payload=["weight"])


def effective_tariff(usage: DataFrame, tariffs: DataFrame) -> DataFrame:
    """A tariff for the source type beats one for any source type, then the later one.

    Both are looked up for the days and keys that are asked for, not for each usage row.
    """
    columns = ["tariff_id", "base_rate_ugx"]
    key = ["catalog_id", "right_type"]
    full = [*key, "source_type", "used_on"]
    asked = usage.select(*full).distinct()
    own = effective_at(asked, tariffs.where("source_type is not null"), [*key, "source_type"], at="used_on", payload=columns)
    named = own.withColumnsRenamed({c: f"_own_{c}" for c in columns})
    general = effective_at(named, tariffs.where("source_type is null"), key, at="used_on", payload=columns)
    mine = F.col("_own_tariff_id").isNotNull()
    chosen = general.select(
        *[F.col(c).alias(f"_on_{c}") for c in full], *[F.when(mine, F.col(f"_own_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    ).where("tariff_id is not null")
    same = F.col("source_type").eqNullSafe(F.col("_on_source_type"))  # of an unknown type, a general tariff holds
    for c in (*key, "used_on"):
        same = same & (F.col(c) == F.col(f"_on_{c}"))
    kept = [c for c in usage.columns if c not in columns]
    return usage.select(*kept).join(chosen, same, "left").select(*kept, *columns)


def active_split(usage: DataFrame, sheets: DataFrame, recording_works: DataFrame) -> DataFrame:
    """The active sheet in force: of the recording for master rights, of its works otherwise.

    Usage of other than master rights comes back once for each linked work, named by
    ``work_id``; a recording without works has one row and no sheet.
    """
    active = sheets.where(F.col("status") == "active")
    master = F.col("right_type") == "master"
    columns = ["right_type", "split_sheet_id", "valid_from", "valid_to"]
    own = effective_at(
        usage.where(master).withColumn("work_id", F.lit(None).cast(sheets.schema["work_id"].dataType)),
        active.where(master).select("recording_id", *columns),
        ["recording_id", "right_type"],
        at="used_on",
        payload=["split_sheet_id"],
    )
    links = recording_works.select("recording_id", "work_id").distinct()
    linked = usage.where(F.col("right_type").isNull() | ~master).join(links.hint("merge"), "recording_id", "left").select(*usage.columns, "work_id")
    of_works = effective_at(
        linked, active.where(~master).select("work_id", *columns), ["work_id", "right_type"], at="used_on", payload=["split_sheet_id"]
    )
    return own.unionByName(of_works)


def overlapping_weights(weights: DataFrame) -> DataFrame:
    """Rows that start before an earlier interval of their source has ended.

    A running maximum of the end dates finds them without pairing the intervals.
    """
    end = F.datediff(F.coalesce("valid_to", F.lit("9999-12-31").cast("date")), F.lit("1970-01-01").cast("date"))
    rows = weights.withColumn("_end", end).withColumn("_start", F.datediff("valid_from", F.lit("1970-01-01").cast("date")))
    reached = scan_slices(
        rows, ["source_id"], ["_start", "_end", "weight_id"], slice_of("_start", 366.0), max_before={"_reach": "_end"}
    )
    return reached.where(F.col("_start") <= F.col("_reach")).drop("_start", "_end", "_reach")


def next_version(sheets: DataFrame) -> DataFrame:
    """The version a new sheet of the same right and asset gets."""
    return sheets.groupBy("right_type", "recording_id", "work_id").agg(
        (F.max("version") + 1).alias("next_version")
    )


def supersede(sheets: DataFrame, activated: DataFrame) -> DataFrame:
    """Close the older active sheets of every asset that got a new active sheet.

    ``activated`` holds ``split_sheet_id, right_type, recording_id, work_id, valid_from``
    of the new sheets, one per asset and right.
    """
    new = activated.select(
        F.col("split_sheet_id").alias("_new"),
        F.col("right_type").alias("_right"),
        F.col("recording_id").alias("_recording"),
        F.col("work_id").alias("_work"),
        F.col("valid_from").alias("_new_from"),
    )
    same_asset = (
        (F.col("right_type") == F.col("_right"))
        & F.col("recording_id").eqNullSafe(F.col("_recording"))
        & F.col("work_id").eqNullSafe(F.col("_work"))
    )
    older = (F.col("status") == "active") & F.col("_new").isNotNull() & (F.col("split_sheet_id") != F.col("_new"))
    return (
        sheets.join(new.hint("merge"), same_asset, "left")
        .withColumn("_older", older)
        .withColumn("valid_to", F.when(F.col("_older"), F.col("_new_from")).otherwise(F.col("valid_to")))
        .withColumn("status", F.when(F.col("_older"), "superseded").otherwise(F.col("status")))
        .select(*sheets.columns)
    )


def latest_per_key(rows: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    latest = Window.partitionBy(*keys).orderBy(F.desc(by))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
