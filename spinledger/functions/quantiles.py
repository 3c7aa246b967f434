"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _magnitude_bucket(value: Column) -> Column:
    """A bucket number that never decreases as ``value`` grows: 512 per octave."""
    depth = F.floor(F.log2(F.abs(value)) * F.lit(512.0)) + F.lit(600_000)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * depth).cast("long")


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The median of ``value`` per key, midpoint of the two middle values if even.

    Values are counted per bucket first (a partial aggregate), the buckets holding
    the middle ranks are found, and only their values are ranked. No task ever holds
    a whole group.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.withColumn("_b", _magnitude_bucket(F.col("_v")))
    along = Window.partitionBy(*keys).orderBy("_b")
    buckets = (
        rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_hi", F.sum("_n").over(along))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
        .withColumn("_r1", F.expr("(_total - 1) div 2"))
        .withColumn("_r2", F.expr("_total div 2"))
    )
    middle = buckets.where(
        "(_lo <= _r1 and _r1 < _hi) or (_lo <= _r2 and _r2 < _hi)"
    ).select(*keys, "_b", "_lo", "_r1", "_r2")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    ranked = (
        rows.join(middle, [*keys, "_b"])
        .groupBy(*keys, "_b", "_lo", "_r1", "_r2", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_to", F.col("_lo") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )
    return ranked.groupBy(*keys).agg(
        (
            (
                F.max(F.expr("case when _from <= _r1 and _r1 < _to then _v end"))
                + F.max(F.expr("case when _from <= _r2 and _r2 < _to then _v end"))
            )
            / 2
        ).alias(name)
    )
