"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def salt_of(columns: Sequence[str], salts: int) -> Column:
    """A row's salt. It depends on the row alone, so a retried task repeats it."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_lookup(
    facts: DataFrame,
    dims: DataFrame,
    on: Sequence[str],
    *,
    spread_by: Sequence[str],
    salts: int = 8,
    how: str = "left",
) -> DataFrame:
    """Join many facts to few dimension rows when one key may own a third of the facts.

    Each fact goes to one of ``salts`` sub-keys and each dimension row to all of
    them, so every pair still meets exactly once. ``how`` is inner, left, left_semi
    or left_anti: the kinds that never need an unmatched dimension row. Small
    dimensions are still broadcast when Spark's size check allows it. The check counts
    the copies because a cross join makes them; it would take an exploded array for one row.

    A dimension about as large as the facts should be neither copied nor broadcast:
    ``salts=1`` joins by shuffle and leaves a hot key to the adaptive skew join, which
    splits it.
    """
    if salts == 1:
        plain = facts.join(dims.hint("merge"), list(on), how)
        return plain.select(*facts.columns) if how in ("left_semi", "left_anti") else plain
    left = facts.withColumn(SALT, salt_of(spread_by, salts))
    right = dims.crossJoin(F.broadcast(dims.sparkSession.range(salts).select(F.col("id").cast("int").alias(SALT))))
    joined = left.join(right, [*on, SALT], how).drop(SALT)
    return joined.select(*facts.columns) if how in ("left_semi", "left_anti") else joined


def key_bits(rows: DataFrame, keys: Sequence[str], bits: int = 1 << 22) -> DataFrame:
    """A table of ``bits`` bits, one set for the hash of each key of ``rows``: ``bits / 64`` rows at most."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    set_bit = F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))")
    return rows.select(bit.alias("_bit")).groupBy(F.floor(F.col("_bit") / 64).cast("long").alias("_word")).agg(set_bit.alias("_bits"))


def may_meet(rows: DataFrame, table: DataFrame, keys: Sequence[str], bits: int = 1 << 22) -> DataFrame:
    """The rows whose key may stand in the table that :func:`key_bits` made with the same ``bits``.

    Some that do not may stay; a join has to follow. The table has a fixed size, so every
    executor gets it whole.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    looked_up = rows.withColumn("_bit", bit).join(
        F.broadcast(table), F.floor(F.col("_bit") / 64).cast("long") == F.col("_word")
    )
    return looked_up.where(F.expr("getbit(_bits, cast(_bit % 64 as int)) = 1")).select(*rows.columns)
