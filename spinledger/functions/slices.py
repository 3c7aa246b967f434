"""Ordered calculations over groups of any size.

A plain window puts a whole group into one task. Here a group is cut into slices
of its ordering axis and shuffled by (group, slice). ``scan_slices`` hands each
slice a summary of the slices before or after it; ``with_halo`` copies the rows
near an edge into the neighbouring slice. Both give the same result as one window
over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
CORE = "_core"


def slice_of(at: str | Column, width: float) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.lit(width)).cast("long")


def scan_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_column: Column,
    *,
    max_before: dict[str, str] | None = None,
    max_through: dict[str, str] | None = None,
    sum_through: dict[str, str] | None = None,
    previous: dict[str, Sequence[str]] | None = None,
    following: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Add running values in ``order`` within ``keys`` (new name -> source column).

    ``max_before`` looks at earlier rows only; ``max_through`` and ``sum_through``
    include the row itself. ``previous`` and ``following`` give the adjacent row as
    a struct of the named columns. ``slice_column`` must not decrease along
    ``order``, and ``order`` must be a total order within ``keys``.
    """
    max_before, max_through = max_before or {}, max_through or {}
    sum_through = sum_through or {}
    previous, following = previous or {}, following or {}
    sliced = df.withColumn(SLICE, slice_column)
    group = [*keys, SLICE]

    def ranked(names: Sequence[str]) -> Column:
        return F.struct(
            F.struct(*[F.col(c) for c in order]).alias("o"),
            F.struct(*[F.col(c) for c in names]).alias("v"),
        )

    summary = sliced.groupBy(*group).agg(
        *[F.max(src).alias(f"_m_{new}") for new, src in {**max_before, **max_through}.items()],
        *[F.sum(src).alias(f"_s_{new}") for new, src in sum_through.items()],
        *[F.max(ranked(names)).alias(f"_p_{new}") for new, names in previous.items()],
        *[F.min(ranked(names)).alias(f"_f_{new}") for new, names in following.items()],
    )
    across = Window.partitionBy(*keys).orderBy(SLICE)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carries = summary.select(
        *group,
        *[F.max(f"_m_{n}").over(earlier).alias(f"_c_{n}") for n in {**max_before, **max_through}],
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in sum_through],
        *[F.lag(f"_p_{n}").over(across).alias(f"_c_{n}") for n in previous],
        *[F.lead(f"_f_{n}").over(across).alias(f"_c_{n}") for n in following],
    )
    inside = Window.partitionBy(*group).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    through = inside.rowsBetween(Window.unboundedPreceding, 0)
    new_columns = {
        **{n: F.greatest(F.max(s).over(before), F.col(f"_c_{n}")) for n, s in max_before.items()},
        **{n: F.greatest(F.max(s).over(through), F.col(f"_c_{n}")) for n, s in max_through.items()},
        **{
            n: F.sum(s).over(through) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
            for n, s in sum_through.items()
        },
        **{
            n: F.coalesce(F.lag(F.struct(*names)).over(inside), F.col(f"_c_{n}.v"))
            for n, names in previous.items()
        },
        **{
            n: F.coalesce(F.lead(F.struct(*names)).over(inside), F.col(f"_c_{n}.v"))
            for n, names in following.items()
        },
    }
    joined = sliced.join(carries, group)
    return joined.select(*df.columns, *[c.alias(n) for n, c in new_columns.items()])


def with_halo(df: DataFrame, at: str, width: int, before: float, after: float) -> DataFrame:
    """Copy each row into every slice whose rows may look at it.

    A row in slice ``s`` may look back ``before`` and ahead ``after`` along ``at``.
    Adds the slice number and ``_core``, true in the row's own slice only. The halo
    must not be wider than a slice, so a row has at most three copies.
    """
    if max(before, after) > width:
        raise ValueError("a halo must not be wider than its slice")
    home = slice_of(at, width)
    first, last = slice_of(F.col(at) - F.lit(after), width), slice_of(F.col(at) + F.lit(before), width)
    return df.withColumn("_home", home).withColumn(
        SLICE, F.explode(F.sequence(first, last))
    ).withColumn(CORE, F.col(SLICE) == F.col("_home")).drop("_home")


def spanned_slices(start: str | Column, end: str | Column, width: float) -> Column:
    """The slices an interval touches, for joining intervals to points or intervals."""
    return F.sequence(slice_of(start, width), slice_of(end, width))
