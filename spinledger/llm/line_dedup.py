"""Removal of repeated passages: windows of consecutive lines that occurred before.

Every text is cut at line ends, and each three lines that follow one another form a
window. A window's first occurrence, by document id and place, stays; the lines that
later ones cover are removed, overlapping windows together. Only hashes are shuffled on
the way to the repeated windows, and the join that finds later occurrences has one row
for a window on its other side, so that adaptive execution can split a common window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_END = "\n"


def _windows(lines: Column, size: int) -> Column:
    """The hash pair of each window of ``size`` lines, in order."""
    last = F.size(lines) - size
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        own = [F.get(lines, i + k) for k in range(size)]
        return F.struct(i.alias("at"), F.xxhash64(F.lit(1), *own).alias("h1"), F.xxhash64(F.lit(2), *own).alias("h2"))

    return F.transform(at, window)


def later_windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, version, at) of each window that occurred before; ``version`` hashes the text."""
    cut = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("version"), F.split("text", LINE_END).alias("lines")
    )
    windows = cut.select("doc_id", "version", F.explode(_windows(F.col("lines"), size)).alias("w")).select(
        "doc_id", "version", "w.at", "w.h1", "w.h2"
    )
    place = F.struct("doc_id", "at", "version")
    repeated = (
        windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last")
    )
    later = windows.join(repeated, ["h1", "h2"]).filter(place != F.col("first"))
    return later.select("doc_id", "version", "at")


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` with later occurrences of line windows removed from ``text``.

    All other columns stay; ``n_lines`` and ``n_removed`` follow. A text of fewer than
    ``size`` lines has no window. Rows with a null id or text stay as they are. Equal
    rows count as one occurrence and give equal rows; of two texts under one id the one
    whose window stands first, then the smaller hash, comes first. Order of windows: id,
    place, hash of the text.
    """
    covered = (
        later_windows(docs, size)
        .groupBy("doc_id", "version")
        .agg(F.collect_set("at").alias("starts"))  # at most the lines of one text
        .select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("starts").alias("__starts"))
    )
    joined = docs.withColumn("__own", F.xxhash64("text")).join(
        covered, (F.col("doc_id") == F.col("__id")) & (F.col("__own") == F.col("__version")), "left"
    )
    lines = F.split("text", LINE_END)
    starts = F.col("__starts")
    gone = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + size - 1))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    return joined.select(
        *[
            F.when(starts.isNull(), F.col("text")).otherwise(F.array_join(kept, LINE_END)).alias("text") if c == "text" else F.col(c)
            for c in docs.columns
            if c not in ("n_lines", "n_removed")
        ],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(starts.isNull(), 0).otherwise(F.size(gone)).alias("n_removed"),
    )


#: The same over a view ``documents``; ids must be unique. Three lines a window.
ORACLE = """
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), placed AS (
  SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS i FROM cut
), windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY lines[i + 1], lines[i + 2], lines[i + 3] ORDER BY doc_id, i) AS nth FROM placed
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1
), line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM cut
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE CAST(len(string_split(d.text, chr(10))) AS INTEGER) END AS n_lines,
       CAST(coalesce(n.n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
