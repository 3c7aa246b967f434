"""Approximate nearest neighbours by a forest of hash prefixes.

A vector gets one long bit string for each tree: the sides of random hyperplanes. A tree
is the sorted array of the strings of a shard of the vectors. A query descends in every
tree to the rows that share its longest prefix and then ascends in all trees together,
one bit at a time, until the rows under its prefixes are enough candidates; these are
compared exactly. Shards deal the vectors out by id, so no prefix, however common, is
one task's work, and queries meet the shards in blocks.

For the largest inner product the vectors are scaled by the largest norm and get one more
component that fills their length up to one, which makes the nearest the largest product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 32


def planes(dimension: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, trees * BITS))


def bit_strings(vectors: np.ndarray, normals: np.ndarray, trees: int) -> np.ndarray:
    """For each tree and vector the bit string, first plane highest."""
    sides = (vectors @ normals > 0).reshape(len(vectors), trees, BITS)
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return np.ascontiguousarray((sides * weights).sum(-1, dtype=np.uint64).T)


def lengthened(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Scaled to at most one, with the component that makes the length one."""
    scaled = vectors / largest
    return np.column_stack((scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))))


class Forest:
    """The sorted arrays of all trees over some vectors."""

    def __init__(self, vectors: np.ndarray, largest: float, trees: int, seed: int):
        self._normals, self._trees = planes(vectors.shape[1] + 1, trees, seed), trees
        strings = bit_strings(lengthened(vectors, largest), self._normals, trees)
        self._order = np.argsort(strings, axis=1, kind="stable")
        self._sorted = np.take_along_axis(strings, self._order, axis=1)

    def candidates(self, queries: np.ndarray, least: int, distinct: int = 1) -> Iterator[np.ndarray]:
        """Of each query the rows under its prefixes at the greatest depth that gives ``least`` of them,
        a row counted once for each tree; all rows where fewer than ``distinct`` differ."""
        length = np.sqrt((queries**2).sum(1, keepdims=True))
        strings = bit_strings(np.column_stack((queries / length, np.zeros(len(queries)))), self._normals, self._trees)
        first = np.zeros(strings.shape, dtype=np.int64)
        last = np.full(strings.shape, self._sorted.shape[1], dtype=np.int64)
        climbing = np.ones(len(queries), dtype=bool)
        for depth in range(BITS, 0, -1):
            below = np.uint64((1 << (BITS - depth)) - 1)
            own = strings[:, climbing]
            a, b = np.empty(own.shape, dtype=np.int64), np.empty(own.shape, dtype=np.int64)
            for t in range(self._trees):
                a[t] = np.searchsorted(self._sorted[t], own[t] & ~below, side="left")
                b[t] = np.searchsorted(self._sorted[t], own[t] | below, side="right")
            enough = (b - a).sum(0) >= least
            at = np.flatnonzero(climbing)[enough]
            first[:, at], last[:, at] = a[:, enough], b[:, enough]
            climbing[at] = False
            if not climbing.any():
                break
        marked = np.zeros(self._sorted.shape[1], dtype=bool)
        for q in range(len(queries)):
            if climbing[q]:
                yield np.arange(len(marked))
                continue
            marked[:] = False
            for t in range(self._trees):
                marked[self._order[t, first[t, q] : last[t, q]]] = True
            found = np.flatnonzero(marked)
            yield found if len(found) >= distinct else np.arange(len(marked))


def nearest(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows of largest inner product, ties to the smaller id, without the query's own row."""
    rows = rows[ids[rows] != own]
    rough = vectors[rows] @ query
    if len(rows) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        rows = rows[rough >= least - 1e-9 * (1 + abs(least))]
    exact = (vectors[rows] * query).sum(1)  # summed alike for every row, so that copies tie
    best = np.lexsort((ids[rows], -exact))[:k]
    return ids[rows[best]], exact[best]


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector of doubles) without null ids and without vectors that are null, empty, zero or hold
    null or non-finite components."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .filter(~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0))
    )


def search(
    table: DataFrame,
    queries: DataFrame,
    k: int = 20,
    trees: int = 32,
    share: float = 1.3,
    shard_rows: int = 8192,
    block_queries: int = 4096,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query among all other rows of ``table``.

    ``share`` is how many candidates, counted once for each tree, a query takes of a shard,
    as a part of its rows: it sets the recall. Vectors that ``usable_vectors`` drops take
    no part, as queries or candidates; all must have one length. A repeated id is one
    candidate (its largest product) and one query for each row that differs. Results are
    all candidates where there are fewer than ``k``.
    """
    rows = usable_vectors(table, id_col, vector_col)
    asked = usable_vectors(queries, id_col, vector_col).dropDuplicates()
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    size = F.size("vector")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest"), F.min(size).alias("a"), F.max(size).alias("b")).first()
    schema = "query_id bigint, vec_id bigint, score double"
    if not stats["n"]:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if stats["a"] != stats["b"]:
        raise ValueError("vectors differ in length")
    largest = float(stats["largest"])
    shards, blocks = -(-stats["n"] // shard_rows), -(-asked.count() // block_queries) or 1
    keys = ["shard", "block"]
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    one_of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    left = rows.select(one_of(shards).alias("shard"), each(blocks).alias("block"), "vec_id", "vector")
    right = asked.select(each(shards).alias("shard"), one_of(blocks).alias("block"), "vec_id", "vector")

    def find(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        vectors, ids = np.stack(shard["vector"].to_numpy()), shard["vec_id"].to_numpy()
        asking, own = np.stack(block["vector"].to_numpy()), block["vec_id"].to_numpy()
        forest = Forest(vectors, largest, trees, seed)
        least = int(np.ceil(share * len(ids))) + trees  # the query's own row is under each prefix
        found = [
            (q, *nearest(vectors, ids, asking[i], q, candidates, k))
            for i, (q, candidates) in enumerate(zip(own, forest.candidates(asking, least, k + 1), strict=True))
        ]
        return pd.DataFrame(
            {
                "query_id": np.repeat(own, [len(ids) for _, ids, _ in found]),
                "vec_id": np.concatenate([ids for _, ids, _ in found]),
                "score": np.concatenate([scores for _, _, scores in found]),
            }
        )

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(find, schema)
    if _repeats(rows):
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("vec_id").count().filter("count > 1").isEmpty()
