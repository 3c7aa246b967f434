"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Lengths lie between 1 and the capacity, so the whole packing follows from how many
pieces there are of each length. The driver packs these counts: open sequences wait
in classes by remaining capacity, and a segment tree over the capacities finds the
tightest class that still holds a piece in logarithmic time. All pieces of one length
that go to one class are placed in a single step; this gives what placing document
after document gives, since a class stays the tightest until it is empty. Its state
and its plan depend on the capacity alone, not on the number of documents. The pieces
themselves stay on the executors: each finds its sequence from its rank among the
pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spinledger.llm.common import materialize
from spinledger.llm.word_ids import word_ids

#: Most rows of the table of earlier tasks' counts that every executor gets whole; beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000


class CapacityTree:
    """Segment tree over capacities 1..size: which of them have an open sequence."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._any = bytearray(2 * self._leaves)

    def set(self, capacity: int, present: bool) -> None:
        node = self._leaves + capacity
        self._any[node] = present
        while node > 1:
            node //= 2
            self._any[node] = self._any[2 * node] or self._any[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that is present."""
        node = self._leaves + need
        if self._any[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self._any[node + 1]:
                node += 1
                while node < self._leaves:
                    node = 2 * node if self._any[2 * node] else 2 * node + 1
                return node - self._leaves
            node //= 2
        return None


class Run(NamedTuple):
    """Equal pieces: those of ``length`` from rank ``first_rank`` to before ``end_rank`` go,
    ``per`` at a time, to the sequences from ``first_sequence`` on, behind ``offset``."""

    length: int
    first_rank: int
    end_rank: int
    first_sequence: int
    per: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Pack ``counts[length]`` pieces of each length, longest first; also the number of sequences."""
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    tree, classes, runs, opened = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not classes.get(room):
                classes[room] = []
                tree.set(room, True)
            classes[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened, room = opened + n, capacity
            first, n = classes[room].pop()
            if not classes[room]:
                tree.set(room, False)
            per = room // length
            used = min(n, -(-left // per))
            placed = min(left, used * per)
            runs.append(Run(length, rank, rank + placed, first, per, capacity - room))
            full, rest = divmod(placed, per)
            put(room - per * length, first, full)
            put(room - rest * length, first + full, 1 if rest else 0)
            put(room, first + used, n - used)
            left, rank = left - placed, rank + placed
    return runs, opened


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to materialized ``pieces``.

    Each task that made pieces has numbered those of each length. A piece's rank is this
    number behind the pieces of its length of earlier tasks, so nothing is sorted and no
    task sees all pieces of a length. Equal rows are packed each for itself; an empty
    table gives an empty result.
    """
    spark = pieces.sparkSession
    own = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = own.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    rows = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task").alias("tasks")).collect()  # at most ``capacity``
    runs, _ = best_fit_decreasing({row["length"]: row["n"] for row in rows}, capacity)
    if sum(row["tasks"] for row in rows) <= BROADCAST_ROWS:
        before = F.broadcast(before)
    types = ", ".join(f"{name} bigint" for name in Run._fields)
    plan = F.broadcast(spark.createDataFrame(runs, types).withColumnRenamed("length", "run_length"))  # grows with the capacity alone
    rank = F.col("base") + F.col("within")
    at = F.col("rank") - F.col("first_rank")
    here = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    return (
        pieces.join(before, ["length", "task"])
        .withColumn("rank", rank)
        .join(plan, here)
        .withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - first_rank) div per"))
        .withColumn("offset", F.col("offset") + at % F.col("per") * F.col("length"))
        .select(*[c for c in pieces.columns if c not in ("task", "within")], "sequence_id", "offset")
    )


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False, id_type: str = "<u4"
) -> DataFrame:
    """Tokenize whole texts, append ``end_id`` and cut what is longer than ``capacity``.

    A null or empty text is the end id alone. Other columns of ``docs`` are not read.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task = word_ids(tokenizer, end_id), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            docs, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for i in range(0, len(texts), 500):
                rows = []
                for doc, ids in zip(docs[i : i + 500], encoder.encode_batch(texts[i : i + 500]), strict=True):
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        length = len(part) // 4
                        row = (doc, piece, start // 4, length, zlib.crc32(part), task, seen[length])
                        rows.append((*row, np.frombuffer(part, "<u4").astype(id_type).tobytes()) if with_ids else row)
                        seen[length] += 1
                frame = pd.DataFrame(rows, columns=names)
                yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, within bigint" + ", ids binary" * with_ids
    names = [field.split()[0] for field in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document: where it lies in which sequence.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document
    with a null id is packed too. Repeated rows are separate documents.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
