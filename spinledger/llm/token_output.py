"""Packed id matrices for training: best-fit-decreasing sequences as binary rows.

A row of the matrix is one sequence of ``capacity`` ids. The cumulative segment lengths
tell where its documents begin, and positions count anew from 0 in each segment, so that
attention can be kept within a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.llm.common import materialize
from spinledger.llm.packing import pack, token_pieces
from spinledger.llm.word_ids import word_ids


def packed_matrix(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_type: str = "<u2", pad_id: int = 0
) -> DataFrame:
    """One row for each sequence.

    Columns: sequence_id; n_tokens; ids (``capacity`` ids of ``id_type``, padded with
    ``pad_id``); positions (as many unsigned 16-bit positions, 0 in the padding);
    cu_seqlens (0 and the end of each segment); doc_ids, pieces and starts (of each
    segment, so that cut documents can be joined again without loss). Null and empty
    texts are the end id alone; an empty table gives no sequences. A vocabulary with ids
    that ``id_type`` cannot hold is refused.
    """
    if capacity > 65536:
        raise ValueError("positions are 16 bits wide")
    largest = max(word_ids(tokenizer, end_id).largest, pad_id)
    if largest > np.iinfo(id_type).max or min(end_id, pad_id) < np.iinfo(id_type).min:
        raise ValueError(f"ids up to {largest} do not fit {id_type}")
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, True, id_type), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids"]
    placed = pack(pieces, capacity).select("sequence_id", "offset", *columns)
    segments = F.sort_array(F.collect_list(F.struct("offset", *columns)))  # at most ``capacity`` of them
    rows = placed.groupBy("sequence_id").agg(segments.alias("s")).select("sequence_id", *[F.col(f"s.{c}").alias(c) for c in columns])
    width = np.dtype(id_type).itemsize

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                lengths = np.asarray(row.length, dtype=np.int64)
                ends = np.concatenate(([0], lengths.cumsum()))
                n = int(ends[-1])
                positions = np.zeros(capacity, "<u2")
                positions[:n] = np.arange(n) - np.repeat(ends[:-1], lengths)
                padding = np.full(capacity - n, pad_id, id_type).tobytes()
                ids = b"".join(row.ids) + padding
                if len(ids) != capacity * width:
                    raise ValueError(f"sequence {row.sequence_id} is not whole")
                out.append((row.sequence_id, n, ids, positions.tobytes(), ends.tolist(), row.doc_id, row.piece, row.start))
            names = ["sequence_id", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "pieces", "starts"]
            yield pd.DataFrame(out, columns=names)

    schema = (
        "sequence_id bigint, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, "
        "doc_ids array<bigint>, pieces array<int>, starts array<bigint>"
    )
    return rows.mapInPandas(build, schema)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Write the rows as Parquet in sequence order within files; any Spark path will do."""
    matrix.sortWithinPartitions("sequence_id").write.mode("errorifexists").parquet(path)
