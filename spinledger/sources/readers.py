"""Readers for the documents and tables of a monitoring pilot. No schema is inferred."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinledger import schemas as S
from spinledger.functions.columns import error_list, is_blank, parse_timestamp


def read_manifests(spark: SparkSession, path: str, *, stream: bool = False, **options: str) -> DataFrame:
    """Chunk manifests: JSON arrays or JSON lines, as a batch or a file stream."""
    reader = (spark.readStream if stream else spark.read).schema(S.MANIFEST).options(**options)
    if not stream:
        reader = reader.option("multiLine", options.get("multiLine", "true"))
    return reader.json(path)


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each file is one JSON map; the files are spread over the tasks."""
    return _parsed(spark.read.text(path, wholetext=True), schema)


def _parsed(text: DataFrame, schema: str) -> DataFrame:
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("doc"))


def read_station_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log rows with their position in the source's list as ``log_index``."""
    return parse_station_logs(spark.read.text(path, wholetext=True))


def parse_station_logs(text: DataFrame) -> DataFrame:
    """Log rows of JSON maps held in a text column ``value``."""
    rows = _parsed(text, S.LOG_ENTRIES).select(F.explode("doc").alias("source_code", "entries"))
    entry = rows.select("source_code", F.posexplode("entries").alias("log_index", "e"))
    return entry.select(
        "source_code",
        F.col("log_index").cast("long").alias("log_index"),
        parse_timestamp("e.aired_at").alias("aired_at"),
        F.coalesce("e.title", F.lit("")).alias("title"),
        "e.artist",
        "e.recording_id",
        "e.isrc",
        F.coalesce("e.known_catalog", F.lit(True)).alias("known_catalog"),
    )


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, S.REVIEWS).select(F.explode("doc").alias("edge_chunk_id", "status"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Supplied candidates; ``rank`` is the position in the chunk's list."""
    rows = _documents(spark, path, S.CANDIDATES).select(F.explode("doc").alias("edge_chunk_id", "items"))
    return rows.select("edge_chunk_id", F.posexplode("items").alias("rank", "c")).select(
        "edge_chunk_id",
        "rank",
        "c.recording_id",
        F.coalesce("c.votes", F.lit(0)).alias("votes"),
        F.coalesce("c.confidence_hint", F.lit(0.0)).alias("confidence_hint"),
        "c.tempo_scale",
        "c.title",
        "c.artist",
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    rows = _documents(spark, path, S.CATALOG).select(F.explode("doc").alias("recording_id", "m"))
    return rows.select("recording_id", "m.title", "m.artist", "m.isrc")


def source_errors() -> Column:
    return error_list(
        (is_blank("source_code"), "source_code is required"),
        (is_blank("display_name"), "display_name is required"),
        (~F.coalesce(F.col("region").isin(*S.PILOT_REGIONS), F.lit(False)), f"region must be one of {sorted(S.PILOT_REGIONS)}"),
        (~F.col("source_class").isin(*S.SOURCE_CLASSES), f"source_class must be one of {sorted(S.SOURCE_CLASSES)}"),
    )


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Pilot sources with defaults and the ``errors`` of each row."""
    rows = spark.read.schema(S.SOURCES).option("multiLine", "true").json(path)
    filled = rows.withColumn("source_class", F.coalesce("source_class", F.lit("fm_stream"))).withColumn(
        "agreed", F.coalesce("agreed", F.lit(True))
    )
    return filled.withColumn("errors", source_errors())


def read_match_windows(spark: SparkSession, path: str, *, multiLine: str = "true") -> DataFrame:
    return spark.read.schema(S.MATCH_WINDOWS).option("multiLine", multiLine).json(path)


def read_onboarding(spark: SparkSession, path: str) -> DataFrame:
    """Onboarding documents, one JSON object per line; unreadable lines keep their text."""
    return spark.read.schema(f"{S.ONBOARDING}, _corrupt_record string").json(path)


def read_table(spark: SparkSession, path: str, *, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """A core table from Parquet; the filter and the columns reach the scan."""
    rows = spark.read.parquet(path)
    if where is not None:
        rows = rows.where(where)
    return rows if columns is None else rows.select(*columns)


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, *, partition_column: str, bounds: tuple[int, int], partitions: int, **options: str
) -> DataFrame:
    """A core table from a relational database, read in parallel ranges with pushdown."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .options(
            partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
        .load()
    )


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """Uncompressed 8, 16, 24 and 32 bit PCM WAV clips as mono samples in [-1, 1).

    Rows whose file cannot be decoded carry ``error`` and no samples.
    """

    def decode(content: bytes) -> tuple[int, np.ndarray]:
        with wave.open(io.BytesIO(content), "rb") as clip:
            channels, width, rate = clip.getnchannels(), clip.getsampwidth(), clip.getframerate()
            raw = clip.readframes(clip.getnframes())
        if width == 1:
            values = (np.frombuffer(raw, "u1").astype("f8") - 128.0) / 128.0
        elif width == 3:
            octets = np.frombuffer(raw[: len(raw) // 3 * 3], "u1").reshape(-1, 3).astype("i4")
            whole = octets[:, 0] | (octets[:, 1] << 8) | (octets[:, 2] << 16)
            values = np.where(whole & 0x800000, whole - (1 << 24), whole) / float(1 << 23)
        elif width in (2, 4):
            values = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
        else:
            raise ValueError(f"unsupported PCM sample width: {width} bytes")
        if len(values) % channels:
            raise ValueError("WAV sample data does not contain complete channel frames")
        return rate, values.reshape(-1, channels).mean(axis=1)

    def decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rate, samples = decode(content)
                    out.append((path_, rate, samples, None))
                except (ValueError, EOFError, wave.Error) as error:
                    out.append((path_, None, None, str(error)))
            yield pd.DataFrame(out, columns=["clip_id", "sample_rate", "samples", "error"]).astype({"sample_rate": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(
        decode_batches, "clip_id string, sample_rate int, samples array<double>, error string"
    )
