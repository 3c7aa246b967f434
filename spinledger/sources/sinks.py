"""Writers. Appends are keyed by hashes, so a repeated batch can be recognised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinledger.schemas import FINANCE_WORDS


def landmark_transport(landmarks: DataFrame) -> DataFrame:
    """The stable exchange form of landmarks."""
    return landmarks.select(
        "schema_id",
        "track_id",
        "hash_index",
        "anchor_frame",
        F.col("ratio_bin").alias("frequency_ratio_bin"),
        "delta_frames",
    )


def write_landmarks(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The index as Parquet by schema, sorted by key inside each file.

    ``repartitionByRange`` on the key cuts a hot key over several files.
    """
    (
        index.repartitionByRange("schema_id", "ratio_bin", "delta_frames", "track_id", "hash_index")
        .sortWithinPartitions("ratio_bin", "delta_frames")
        .write.mode(mode)
        .partitionBy("schema_id")
        .parquet(path)
    )


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key is not yet in the table at ``path``."""
    spark = rows.sparkSession
    try:
        seen = spark.read.parquet(path).select(key)
    except Exception as error:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        rows.dropDuplicates([key]).write.mode("append").parquet(path)
        return
    rows.dropDuplicates([key]).join(seen, key, "left_anti").write.mode("append").parquet(path)


def append_detections(detections: DataFrame, path: str) -> None:
    append_new(detections, path, "idempotency_key")


def append_audit(events: DataFrame, path: str) -> None:
    """Audit rows: action, entity, actor and JSON metadata, stamped when written."""
    events.withColumn("occurred_at", F.current_timestamp()).write.mode("append").parquet(path)


def finance_columns(schema: T.StructType) -> list[str]:
    """Column names, nested ones included, that a report may not contain."""
    found: list[str] = []

    def visit(kind: T.DataType, prefix: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                name = f"{prefix}{field.name}"
                if any(word in field.name.lower() for word in FINANCE_WORDS):
                    found.append(name)
                visit(field.dataType, f"{name}.")
        elif isinstance(kind, T.ArrayType):
            visit(kind.elementType, prefix)
        elif isinstance(kind, T.MapType):
            visit(kind.valueType, prefix)

    visit(schema, "")
    return found


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each part of the report as JSON lines under ``path``; finance columns are refused."""
    for name, table in tables.items():
        refused = finance_columns(table.schema)
        if refused:
            raise ValueError(f"report part {name} has finance columns: {refused}")
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")
