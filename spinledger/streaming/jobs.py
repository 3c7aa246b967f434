"""Streams of manifests, match windows, device requests and review commands.

``foreachBatch`` jobs may be handed the same batch twice after a failure. Every sink
here writes to a folder named by the stream's checkpoint and the batch, so a repeat
replaces its own output and a second stream never touches the first one's.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spinledger.config import FingerprintConfig, MatcherConfig
from spinledger.operators.ingest import ingest
from spinledger.operators.lifecycle import STATES, first_states, judged_commands, next_outcome
from spinledger.operators.matching import chunk_landmarks, match
from spinledger.operators.validation import validate_manifests

REPLAY_WINDOW = "5 minutes"


def _table(spark, path: str, schema) -> DataFrame:
    """The table at ``path``, or an empty one before the first batch."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def _name(checkpoint: str) -> str:
    return sha256(checkpoint.encode()).hexdigest()[:16]


def _folder(path: str, checkpoint: str, number: int) -> str:
    return f"{path}/run={_name(checkpoint)}/batch={number}"


def _earlier(table: DataFrame, checkpoint: str, number: int) -> DataFrame:
    """Rows of other streams and of this stream's earlier batches."""
    mine = (F.col("run") == _name(checkpoint)) & (F.col("batch") >= number)
    return table.where(~mine).drop("run", "batch")


def _run(stream: DataFrame, handle, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def route_manifests(stream: DataFrame, valid_path: str, rejected_path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Validate each manifest and write it to the valid or the rejected table."""

    def handle(batch: DataFrame, number: int) -> None:
        valid, rejected = validate_manifests(batch)
        valid.write.mode("overwrite").parquet(_folder(valid_path, checkpoint, number))
        rejected.write.mode("overwrite").parquet(_folder(rejected_path, checkpoint, number))

    return _run(stream, handle, checkpoint, once)


def receive_once(
    stream: DataFrame,
    sources: DataFrame,
    path: str,
    schema_id: str,
    checkpoint: str,
    index: DataFrame | None = None,
    cfg: FingerprintConfig = FingerprintConfig(),
    matcher: MatcherConfig = MatcherConfig(),
    *,
    once: bool = True,
) -> StreamingQuery:
    """Receive each chunk id once, ever, and match it against the index.

    The receipts table, not the state store, remembers the ids: it has no horizon. A
    batch ignores what an earlier attempt of itself wrote, then replaces it.
    """
    receipt_schema = (
        "receipt_id string, edge_chunk_id string, source_id string, device_id string, started_at timestamp, "
        "ended_at timestamp, byte_count bigint, content_sha256 string, capture_policy string, "
        "fingerprint_schema_id string, landmark_count int, schema_compatible boolean, status string, run string, batch bigint"
    )
    detection_schema = (
        "detection_id string, idempotency_key string, capture_chunk_id string, source_id string, recording_id string, "
        "started_at timestamp, ended_at timestamp, duration_seconds decimal(10,3), matcher_version string, "
        "fingerprint_schema_id string, matched_hash_count bigint, match_confidence decimal(6,5), "
        "reference_per_query_tempo_scale decimal(7,5), offset_seconds double, status string, run string, batch bigint"
    )

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _earlier(_table(spark, f"{path}/receipts", receipt_schema), checkpoint, number)
        known = _earlier(_table(spark, f"{path}/detections", detection_schema), checkpoint, number)
        valid, _ = validate_manifests(batch)
        arrived = valid.withColumn("arrival", F.monotonically_increasing_id())
        result = ingest(arrived, old, known, sources, index, schema_id, cfg, matcher)
        for name in ("receipts", "detections", "replays", "unknown_sources", "audit"):
            result[name].write.mode("overwrite").parquet(_folder(f"{path}/{name}", checkpoint, number))

    return _run(stream, handle, checkpoint, once)


def match_stream(
    stream: DataFrame,
    index: DataFrame,
    schema_id: str,
    path: str,
    checkpoint: str,
    cfg: FingerprintConfig = FingerprintConfig(),
    matcher: MatcherConfig = MatcherConfig(),
    *,
    once: bool = True,
) -> StreamingQuery:
    """Candidates of every micro-batch against a static index."""

    def handle(batch: DataFrame, number: int) -> None:
        valid, _ = validate_manifests(batch)
        found = match(chunk_landmarks(valid, schema_id), index.where(F.col("schema_id") == schema_id), cfg, matcher)
        found.write.mode("overwrite").parquet(_folder(path, checkpoint, number))

    return _run(stream, handle, checkpoint, once)


def fresh_requests(requests: DataFrame, now: str = "received_at") -> DataFrame:
    """Requests whose own time lies within five minutes of their arrival."""
    distance = F.abs(F.unix_micros(F.col(now)) - F.unix_micros("ts"))
    return requests.where(distance <= 5 * 60 * 1_000_000)


def single_use(requests: DataFrame, now: str = "received_at") -> DataFrame:
    """Fresh requests, each (device, time, body digest) once, as a stream.

    A fresh request's copies are at most five minutes late or early, so twice that
    watermark holds every copy that could still pass the freshness test.
    """
    fresh = fresh_requests(requests, now).withWatermark("ts", "10 minutes")
    return fresh.dropDuplicatesWithinWatermark(["device_id", "ts", "body_sha256"])


def session_clusters(windows: DataFrame, gap_seconds: float = 12.0, lateness: str = "1 hour") -> DataFrame:
    """Clusters of match windows per session and track.

    ``windows`` has ``window_start`` and ``window_end`` timestamps. A window keeps its
    session open until ``gap_seconds`` after its own end.
    """
    length = (F.unix_micros("window_end") - F.unix_micros("window_start")) / F.lit(1e6)
    zero = F.lit(0)
    keep_open = F.make_interval(zero, zero, zero, zero, zero, zero, (length + F.lit(gap_seconds)).cast("decimal(18,6)"))
    source = windows.withWatermark("window_start", lateness) if windows.isStreaming else windows
    return source.groupBy(
        "session_id", "track_id", F.session_window("window_start", keep_open).alias("w")
    ).agg(
        F.min("window_start").alias("started_at"),
        F.max("window_end").alias("ended_at"),
        F.count(F.lit(1)).alias("evidence_windows"),
    ).drop("w")


def source_counts(manifests: DataFrame) -> DataFrame:
    """Running chunk and byte counts per source (update mode)."""
    return manifests.groupBy("source_code").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("byte_count").alias("bytes")
    )


class ReviewState(StatefulProcessor):
    """A detection's state, kept from its first command on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "state int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        commands = pd.concat(list(rows)).sort_values("seq", kind="stable")
        kept = self._state.exists()
        first = None if pd.isna(commands["first"].iloc[0]) else int(commands["first"].iloc[0])
        state, out = self._state.get()[0] if kept else first, []
        for seq, action, error in zip(commands["seq"], commands["action"], commands["error"], strict=True):
            error = None if pd.isna(error) else error
            state, reason = next_outcome(state, None if pd.isna(action) else int(action), error)
            status, opened = (None, None) if state is None else STATES[state]
            out.append((key[0], int(seq), reason is None, reason, status, opened))
        if state is not None:
            self._state.update((state,))
        yield pd.DataFrame(out, columns=["detection_id", "seq", "accepted", "reason", "status_after", "dispute_open_after"])

    def close(self) -> None:
        pass


def apply_command_stream(
    stream: DataFrame, detections: DataFrame, disputes: DataFrame, path: str, checkpoint: str, *, once: bool = True
) -> StreamingQuery:
    """Apply review commands as they arrive; outcomes are appended per batch.

    Commands take effect in the order of arrival: batch after batch, by ``seq`` within
    one. The state store keeps the state of each detection that had a command, so no
    batch reads earlier outcomes, and a smaller ``seq`` that comes later starts from the
    state that is in force. Until its first command a detection has the state of
    ``detections`` and ``disputes`` as they were when the query started. The commands of
    one detection in one batch are one group in memory; limit a batch by the source's
    options.
    """
    judged = judged_commands(stream).join(first_states(detections, disputes), "detection_id", "left")
    kind = stream.schema["detection_id"].dataType.simpleString()
    outcomes = (
        judged.select("detection_id", "seq", F.col("_action").alias("action"), F.col("_error").alias("error"), F.col("_start").alias("first"))
        .groupBy("detection_id")
        .transformWithStateInPandas(
            ReviewState(),
            f"detection_id {kind}, seq bigint, accepted boolean, reason string, status_after string, dispute_open_after boolean",
            "append",
            "none",
        )
    )

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_folder(path, checkpoint, number))

    with _keyed_state(stream.sparkSession):
        return _run(outcomes, handle, checkpoint, once)


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Start a query with the state store that stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


__all__ = [
    "apply_command_stream", "fresh_requests", "match_stream", "receive_once", "route_manifests",
    "session_clusters", "single_use", "source_counts",
]
