"""Streams against the same calculation in batch."""

import json
import random

from pyspark.sql import functions as F

from spinledger.config import FingerprintConfig, MatcherConfig
from spinledger.operators.matching import with_hash_counts
from spinledger.plans.matching import match_chunks
from spinledger.sources.readers import read_manifests
from spinledger.sources.sinks import write_landmarks
from spinledger.streaming import jobs

CFG = FingerprintConfig()


def setup(spark, tmp_path):
    rng = random.Random(8)
    tracks = {f"t{k}": sorted((rng.randrange(90), rng.randrange(-9, 10), rng.randrange(1, 20)) for _ in range(50)) for k in range(4)}
    rows = [("v1", t, i, a, r, d) for t, marks in tracks.items() for i, (a, r, d) in enumerate(marks)]
    index = with_hash_counts(
        spark.createDataFrame(rows, "schema_id string, track_id string, hash_index int, anchor_frame int, ratio_bin int, delta_frames int")
    )
    write_landmarks(index, str(tmp_path / "index"))
    (tmp_path / "in").mkdir()
    for n in range(6):
        marks = tracks[f"t{n % 4}"][5:40]
        body = {
            "edge_chunk_id": f"00000000-0000-4000-8000-{n:012d}", "source_code": "s1", "device_id": "d", "started_at": "2026-07-01T10:00:00Z",
            "ended_at": "2026-07-01T10:00:30Z", "content_sha256": "b" * 64, "byte_count": 10, "fingerprint_schema_id": "v1" if n < 5 else "v0",
            "landmarks": [{"anchor_frame": a, "frequency_ratio_bin": r, "delta_frames": d} for a, r, d in marks],
        }
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(body))
    return spark.read.parquet(str(tmp_path / "index"))


def test_stream_match_equals_batch(spark, tmp_path):
    index = setup(spark, tmp_path)
    stream = read_manifests(spark, str(tmp_path / "in"), stream=True, maxFilesPerTrigger="2")
    jobs.match_stream(stream, index, "v1", str(tmp_path / "out"), str(tmp_path / "cp"), CFG, MatcherConfig()).awaitTermination()
    columns = ["query_id", "track_id", "votes", "tempo_scale", "offset_frames", "reference_hits", "rank"]
    streamed = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))
    batch = match_chunks(read_manifests(spark, str(tmp_path / "in"), multiLine="false"), index, "v1", CFG)
    assert streamed == sorted(map(tuple, batch.select(*columns).collect()))
    best = {r[0]: r[1] for r in streamed if r[6] == 1}
    assert [best[f"00000000-0000-4000-8000-{n:012d}"] for n in range(5)] == ["t0", "t1", "t2", "t3", "t0"] and len(best) == 5


def test_receipts_and_detections_once(spark, tmp_path):
    index = setup(spark, tmp_path)
    sources = spark.createDataFrame([("s1", "id-1")], "source_code string, source_id string")
    path = str(tmp_path / "lake")
    for attempt in ("a", "b"):
        stream = read_manifests(spark, str(tmp_path / "in"), stream=True)
        jobs.receive_once(stream, sources, path, "v1", str(tmp_path / attempt), index, CFG).awaitTermination()
        if attempt == "a":
            first = spark.read.parquet(f"{path}/detections").count()
    receipts = spark.read.parquet(f"{path}/receipts")
    # To the second stream every chunk is a replay of the first one's.
    replays = spark.read.parquet(f"{path}/replays")
    assert replays.count() == 6 and replays.agg(F.sum("candidate_count")).first()[0] == first
    assert receipts.count() == 6 and receipts.select("edge_chunk_id").distinct().count() == 6
    detections = spark.read.parquet(f"{path}/detections")
    assert detections.count() == first > 0 and detections.where(F.col("status") != "candidate").count() == 0
    assert spark.read.parquet(f"{path}/audit").where("action = 'capture.ingested'").count() == 6


def test_smaller_numbers_that_arrive_later(spark, tmp_path):
    """State in force is what the last delivery left, over restarts, whatever the numbers."""
    detections = spark.createDataFrame([("d", "candidate"), ("e", "verified")], "detection_id string, status string")
    disputes = spark.createDataFrame([], "detection_id string, status string")
    schema = "detection_id string, seq bigint, command string, user_id string, role string, value string, note string"
    deliveries = [
        [("d", 50, "decide", "verified"), ("e", 10, "open", "other"), ("none", 1, "open", "other")],
        [("d", 20, "open", "duplicate"), ("d", 10, "decide", "rejected")],  # by number within a delivery
        [("d", 60, "open", "duplicate"), ("d", 5, "resolve", "upheld"), ("e", 5, "resolve", "dismissed")],
        [],
        [("d", 1, "resolve", "upheld")],
    ]
    for rows in deliveries:
        commands = spark.createDataFrame([(d, n, c, "u", "catalog_admin", v, "a note that is long enough") for d, n, c, v in rows], schema)
        commands.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.apply_command_stream(stream, detections, disputes, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("batch", "detection_id", "seq").collect()
    assert [(r.detection_id, r.seq, r.reason, r.status_after) for r in found] == [
        ("d", 50, None, "verified"), ("e", 10, None, "disputed"), ("none", 1, "not_found", None),
        ("d", 10, "state_conflict", "verified"), ("d", 20, None, "disputed"),
        ("d", 5, None, "rejected"), ("d", 60, "state_conflict", "rejected"), ("e", 5, None, "verified"),
        ("d", 1, "no_open_dispute", "rejected"),
    ]
