"""Replays inside one batch: chunks and catalog documents."""

import pytest
from pyspark.sql import functions as F

from spinledger.operators import catalog, ingest

MANIFEST = (
    "edge_chunk_id string, source_code string, arrival bigint, device_id string, started_at timestamp, ended_at timestamp, byte_count bigint, "
    "content_sha256 string, capture_policy string, fingerprint_schema_id string, landmarks array<struct<h:int>>"
)


def delivered(spark, *rows):
    return spark.createDataFrame([(c, s, n, "d", None, None, 1, "a", "p", "v1", []) for c, s, n in rows], MANIFEST)


def run(spark, *rows):
    sources = spark.createDataFrame([("known", "s1"), ("other", "s2")], "source_code string, source_id string")
    receipts = spark.createDataFrame([("old", "r-old", "s9")], "edge_chunk_id string, receipt_id string, source_id string")
    detections = spark.createDataFrame([("r-old",), ("r-old",)], "capture_chunk_id string")
    return ingest.ingest(delivered(spark, *rows), receipts, detections, sources, None, "v1")


def test_a_delivery_from_an_unknown_source_does_not_block_the_next(spark):
    out = run(spark, ("a", "stranger", 1), ("a", "known", 2), ("a", "other", 3), ("a", "stranger", 4), ("b", "stranger", 5), ("old", "stranger", 6))
    assert [(r.edge_chunk_id, r.source_id) for r in out["receipts"].collect()] == [("a", "s1")]
    assert sorted((r.edge_chunk_id, r.arrival) for r in out["unknown_sources"].collect()) == [("a", 1), ("b", 5)]
    replays = {(r.edge_chunk_id, r.arrival): (r.source_id, r.candidate_count) for r in out["replays"].collect()}
    assert replays == {("a", 3): ("s1", 0), ("a", 4): ("s1", 0), ("old", 6): ("s9", 2)}


def test_repeated_documents_are_refused_by_the_acceptance_loop(spark):
    docs = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, doc_seq bigint").withColumn("recordings", F.array())
    with pytest.raises(ValueError, match="unique"):
        catalog.onboarding_conflicts(docs, {})
    with pytest.raises(ValueError, match="unique"):
        catalog.onboarding_conflicts(spark.createDataFrame([("d", 1), ("e", 1)], "doc_id string, doc_seq bigint"), {})


def test_manifests_are_read_once_for_all_results(spark):
    read = spark.sparkContext.accumulator(0)

    def note(chunk):
        read.add(1)
        return chunk

    rows = delivered(spark, ("a", "known", 1), ("a", "other", 2), ("b", "stranger", 3))
    noted = rows.withColumn("edge_chunk_id", F.udf(note, "string")("edge_chunk_id"))
    sources = spark.createDataFrame([("known", "s1"), ("other", "s2")], "source_code string, source_id string")
    receipts = spark.createDataFrame([], "edge_chunk_id string, receipt_id string, source_id string")
    out = ingest.ingest(noted, receipts, spark.createDataFrame([], "capture_chunk_id string"), sources, None, "v1")
    assert [out[name].count() for name in ("receipts", "replays", "unknown_sources", "audit")] == [1, 1, 1, 1]
    assert read.value == 3
