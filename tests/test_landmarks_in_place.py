"""Landmarks inside a clip's row, and queries that meet a small index where they are."""

import random

import pytest
from pyspark.sql import functions as F

from spinledger.config import FingerprintConfig
from spinledger.operators import features, matching
from suite.projections import Tables


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_listed_peaks_give_the_same_landmarks(spark):
    rng = random.Random(5)
    rows = [(c, f, b, float(rng.randrange(5))) for c in "ab" for f in range(40) for b in rng.sample(range(10, 50), rng.randrange(4))]
    peaks = spark.createDataFrame(rows, "clip_id string, frame int, bin int, magnitude double")
    listed = peaks.groupBy("clip_id").agg(F.collect_list(F.struct("frame", "bin", "magnitude")).alias("peaks"))
    listed = listed.unionByName(spark.createDataFrame([("empty", [])], listed.schema))
    cfg = FingerprintConfig(max_peaks_per_frame=4, max_delta_frames=6, fanout=5)
    found = features.pair_listed_peaks(listed, cfg)
    assert sorted(map(tuple, found.drop("hashes").collect())) == sorted(map(tuple, features.pair_peaks(peaks, cfg).collect()))
    assert {(r.clip_id, r.hashes) for r in found.collect()} == {(r.clip_id, r["count"]) for r in found.groupBy("clip_id").count().collect()}
    with pytest.raises(Exception, match="more than 2 peaks"):
        features.pair_listed_peaks(listed, FingerprintConfig(max_peaks_per_frame=2)).collect()


def test_landmarks_of_texts_need_no_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "a song a dance of the night")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert _shuffles(Tables(spark, str(tmp_path)).document_landmarks) == 0


def test_a_small_index_gives_the_same_hits_and_votes_without_shuffling_hits(spark, monkeypatch):
    rng = random.Random(7)
    marks = lambda ids, n: [("v1", i, k, rng.randrange(60), rng.randrange(-3, 3), rng.choice([0, 1, 2, 3, 9, 40, 60]), n) for i in ids for k in range(n)]
    queries = spark.createDataFrame(marks("pqr", 30), "schema_id string, query_id string, query_index int, anchor_frame int, ratio_bin int, delta_frames int, query_hashes long")
    index = spark.createDataFrame(marks("xy", 40), "schema_id string, track_id string, hash_index int, anchor_frame int, ratio_bin int, delta_frames int, track_hashes long")
    dealt = queries.repartition(3, "query_id")
    hits = matching.landmark_hits(dealt, index)
    votes = matching.vote(hits, dealt=True)
    assert _shuffles(votes.select("query_id")) <= 1 + _shuffles(hits)  # at most the distances' distinct and the dealing
    here = [sorted(map(str, d.collect())) for d in (hits.select(sorted(hits.columns)), votes.select(sorted(votes.columns)))]
    best = sorted(map(str, matching.match(dealt, index, dealt=True).collect()))
    monkeypatch.setattr(matching, "INDEX_ROWS", 0)
    hits = matching.landmark_hits(queries, index)
    votes = matching.vote(hits)
    assert here == [sorted(map(str, d.collect())) for d in (hits.select(sorted(hits.columns)), votes.select(sorted(votes.columns)))]
    assert best == sorted(map(str, matching.match(queries, index).collect()))
    assert here[0]
