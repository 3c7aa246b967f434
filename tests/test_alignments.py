"""Counting in place against counting rows of hits, and in pieces against all at once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spinledger.config import FingerprintConfig, MatcherConfig
from spinledger.operators import alignments, features, matching
from suite import projections
from test_matching import CFG, SCALES, frames_of, random_marks


def tables(seed=8):
    rng = random.Random(seed)
    index = {f"t{i}": random_marks(rng, 60) for i in range(5)}
    queries = {f"q{i}": random_marks(rng, 40) for i in range(6)}
    queries["same"], queries["far"] = index["t2"][10:50], [(5, 0, 55), (9, 1, 60)]
    index["empty"], index["far"] = [], [(5, 0, 55), (9, 1, 57)]
    return queries, index


def rows_of(frame, columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_counts_equal_rows_of_hits(spark):
    landmarks, index = frames_of(spark, *tables())
    others = landmarks.withColumn("schema_id", F.lit("v2"))
    landmarks = landmarks.unionByName(others.where("query_id = 'q1'").withColumn("query_id", F.lit("v2")))
    index = index.unionByName(index.where("track_id = 't1'").withColumn("schema_id", F.lit("v2")))
    hits = matching.landmark_hits(landmarks, index, CFG, SCALES)
    votes = matching.vote(hits)
    columns = ["query_id", "schema_id", "track_id", "query_hashes", "track_hashes", "tempo_scale", "offset_frames", "votes", "reference_hits"]
    every = matching.alignment_votes(landmarks, index, CFG, SCALES)
    assert rows_of(every, columns) == rows_of(votes, columns)
    assert dict(every.dtypes) == {c: t for c, t in votes.dtypes if c != "first_seen"}
    some = ["votes", "query_id", "offset_frames"]
    assert rows_of(matching.alignment_votes(landmarks, index, CFG, SCALES, columns=some), some) == rows_of(votes, some)
    best = matching.best_alignments(landmarks, index, CFG, SCALES)
    assert rows_of(best, columns) == rows_of(matching.best_alignment(votes), columns)
    by = ["schema_id", "track_id", "tempo_scale", "ratio_step", "time_step"]
    counted = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("query_id").alias("queries"))
    assert rows_of(matching.hit_counts(landmarks, index, CFG, SCALES), [*by, "hits", "queries"]) == rows_of(counted, [*by, "hits", "queries"])


def test_a_larger_index_gives_the_same(spark, monkeypatch):
    landmarks, index = frames_of(spark, *tables(9))
    ask = lambda: [
        rows_of(f, sorted(f.columns))
        for f in (matching.alignment_votes(landmarks, index), matching.best_alignments(landmarks, index), matching.hit_counts(landmarks, index), matching.match(landmarks, index))
    ]
    small = ask()
    monkeypatch.setattr(matching, "INDEX_ROWS", 10)
    assert ask() == small


def test_no_hit_becomes_a_row(spark):
    landmarks, index = frames_of(spark, *tables())
    plan = matching.match(landmarks, index, dealt=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "variants" not in plan and "Join" not in plan


def test_no_index_and_no_queries(spark):
    landmarks, index = frames_of(spark, *tables())
    for count in (matching.alignment_votes, matching.best_alignments, matching.hit_counts, matching.match):
        assert count(landmarks, index.limit(0)).count() == 0
        assert count(landmarks.limit(0), index).count() == 0


@pytest.mark.parametrize("meetings", [1, 50, 1000])
@pytest.mark.parametrize("landmarks", [1, 70])
def test_pieces_do_not_change_counts(monkeypatch, meetings, landmarks):
    queries, index = tables(10)
    q = [(name, "v1", i, a, r, d, len(m)) for name, m in queries.items() for i, (a, r, d) in enumerate(m)]
    t = [("v1", name, i, a, r, d, len(m)) for name, m in index.items() for i, (a, r, d) in enumerate(m)]
    table = lambda rows, names: pa.table([list(c) for c in zip(*rows)], names=names.split())
    asked = table(q, "query_id schema_id query_index anchor_frame ratio_bin delta_frames query_hashes")
    whole = alignments.Index(table(t, "schema_id track_id hash_index anchor_frame ratio_bin delta_frames track_hashes"))

    def counted(kernel, width):
        ways, found = alignments.Ways(FingerprintConfig(), MatcherConfig().tempo_scales), []
        for rows in alignments._whole_queries((pa.Table.from_batches([b]) for b in asked.to_batches(max_chunksize=23))):
            for met in alignments._meetings(alignments.Queries(rows, whole, ways), whole, ways):
                for columns in kernel(met):
                    found += zip(*(c.to_pylist() for c in columns))
        if not width:
            return sorted(found)
        sums = {}
        for row in found:
            sums[row[:width]] = [a + b for a, b in zip(sums.get(row[:width], (0, 0)), row[width:])]
        return sums

    every = [*alignments.OWN, "tempo_scale", "offset_frames", "votes", "reference_hits"]
    kernels = [(alignments._every(every), 0), (alignments._best(1), 0), (alignments._best(4), 0), (alignments._hit_counts, 5)]
    at_once = [counted(*k) for k in kernels]
    monkeypatch.setattr(alignments, "MEETINGS", meetings)
    monkeypatch.setattr(alignments, "LANDMARKS", landmarks)
    assert [counted(*k) for k in kernels] == at_once


def test_landmarks_of_texts_in_a_task(spark, tmp_path):
    """The extractor's landmarks are those of the projection, whatever the texts."""
    texts = ["", " ", "a", "one", "a b", "of the  house ", "é ü 漢字 😀x naïve", None, "word " * 50, "the cat sat on the mat and the dog"] * 3
    rng = random.Random(4)
    texts += [" ".join("".join(rng.choices("abcdé漢", k=rng.randrange(7))) for _ in range(rng.randrange(60))) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    t = projections.Tables(spark, str(tmp_path))
    index = spark.createDataFrame([], "track_id bigint")
    rows, extractor = t.dealt_texts(index)
    made = extractor.landmarks(rows)
    assert made.dtypes == t.document_landmarks.select(*made.columns).dtypes
    assert rows_of(made, made.columns) == rows_of(t.document_landmarks, made.columns)


@pytest.mark.parametrize("cfg", [FingerprintConfig(), FingerprintConfig(max_peaks_per_frame=4, min_delta_frames=2, max_delta_frames=6, fanout=5)])
def test_pairing_in_arrays(spark, cfg):
    rng = random.Random(3)
    rows = [(c, f, b, float(rng.randrange(5))) for c in range(3) for f in range(40) for b in rng.sample(range(10, 50), rng.randrange(4))]
    marks = features.pair_peaks(spark.createDataFrame(rows, "clip_id int, frame int, bin int, magnitude double"), cfg)
    rows.sort(key=lambda r: (r[0], r[1], -r[3], r[2]))
    clip, frame, bins = (np.array([r[i] for r in rows]) for i in range(3))
    anchor, ratio, delta = features.pair_ordered_peaks(clip, frame, bins, cfg)
    wanted = [(r.clip_id, r.anchor_frame, r.ratio_bin, r.delta_frames) for r in marks.orderBy("clip_id", "hash_index").collect()]
    assert list(zip(clip[anchor].tolist(), frame[anchor].tolist(), ratio.tolist(), delta.tolist())) == wanted
    with pytest.raises(ValueError, match="more than 1 peaks"):
        features.pair_ordered_peaks(np.zeros(2, int), np.zeros(2, int), np.arange(2), FingerprintConfig(max_peaks_per_frame=1))
