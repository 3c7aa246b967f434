"""Landmark matching against a brute-force loop, and clips end to end."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spinledger.config import FingerprintConfig, MatcherConfig
from spinledger.operators import features, matching
from spinledger.plans.matching import index_clips, match_clips

CFG = FingerprintConfig()
SCALES = MatcherConfig().tempo_scales


def brute_force(query, index, scales, min_votes):
    """Candidates of one query by direct enumeration."""
    by_key = defaultdict(list)
    for track, marks in index.items():
        for i, (anchor, ratio, delta) in enumerate(marks):
            by_key[ratio, delta].append((track, anchor, i))
    voters, reached = defaultdict(set), defaultdict(set)
    for s in scales:
        for qi, (anchor, ratio, delta) in enumerate(query):
            seen = set()
            for dr in (-1, 0, 1):
                for dt in (-1, 0, 1):
                    for track, ref, i in by_key.get((ratio + dr, max(1, round(delta * s)) + dt), ()):
                        key = (track, s, ref - round(anchor * s))
                        if key not in seen:
                            seen.add(key)
                            voters[key].add(qi)
                            reached[key].add(i)
    best = {}
    for key in voters:
        if key[0] not in best or len(voters[key]) > len(voters[best[key[0]]]):
            best[key[0]] = key
    rows = [(t, k[1], k[2], len(voters[k]), len(reached[k])) for t, k in best.items() if len(voters[k]) >= min_votes]
    return sorted(rows, key=lambda r: r[0])


def random_marks(rng, n, frames=120):
    marks = [(rng.randrange(frames), rng.randrange(-4, 5), rng.randrange(1, 9)) for _ in range(n)]
    return sorted(marks)


def frames_of(spark, queries, index):
    q = [(name, "v1", i, a, r, d, len(m)) for name, m in queries.items() for i, (a, r, d) in enumerate(m)]
    t = [("v1", name, i, a, r, d, len(m)) for name, m in index.items() for i, (a, r, d) in enumerate(m)]
    return (
        spark.createDataFrame(q, "query_id string, schema_id string, query_index int, anchor_frame int, ratio_bin int, delta_frames int, query_hashes int"),
        spark.createDataFrame(t, "schema_id string, track_id string, hash_index int, anchor_frame int, ratio_bin int, delta_frames int, track_hashes int"),
    )


@pytest.mark.parametrize("rows_per_cell", [1_000_000, 7])
def test_votes_equal_brute_force(spark, rows_per_cell):
    rng = random.Random(5)
    index = {f"t{i}": random_marks(rng, 60) for i in range(4)}
    queries = {f"q{i}": random_marks(rng, 40) for i in range(5)}
    queries["same"] = index["t2"][10:50]
    landmarks, table = frames_of(spark, queries, index)
    hits = matching.landmark_hits(landmarks, table, CFG, SCALES, rows_per_cell=rows_per_cell)
    matched = matching.match(landmarks, table, CFG, MatcherConfig(min_votes=4, limit=9), rows_per_cell=rows_per_cell)
    for found in (matching.best_alignment(matching.vote(hits)).where("votes >= 4").collect(), matched.collect()):
        for name, marks in queries.items():
            mine = sorted((r.track_id, r.tempo_scale, r.offset_frames, r.votes, r.reference_hits) for r in found if r.query_id == name)
            assert mine == brute_force(marks, index, SCALES, 4), name


def test_a_key_hot_on_both_sides(spark):
    """Every second landmark has one key: its probes and its index rows are dealt over a grid, and each two meet once."""
    rng = random.Random(6)
    marks = lambda n: sorted((i, 0 if i % 2 else rng.randrange(-9, 10), 5 if i % 2 else rng.randrange(1, 20)) for i in range(n))
    queries, index = {f"q{i}": marks(40) for i in range(6)}, {f"t{i}": marks(60) for i in range(5)}
    landmarks, table = frames_of(spark, queries, index)
    hot = matching.hot_keys(landmarks, table, CFG, SCALES, 50)
    cells = {(r.ratio_bin, r.delta_frames): (r._across, r._down) for r in hot.collect()}
    assert cells[0, 5][0] > 1 and cells[0, 5][1] > 1
    columns = ["query_id", "query_index", "track_id", "hash_index", "tempo_scale", "ratio_step", "time_step", "offset_frames"]
    plain = matching.landmark_hits(landmarks, table, CFG, SCALES).select(*columns)
    dealt = matching.landmark_hits(landmarks, table, CFG, SCALES, hot=hot).select(*columns)
    assert plain.count() == dealt.count() and plain.exceptAll(dealt).count() == 0
    plan = matching.match(landmarks, table, CFG, hot=hot)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reference_anchor") and plan.count("Generate explode(variants") == 1  # one probe join, spelled out once


def test_uncommon_distances_use_the_same_rule(spark):
    index = {"t": [(5, 0, 55), (9, 1, 60)]}
    queries = {"q": [(5, 0, 55), (9, 1, 57)]}
    landmarks, table = frames_of(spark, queries, index)
    hits = matching.landmark_hits(landmarks, table, CFG, SCALES)
    row = matching.best_alignment(matching.vote(hits)).collect()
    assert [(r.track_id, r.tempo_scale, r.offset_frames, r.votes, r.reference_hits) for r in row] == brute_force(queries["q"], index, SCALES, 1)


def test_ranking_limit_and_threshold(spark):
    rng = random.Random(1)
    base = random_marks(rng, 50)
    index = {f"t{i}": base[: 50 - i] for i in range(8)}
    landmarks, table = frames_of(spark, {"q": base}, index)
    rows = matching.match(landmarks, table, CFG, MatcherConfig()).orderBy("rank").collect()
    assert [r.track_id for r in rows] == ["t0", "t1", "t2", "t3", "t4"]
    wanted = {t: (votes, reached) for t, _s, _o, votes, reached in brute_force(base, index, SCALES, 8)}
    for r in rows:
        assert (r.votes, r.reference_hits) == wanted[r.track_id]
        assert r.query_coverage == round(r.votes / 50, 6) and r.track_coverage == round(r.reference_hits / r.track_hashes, 6)
        assert r.confidence_hint == round(min(r.query_coverage, r.track_coverage) * min(1.0, r.votes / 20), 4)
    assert all(r.query_coverage <= 1 and r.track_coverage <= 1 for r in rows)


def test_no_nested_loop_join(spark):
    landmarks, table = frames_of(spark, {"q": [(1, 1, 1)]}, {"t": [(1, 1, 1)]})
    plan = matching.match(landmarks, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def phrase(rate=8000, seconds=18.0):
    """Eight notes of four partials with a falling envelope, repeated."""
    notes = [220.0, 277.2, 329.6, 440.0, 392.0, 523.3, 349.2, 293.7]
    out = []
    for i in range(int(rate * seconds)):
        at = i / rate
        beat = at * 1.6
        freq = notes[int(beat) * 3 % len(notes)]
        level = math.exp(-2.5 * (beat % 1.0))
        out.append(level * sum(math.sin(2 * math.pi * freq * k * at) / k for k in (1, 2, 3, 4)))
    return out


TEST_CFG = FingerprintConfig(
    sample_rate=8000, window_size=512, hop_size=128, min_frequency_hz=70.0, max_frequency_hz=3600.0,
    bin_radius=3, frame_radius=1, max_peaks_per_frame=8, max_delta_frames=30, fanout=6,
)


def test_crop_and_shift_find_their_track(spark):
    whole = phrase()
    catalog = spark.createDataFrame([("song", 8000, whole)], "clip_id string, sample_rate int, samples array<double>")
    index = index_clips(catalog, "v1", TEST_CFG).cache()
    crop = whole[3 * 8000 : 11 * 8000]
    # Read 5 % faster: the capture claims 8 400 Hz for samples taken at 8 000 Hz.
    fast = whole[4 * 8000 : 13 * 8000]
    noisy = [s + 0.05 * math.sin(2 * math.pi * 97 * i / 8000) + 0.025 * math.sin(2 * math.pi * 523 * i / 8000) for i, s in enumerate(whole[6 * 8000 : 12 * 8000])]
    clips = spark.createDataFrame(
        [("crop", 8000, crop), ("fast", 8400, fast), ("noisy", 8000, noisy), ("silent", 8000, [0.0] * 8000)],
        "clip_id string, sample_rate int, samples array<double>",
    )
    top = {r.query_id: r for r in match_clips(clips, index, "v1", TEST_CFG, MatcherConfig(min_votes=5)).where("rank = 1").collect()}
    assert top["crop"].track_id == "song" and top["crop"].votes >= 6 and 0 < top["crop"].query_coverage <= 1
    assert top["fast"].track_id == "song" and 1.025 <= top["fast"].tempo_scale <= 1.075
    assert top["noisy"].track_id == "song" and top["noisy"].track_coverage <= 1 and "silent" not in top
    index.unpersist()


def test_landmark_numbering_is_independent_of_slices(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("c", f, b, float(rng.randrange(5))) for f in range(60) for b in rng.sample(range(10, 50), rng.randrange(4))]
    peaks = spark.createDataFrame(rows, "clip_id string, frame int, bin int, magnitude double")
    cfg = FingerprintConfig(max_peaks_per_frame=4, max_delta_frames=6, fanout=5)
    whole = sorted(map(tuple, features.pair_peaks(peaks, cfg).collect()))
    monkeypatch.setattr(features, "FRAMES_PER_SLICE", 7)
    assert sorted(map(tuple, features.pair_peaks(peaks, cfg).collect())) == whole
    # The same by nested loops.
    expected, n = [], 0
    ordered = sorted(rows, key=lambda r: (r[1], -r[3], r[2]))
    for _, f, b, _m in ordered:
        targets = sorted((t for t in ordered if 1 <= t[1] - f <= 6), key=lambda t: (t[1] - f, -t[3], t[2]))[:5]
        for t in targets:
            expected.append(("c", n, f, round(math.log2((t[2] + 0.5) / (b + 0.5)) * 48), t[1] - f))
            n += 1
    assert whole == sorted(expected)


def test_too_many_peaks_in_a_frame(spark):
    peaks = spark.createDataFrame([("c", 1, b, 1.0) for b in (10, 11, 12)] + [("c", 2, 10, 1.0)], "clip_id string, frame int, bin int, magnitude double")
    assert features.pair_peaks(peaks, FingerprintConfig(max_peaks_per_frame=3)).count() == 3
    with pytest.raises(Exception, match="more than 2 peaks"):
        features.pair_peaks(peaks, FingerprintConfig(max_peaks_per_frame=2)).collect()


def test_enroll_replaces_and_refuses(spark):
    _, table = frames_of(spark, {"q": [(1, 1, 1)]}, {"a": [(1, 1, 1), (2, 2, 2)], "b": [(3, 3, 3)]})
    new = spark.createDataFrame(
        [("v1", "a", 0, 9, 9, 9), ("v2", "b", 0, 9, 9, 9), ("v1", " ", 0, 9, 9, 9)],
        "schema_id string, track_id string, hash_index int, anchor_frame int, ratio_bin int, delta_frames int",
    )
    index, refused = matching.enroll(table, new, "v1")
    assert {(r.track_id, r.anchor_frame, r.track_hashes) for r in index.collect()} == {("a", 9, 1), ("b", 3, 1)}
    assert refused.count() == 2
    assert matching.remove(index, index.where(F.col("track_id") == "a")).count() == 1
