"""Play events, boundaries and features on small tables, and slices against whole sessions."""

import random

import pytest
from pyspark.sql import functions as F

from spinledger.config import SegmenterConfig
from spinledger.functions.quantiles import exact_medians
from spinledger.functions.slices import scan_slices, slice_of
from spinledger.operators import features
from spinledger.operators import segmentation as seg

WINDOWS = "session_id string, track_id string, started_at_seconds double, ended_at_seconds double, confidence double"


def test_two_overlapping_events(spark):
    windows = spark.createDataFrame(
        [
            ("s", "a", 0.0, 16.0, 0.90), ("s", "a", 15.0, 31.0, 0.86),
            ("s", "b", 27.0, 43.0, 0.82), ("s", "b", 42.0, 60.0, 0.88),
            ("s", "weak", 5.0, 40.0, 0.15), ("s", "short", 50.0, 55.0, 0.9),
        ],
        WINDOWS,
    )
    sessions = spark.createDataFrame([("s", 60.0)], "session_id string, duration_seconds double")
    acoustic = spark.createDataFrame(
        [("s", 28.0, 4.0, ["acoustic_novelty"])], "session_id string, at_seconds double, novelty_score double, reasons array<string>"
    )
    events, merged = seg.segment(sessions, windows, acoustic)
    rows = {r.track_id: r for r in events.collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].started_at_seconds, rows["a"].ended_at_seconds, rows["a"].evidence_windows) == (0.0, 31.0, 2)
    assert (rows["b"].started_at_seconds, rows["b"].ended_at_seconds) == (27.0, 60.0)
    assert rows["a"].matched_seconds == 31.0
    boundary = merged.collect()
    assert len(boundary) == 1 and boundary[0].at_seconds == 27.0 and boundary[0].novelty_score == 4.0
    assert boundary[0].reasons == ["acoustic_novelty", "fingerprint_identity_change"]
    assert rows["a"].nearby_boundary_seconds == [27.0]
    assert seg.overlap_pairs(events).count() == 2
    assert seg.unknown_intervals(sessions, events).count() == 0


@pytest.mark.parametrize("width", [1e9, 30.0, 7.0])
def test_slices_do_not_change_clusters(spark, monkeypatch, width):
    monkeypatch.setattr(seg, "SLICE_SECONDS", width)
    rng = random.Random(11)
    rows = [("s", rng.choice("ab"), float(s), float(s + rng.randrange(1, 40)), 0.5) for s in sorted(rng.choices(range(600), k=60))]
    expected = []
    for track in "ab":
        cluster = []
        for start, end in sorted((r[2], r[3]) for r in rows if r[1] == track):
            if cluster and start - max(e for _, e in cluster) > 12:
                expected.append((track, cluster))
                cluster = []
            cluster.append((start, end))
        expected.append((track, cluster))

    def cover(cluster):
        return len({i for s, e in cluster for i in range(int(s), int(e))})

    wanted = sorted((t, min(s for s, _ in c), max(e for _, e in c), float(cover(c)), len(c)) for t, c in expected)
    windows = spark.createDataFrame(rows, WINDOWS)
    found = seg.cluster_event(seg.sessionize_windows(windows, 12.0, width)).collect()
    got = sorted((r.track_id, r.started_at_seconds, r.ended_at_seconds, r.matched_seconds, r.evidence_windows) for r in found)
    assert got == wanted


@pytest.mark.parametrize("width", [1000.0, 5.0, 1.0])
def test_scan_slices_equals_a_plain_scan(spark, width):
    rng = random.Random(2)
    rows = [("k", i, rng.randrange(100)) for i in sorted(rng.sample(range(200), 50))]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    out = scan_slices(
        df, ["k"], ["at"], slice_of("at", width), max_before={"mb": "v"}, max_through={"mt": "v"}, sum_through={"st": "v"},
        previous={"p": ["v"]}, following={"f": ["v"]},
    ).orderBy("at").collect()
    values = [r[2] for r in rows]
    for i, r in enumerate(out):
        assert r.mb == (max(values[:i]) if i else None)
        assert r.mt == max(values[: i + 1]) and r.st == sum(values[: i + 1])
        assert (r.p.v if r.p else None) == (values[i - 1] if i else None)
        assert (r.f.v if r.f else None) == (values[i + 1] if i + 1 < len(values) else None)


def test_exact_medians(spark):
    rng = random.Random(4)
    groups = {k: [rng.choice([rng.gauss(0, 3), 0.0, 1.5, -2.25]) for _ in range(n)] for k, n in (("a", 31), ("b", 40), ("c", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    for row in exact_medians(df, ["k"], "v", "m").collect():
        ordered = sorted(groups[row.k])
        n = len(ordered)
        assert row.m == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def test_frames_resample_and_level(spark):
    clips = spark.createDataFrame([("c", 8, [0.0, 1.0, 2.0, 3.0, 4.0])], "clip_id string, sample_rate int, samples array<double>")
    framed = features.frames(clips, 4, 2).orderBy("frame").collect()
    assert [(r.valid, r.samples) for r in framed] == [(4, [0, 1, 2, 3]), (3, [2, 3, 4, 0]), (1, [4, 0, 0, 0])]
    assert features.frames(clips, 4, 2, pad_end=False).count() == 1
    assert features.resample(clips, 16).first().samples == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 4]
    level = features.normalize_level(clips).first().samples
    assert level == [-1.0, -0.5, 0.0, 0.5, 1.0]


def test_steady_sound_has_no_boundary_and_a_change_has_one(spark):
    rows = [("s", f, f * 0.5, -20.0 + (0.1 if f % 2 else 0), 400.0, 0.01 + (5.0 if f == 60 else 0)) for f in range(120)]
    df = spark.createDataFrame(
        rows, "session_id string, frame int, at_seconds double, rms_db double, spectral_centroid_hz double, spectral_flux double"
    )
    cfg = SegmenterConfig(sample_rate=2, hop_size=1)
    found = features.acoustic_boundaries(df, cfg).collect()
    assert len(found) == 1 and abs(found[0].at_seconds - 30.0) <= 1.0
    steady = df.withColumn("spectral_flux", F.lit(0.01)).withColumn("rms_db", F.lit(-20.0))
    assert features.acoustic_boundaries(steady, cfg).count() == 0


def test_frames_whose_equal_scores_differ_in_last_digits_are_both_maximal(spark):
    scores = [0.0, 0.0, 5.0, 0.0, 5.0 + 1e-15, 0.0, 4.9, 0.0, 0.0, 0.0]
    assert scores[2] != scores[4]
    rows = [("s", i, float(i), x) for i, x in enumerate(scores)]
    df = spark.createDataFrame(rows, "session_id string, frame int, at_seconds double, score double")
    cfg = SegmenterConfig(sample_rate=2, hop_size=1)
    assert sorted(r.frame for r in features.local_maxima(df, cfg).collect()) == [2, 4]


def test_suppress_close_walks_in_order(spark):
    times = [0.0, 5.0, 9.0, 12.0, 17.0, 40.0, 46.0, 49.0]
    df = spark.createDataFrame([("s", t, 1.0) for t in times], "session_id string, at_seconds double, score double")
    kept = sorted(r.at_seconds for r in features.suppress_close(df, 8.0, width=10.0).collect())
    assert kept == [0.0, 9.0, 17.0, 40.0, 49.0]


@pytest.mark.parametrize("width", [1e9, 3_600.0, 30.0])
def test_confidence_is_added_in_order_of_time(spark, width):
    """The mean lies on a rounding border, and a sum of the blocks' sums falls on its other side."""
    rows = [(2476.0, 2513.0, 0.66), (2514.0, 2570.0, 0.99), (2530.0, 2557.0, 0.55)]
    weighted = seconds = 0.0
    for start, end, confidence in rows:
        weighted, seconds = weighted + (end - start) * confidence, seconds + (end - start)
    expected = int(weighted / seconds * 10_000 + 0.5) / 10_000
    windows = spark.createDataFrame([("s", "a", *r) for r in reversed(rows)], WINDOWS)
    found = seg.window_clusters(windows, 12.0, width).collect()
    assert [(r.evidence_windows, r.confidence) for r in found] == [(3, expected)]
    assert seg.play_events(windows).first()["confidence"] == expected
