"""Signal features over many clips: frames, spectra, peaks, landmarks, novelty.

Spectra stay one row per frame with an array of magnitudes; a row per bin would
multiply the shuffles by the number of bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinledger.config import FingerprintConfig, SegmenterConfig
from spinledger.functions.columns import half_even, let
from spinledger.functions.lineage import cut
from spinledger.functions.quantiles import exact_medians
from spinledger.functions.skew import salted_lookup
from spinledger.functions.slices import CORE, SLICE, scan_slices, slice_of, with_halo

EPSILON = 1e-12
FRAMES_PER_SLICE = 4_096


def resample(clips: DataFrame, rate: int) -> DataFrame:
    """Linear interpolation of ``samples`` to ``rate``."""
    own = F.col("sample_rate")

    def changed(samples: Column) -> Column:
        last = F.size(samples) - 1
        count = F.greatest(F.lit(1), half_even(F.size(samples) * F.lit(float(rate)) / own))

        def at(i: Column) -> Column:
            place = i * (own / F.lit(float(rate)))
            left = F.least(F.floor(place).cast("int"), last)
            part = place - left
            return F.get(samples, left) * (1.0 - part) + F.get(samples, F.least(left + 1, last)) * part

        return F.transform(F.sequence(F.lit(0), count - 1), at)

    keep = (own == rate) | (F.size("samples") == 0)
    return clips.withColumn(
        "samples", F.when(keep, F.col("samples")).otherwise(let(F.col("samples"), changed))
    ).withColumn("sample_rate", F.lit(rate))


def normalize_level(clips: DataFrame) -> DataFrame:
    """Remove the mean and scale to a peak of 1; silent clips become empty."""
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    mean = total / F.nullif(F.size("samples"), F.lit(0))
    centred = let(mean, lambda m: F.transform("samples", lambda x: x - m))

    def scaled(samples: Column) -> Column:
        top = F.array_max(F.transform(samples, F.abs))
        loud = let(top, lambda t: F.transform(samples, lambda x: x / t))
        return F.when(F.coalesce(top, F.lit(0.0)) < 1e-8, F.slice(samples, 1, 0)).otherwise(loud)

    return clips.withColumn("samples", let(centred, scaled))


def frames(clips: DataFrame, window: int, hop: int, pad_end: bool = True) -> DataFrame:
    """Overlapping frames; ``valid`` is the sample count before zero padding."""
    n = F.size("samples")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(hop)))
    rows = clips.select("clip_id", "sample_rate", "samples", F.posexplode(starts).alias("frame", "start"))
    rows = rows.withColumn("frame_samples", F.slice("samples", F.col("start") + 1, window))
    rows = rows.withColumn("valid", F.size("frame_samples"))
    if not pad_end:
        rows = rows.where(F.col("valid") == window)
    padded = F.concat("frame_samples", F.array_repeat(F.lit(0.0), F.lit(window) - F.col("valid")))
    return rows.select("clip_id", "sample_rate", "frame", "valid", padded.alias("samples"))


def spectrogram(framed: DataFrame) -> DataFrame:
    """Magnitudes of the real FFT of each Hann-windowed frame, one Arrow batch at a time."""

    def magnitudes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in np.array_split(np.arange(len(batch)), max(1, len(batch) // 512)):
                if not len(part):
                    continue
                piece = batch.iloc[part]
                block = np.stack(piece["samples"].to_numpy())
                size = block.shape[1]
                hann = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(size) / (size - 1))
                yield pd.DataFrame(
                    {
                        "clip_id": piece["clip_id"].to_numpy(),
                        "frame": piece["frame"].to_numpy(),
                        "magnitudes": list(np.abs(np.fft.rfft(block * hann, axis=1))),
                    }
                )

    clip_type = framed.schema["clip_id"].dataType.simpleString()
    return framed.select("clip_id", "frame", "samples").mapInPandas(
        magnitudes, f"clip_id {clip_type}, frame int, magnitudes array<double>"
    )


def find_peaks(spectra: DataFrame, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """Prominent bins: loud enough, a maximum among near bins and nearly one among near frames."""
    low, high, r = cfg.first_bin, cfg.last_bin, cfg.bin_radius
    banded = spectra.withColumn(
        "_frame_max", F.array_max(F.slice("magnitudes", low + 1, high - low + 1))
    )
    loudest = banded.groupBy("clip_id").agg(F.max("_frame_max").alias("_clip_max"))
    haloed = with_halo(banded, "frame", FRAMES_PER_SLICE, cfg.frame_radius, cfg.frame_radius)
    near = (
        Window.partitionBy("clip_id", SLICE)
        .orderBy("frame")
        .rangeBetween(-cfg.frame_radius, cfg.frame_radius)
    )
    stacked = haloed.withColumn("_near", F.collect_list("magnitudes").over(near)).where(CORE)
    levelled = salted_lookup(stacked, loudest, ["clip_id"], spread_by=["frame"], how="inner").where(
        F.col("_clip_max") > 0
    )
    threshold = F.greatest(
        F.col("_clip_max") * F.lit(10 ** (cfg.clip_floor_db / 20.0)),
        F.col("_frame_max") * F.lit(10 ** (cfg.frame_floor_db / 20.0)),
    )

    def is_peak(b: Column) -> Column:
        m = F.get("magnitudes", b)
        in_time = F.array_max(F.transform("_near", lambda other: F.get(other, b)))
        return (
            (m >= F.col("_threshold"))
            & (m >= F.array_max(F.slice("magnitudes", b - (r - 1), 2 * r + 1)))
            & (m + F.lit(1e-12) >= in_time * F.lit(0.985))
        )

    if low + r > high - r:
        bins = F.array().cast("array<int>")
    else:
        bins = F.sequence(F.lit(low + r), F.lit(high - r))
    ranked = F.slice(
        F.array_sort(
            F.transform(
                F.filter(bins, is_peak),
                lambda b: F.struct((-F.get("magnitudes", b)).alias("quiet"), b.alias("bin")),
            )
        ),
        1,
        cfg.max_peaks_per_frame,
    )
    return (
        levelled.withColumn("_threshold", threshold)
        .select("clip_id", "frame", F.explode(ranked).alias("p"))
        .select("clip_id", "frame", F.col("p.bin").alias("bin"), (-F.col("p.quiet")).alias("magnitude"))
    )


def pair_peaks(peaks: DataFrame, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """Landmarks: each peak with its first ``fanout`` targets, numbered per clip.

    Sorted by frame, loudness and bin, the targets are simply the rows that follow,
    so one ordered pass replaces an interval self-join. A frame may hold at most
    ``max_peaks_per_frame`` peaks, as ``find_peaks`` guarantees; more end the job.
    """
    ordered = peaks.withColumn("_quiet", -F.col("magnitude"))
    order = ["frame", "_quiet", "bin"]
    reach = cfg.max_peaks_per_frame * cfg.min_delta_frames - 1 + cfg.fanout
    haloed = with_halo(ordered, "frame", FRAMES_PER_SLICE, 0, cfg.max_delta_frames)
    ahead = Window.partitionBy("clip_id", SLICE).orderBy(*order).rowsBetween(1, reach)
    most = cfg.max_peaks_per_frame
    crowded = F.lead("frame", most).over(Window.partitionBy("clip_id", SLICE).orderBy(*order)) == F.col("frame")
    anchors = haloed.withColumn("_ahead", F.collect_list(F.struct("frame", "bin")).over(ahead)).withColumn("_crowded", crowded).where(CORE)
    distance_ok = lambda t: (t.frame - F.col("frame")).between(cfg.min_delta_frames, cfg.max_delta_frames)
    anchors = anchors.select(
        "clip_id", *order, "_crowded", F.slice(F.filter("_ahead", distance_ok), 1, cfg.fanout).alias("targets")
    ).withColumn("_n", F.when(F.col("_crowded"), F.raise_error(F.lit(f"a frame holds more than {most} peaks"))).otherwise(F.size("targets")))
    numbered = scan_slices(
        anchors, ["clip_id"], order, slice_of("frame", FRAMES_PER_SLICE), sum_through={"_through": "_n"}
    )
    octaves = F.log2((F.col("t.bin") + F.lit(0.5)) / (F.col("bin") + F.lit(0.5)))
    return numbered.select(
        "clip_id", "frame", "bin", "_through", "_n", F.posexplode("targets").alias("_pos", "t")
    ).select(
        "clip_id",
        (F.col("_through") - F.col("_n") + F.col("_pos")).cast("int").alias("hash_index"),
        F.col("frame").cast("int").alias("anchor_frame"),
        half_even(F.lit(float(cfg.ratio_quantization)) * octaves).alias("ratio_bin"),
        (F.col("t.frame") - F.col("frame")).cast("int").alias("delta_frames"),
    )


def pair_listed_peaks(clips: DataFrame, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """:func:`pair_peaks` of clips that hold all their peaks in one row, in the array ``peaks``.

    Targets are looked up inside the row, so nothing is shuffled, and rows stay dealt as
    they were. ``hashes`` is the clip's number of landmarks. A clip must fit a row;
    :func:`pair_peaks` takes longer ones.
    """
    most = cfg.max_peaks_per_frame
    reach = most * cfg.min_delta_frames - 1 + cfg.fanout
    ordered = F.sort_array(
        F.transform("peaks", lambda p: F.struct(p["frame"].alias("frame"), (-p["magnitude"]).alias("quiet"), p["bin"].alias("bin")))
    )
    too_many = F.raise_error(F.lit(f"a frame holds more than {most} peaks"))

    def landmarks(p: Column, i: Column) -> Column:
        distance = lambda t: t["frame"] - p["frame"]
        # Element by element: a slice would copy the whole array for every anchor.
        ahead = F.array(*[F.get("_peaks", i + n) for n in range(1, reach + 1)])
        near = F.filter(ahead, lambda t: distance(t).between(cfg.min_delta_frames, cfg.max_delta_frames))
        octaves = lambda t: F.log2((t["bin"] + F.lit(0.5)) / (p["bin"] + F.lit(0.5)))
        found = F.transform(
            F.slice(near, 1, cfg.fanout),
            lambda t: F.struct(
                p["frame"].cast("int").alias("anchor_frame"),
                half_even(F.lit(float(cfg.ratio_quantization)) * octaves(t)).alias("ratio_bin"),
                distance(t).cast("int").alias("delta_frames"),
            ),
        )
        return F.when(F.get("_peaks", i + most)["frame"] == p["frame"], too_many).otherwise(found)

    listed = clips.select("clip_id", ordered.alias("_peaks")).withColumn("_marks", F.flatten(F.transform("_peaks", landmarks)))
    # Counted before they are spelled out, else every landmark's row would carry the whole array. The outer
    # explode keeps Spark from deriving a filter on the array's size, which would build it twice and lambda by lambda.
    counted = listed.select("clip_id", F.size("_marks").cast("bigint").alias("hashes"), "_marks")
    return counted.select("clip_id", "hashes", F.posexplode_outer("_marks").alias("hash_index", "m")).where("m is not null").select(
        "clip_id", "hash_index", "m.anchor_frame", "m.ratio_bin", "m.delta_frames", "hashes"
    )


def pair_ordered_peaks(
    clip: np.ndarray, frame: np.ndarray, bins: np.ndarray, cfg: FingerprintConfig = FingerprintConfig()
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`pair_peaks` of arrays, for use inside tasks: each landmark's anchor, ratio bin and frame distance.

    Peaks stand in order of clip and frame, the loudest of a frame first, then the lowest bin.
    """
    most = cfg.max_peaks_per_frame
    if np.any((clip[most:] == clip[:-most]) & (frame[most:] == frame[:-most])):
        raise ValueError(f"a frame holds more than {most} peaks")
    near = np.zeros((len(clip), most * cfg.min_delta_frames - 1 + cfg.fanout), dtype=bool)
    for n in range(1, min(near.shape[1], len(clip) - 1) + 1):
        distance = frame[n:] - frame[:-n]
        near[:-n, n - 1] = (clip[n:] == clip[:-n]) & (distance >= cfg.min_delta_frames) & (distance <= cfg.max_delta_frames)
    if near.shape[1] > cfg.fanout:
        near &= np.cumsum(near, axis=1) <= cfg.fanout
    anchor, ahead = np.nonzero(near)
    target = anchor + ahead + 1
    octaves = np.log2((bins[target] + 0.5) / (bins[anchor] + 0.5))
    return anchor, np.rint(cfg.ratio_quantization * octaves).astype(np.int32), (frame[target] - frame[anchor]).astype(np.int32)


def fingerprint_summary(clips: DataFrame, peaks: DataFrame, landmarks: DataFrame, schema_id: str) -> DataFrame:
    """Peak and landmark counts and the duration per clip; empty clips included."""
    n_peaks = peaks.groupBy("clip_id").agg(F.count(F.lit(1)).alias("peaks"))
    n_landmarks = landmarks.groupBy("clip_id").agg(F.count(F.lit(1)).alias("landmarks"))
    duration = (F.size("samples") / F.col("sample_rate")).alias("duration_seconds")
    return (
        clips.select("clip_id", duration)
        .join(n_peaks, "clip_id", "left")
        .join(n_landmarks, "clip_id", "left")
        .na.fill(0, ["peaks", "landmarks"])
        .withColumn("schema_id", F.lit(schema_id))
    )


def fingerprint(clips: DataFrame, cfg: FingerprintConfig = FingerprintConfig()) -> tuple[DataFrame, DataFrame]:
    """(peaks, landmarks) of every clip."""
    level = normalize_level(resample(clips, cfg.sample_rate))
    spectra = spectrogram(frames(level, cfg.window_size, cfg.hop_size))
    peaks = find_peaks(spectra, cfg)
    return peaks, pair_peaks(peaks, cfg)


def spectral_features(spectra: DataFrame, bin_hz: float) -> DataFrame:
    """Centroid and positive flux per frame of ``clip_id, frame, magnitudes``."""
    haloed = with_halo(spectra, "frame", FRAMES_PER_SLICE, 1, 0)
    w = Window.partitionBy("clip_id", SLICE).orderBy("frame")
    rows = haloed.withColumn("_before", F.lag("magnitudes").over(w)).where(CORE)

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    weighted = total(F.transform("magnitudes", lambda m, i: i * F.lit(bin_hz) * m))
    rise = total(F.zip_with("magnitudes", "_before", lambda c, p: F.greatest(F.lit(0.0), c - p)))
    return rows.select(
        "clip_id",
        "frame",
        (weighted / (total(F.col("magnitudes")) + F.lit(EPSILON))).alias("spectral_centroid_hz"),
        F.when(F.col("_before").isNull(), F.lit(0.0))
        .otherwise(rise / (total(F.col("_before")) + F.lit(EPSILON)))
        .alias("spectral_flux"),
    )


def frame_features(clips: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Level, centroid and flux per frame of raw clips."""
    framed = frames(resample(clips, cfg.sample_rate), cfg.window_size, cfg.hop_size)
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x)
    levels = framed.select(
        "clip_id",
        "frame",
        (20.0 * F.log10(F.greatest(F.sqrt(energy / F.col("valid")), F.lit(EPSILON)))).alias("rms_db"),
    )
    shape = spectral_features(spectrogram(framed), cfg.sample_rate / cfg.window_size)
    return levels.join(shape, ["clip_id", "frame"]).select(
        F.col("clip_id").alias("session_id"),
        "frame",
        (F.col("frame") * F.lit(float(cfg.hop_size)) / F.lit(float(cfg.sample_rate))).alias("at_seconds"),
        "rms_db",
        "spectral_centroid_hz",
        "spectral_flux",
    )


def feature_deltas(features: DataFrame) -> DataFrame:
    """Flux, level change and centroid change against the previous frame."""
    lagged = scan_slices(
        features,
        ["session_id"],
        ["frame"],
        slice_of("frame", FRAMES_PER_SLICE),
        previous={"_prev": ["rms_db", "spectral_centroid_hz"]},
    )
    level = F.abs(F.col("rms_db") - F.col("_prev.rms_db"))
    centroid = F.abs(
        F.log((F.col("spectral_centroid_hz") + 1.0) / (F.col("_prev.spectral_centroid_hz") + 1.0))
    )
    return lagged.select(
        "session_id",
        "frame",
        "at_seconds",
        F.col("spectral_flux").alias("flux"),
        F.coalesce(level, F.lit(0.0)).alias("level_change"),
        F.coalesce(centroid, F.lit(0.0)).alias("centroid_change"),
    )


def median_and_mad(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median and unscaled median absolute deviation per key."""
    centre = exact_medians(rows, keys, value, "median")
    spread_by = [c for c in rows.columns if c not in keys][:2]
    away = salted_lookup(rows, centre, keys, spread_by=spread_by, how="inner").select(
        *keys, F.abs(F.col(value) - F.col("median")).alias("_away")
    )
    return centre.join(exact_medians(away, keys, "_away", "mad"), keys)


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    return (value - median) / F.greatest(mad * F.lit(1.4826), F.lit(1e-6))


def novelty(deltas: DataFrame) -> DataFrame:
    """Weighted positive robust z-scores of the three changes; needs three frames."""
    measures = ["flux", "level_change", "centroid_change"]
    tall = deltas.select(
        "session_id",
        "frame",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in measures])
        ).alias("m"),
    ).select("session_id", F.col("m.measure").alias("measure"), "frame", F.col("m.x").alias("x"))
    stats = median_and_mad(tall, ["session_id", "measure"], "x")
    per_session = stats.groupBy("session_id").agg(
        *[
            F.max(F.when(F.col("measure") == m, F.struct("median", "mad"))).alias(f"_{m}")
            for m in measures
        ]
    )
    sizes = deltas.groupBy("session_id").agg(F.count(F.lit(1)).alias("_frames"))
    joined = salted_lookup(
        deltas, per_session.join(sizes, "session_id"), ["session_id"], spread_by=["frame"], how="inner"
    ).where(F.col("_frames") >= 3)
    z = {
        m: F.greatest(F.lit(0.0), robust_z(F.col(m), F.col(f"_{m}.median"), F.col(f"_{m}.mad")))
        for m in measures
    }
    score = z["flux"] + 0.4 * z["level_change"] + 0.25 * z["centroid_change"]
    return joined.select("session_id", "frame", "at_seconds", score.alias("novelty"))


def moving_average(rows: DataFrame, value: str, radius: int, name: str) -> DataFrame:
    """Centred mean over ``radius`` frames each side, clipped at the ends."""
    haloed = with_halo(rows, "frame", FRAMES_PER_SLICE, radius, radius)
    near = Window.partitionBy("session_id", SLICE).orderBy("frame").rangeBetween(-radius, radius)
    return haloed.withColumn(name, F.avg(value).over(near)).where(CORE).drop(CORE, SLICE)


def local_maxima(scores: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Frames above the session's threshold that are maximal within half the boundary gap.

    Scores are sums of doubles, so equal ones may differ in their last digits: a frame
    within 1e-9 of the largest score counts as maximal.
    """
    radius = max(1, round(cfg.boundary_gap_seconds / cfg.frame_seconds / 2.0))
    stats = median_and_mad(scores.select("session_id", "frame", "score"), ["session_id"], "score")
    limits = stats.select(
        "session_id",
        (F.col("median") + F.lit(cfg.mad_multiplier) * F.greatest("mad", F.lit(0.05))).alias("_limit"),
    )
    haloed = with_halo(scores, "frame", max(FRAMES_PER_SLICE, radius), radius, radius)
    near = Window.partitionBy("session_id", SLICE).orderBy("frame").rangeBetween(-radius, radius)
    tops = haloed.withColumn("_top", F.max("score").over(near)).where(
        F.col(CORE) & (F.col("score") >= F.col("_top") - F.lit(1e-9))
    )
    return (
        salted_lookup(tops, limits, ["session_id"], spread_by=["frame"], how="inner")
        .where(F.col("score") >= F.col("_limit"))
        .select("session_id", "frame", "at_seconds", "score")
    )


def suppress_close(peaks: DataFrame, gap: float, width: float = 3_600.0) -> DataFrame:
    """Keep peaks at least ``gap`` after the last one kept, walking in time order.

    A peak at least ``gap`` after its neighbour is always kept, whatever came before,
    so the session falls into independent runs at such places; only a run's times are
    folded together.
    """
    runs = scan_slices(
        peaks, ["session_id"], ["at_seconds"], slice_of("at_seconds", width), max_before={"_prev": "at_seconds"}
    ).withColumn(
        "_start",
        F.when(
            F.col("_prev").isNull() | (F.col("at_seconds") - F.col("_prev") >= gap), F.col("at_seconds")
        ),
    )
    runs = scan_slices(
        runs, ["session_id"], ["at_seconds"], slice_of("at_seconds", width), max_through={"_run": "_start"}
    )
    ordered = F.array_sort(F.collect_list(F.struct("at_seconds", "score")))
    kept = F.aggregate(
        "_items",
        F.slice("_items", 1, 0),
        lambda acc, p: F.when(
            (F.size(acc) == 0)
            | (p.at_seconds - F.get(acc, F.size(acc) - 1).at_seconds >= gap),
            F.concat(acc, F.array(p)),
        ).otherwise(acc),
    )
    return (
        runs.groupBy("session_id", "_run")
        .agg(ordered.alias("_items"))
        .select("session_id", F.explode(kept).alias("p"))
        .select("session_id", "p.at_seconds", "p.score")
    )


def acoustic_boundaries(features: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Novelty peaks that mark likely transitions."""
    # Each stage is read several times by the next, so it is settled once.
    deltas = cut(feature_deltas(features))
    scores = cut(moving_average(novelty(deltas), "novelty", cfg.smoothing_radius, "score"))
    kept = suppress_close(cut(local_maxima(scores, cfg)), cfg.boundary_gap_seconds)
    return kept.select(
        "session_id",
        "at_seconds",
        F.round("score", 5).alias("novelty_score"),
        F.array(F.lit("acoustic_novelty")).alias("reasons"),
    )


def window_quality(clips: DataFrame, silence: float = 1e-3, clipping: float = 0.999) -> DataFrame:
    """Silence and clipping ratios and a level-to-floor hint in decibels."""
    n = F.size("samples")
    size = F.transform("samples", F.abs)
    quiet = F.size(F.filter(size, lambda x: x < silence))
    loud = F.size(F.filter(size, lambda x: x >= clipping))
    rms = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x) / n)
    floor = F.get(F.array_sort(size), F.floor(n * 0.1).cast("int"))
    hint = 20.0 * F.log10(F.greatest(rms, F.lit(EPSILON)) / F.greatest(floor, F.lit(EPSILON)))
    return clips.where(n > 0).select(
        "clip_id",
        F.round(quiet / n, 6).alias("silence_ratio"),
        F.round(loud / n, 6).alias("clipping_ratio"),
        F.round(hint, 3).alias("snr_hint_db"),
    )


def route_quality(quality: DataFrame, max_silence: float = 0.9, max_clipping: float = 0.05) -> DataFrame:
    bad = (F.col("silence_ratio") > max_silence) | (F.col("clipping_ratio") > max_clipping)
    return quality.withColumn("route", F.when(bad, "quarantined").otherwise("ready"))
