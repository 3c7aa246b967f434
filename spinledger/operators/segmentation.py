"""Match windows and acoustic boundaries fused into play events.

Windows: ``session_id, track_id, started_at_seconds, ended_at_seconds, confidence``.
Events add ``event_id, matched_seconds, evidence_windows``. Sessions may be years of
one station: every ordered step works on time slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinledger.config import SegmenterConfig
from spinledger.functions.columns import error_list, is_blank, stable_id
from spinledger.functions.lineage import cut
from spinledger.functions.skew import salted_lookup
from spinledger.functions.slices import SLICE, scan_slices, slice_of, spanned_slices

SLICE_SECONDS = 3_600.0
IDENTITY = "fingerprint_identity_change"


def check_windows(windows: DataFrame) -> DataFrame:
    """Windows with the list of what is wrong with each; empty when sound."""
    return windows.withColumn(
        "errors",
        error_list(
            (is_blank("track_id"), "track_id is required"),
            (
                (F.col("started_at_seconds") < 0)
                | (F.col("ended_at_seconds") <= F.col("started_at_seconds")),
                "match windows require a positive, forward time range",
            ),
            (~F.col("confidence").between(0.0, 1.0), "match confidence must be in [0, 1]"),
        ),
    )


def valid_windows(windows: DataFrame, sessions: DataFrame, min_confidence: float = 0.35) -> DataFrame:
    """Drop weak evidence, clip to the session and drop what becomes empty."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col("duration_seconds"))
    strong = windows.where(F.col("confidence") >= min_confidence)
    return (
        salted_lookup(
            strong, sessions, ["session_id"], spread_by=["track_id", "started_at_seconds"], how="inner"
        )
        .withColumn("started_at_seconds", clip("started_at_seconds"))
        .withColumn("ended_at_seconds", clip("ended_at_seconds"))
        .where(F.col("ended_at_seconds") > F.col("started_at_seconds"))
        .drop("duration_seconds")
    )


def contiguous_blocks(windows: DataFrame, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """Windows merged where they touch, within each time slice.

    This pre-aggregation keeps everything events need: bounds, window count and the
    two confidence sums.
    """
    group = ["session_id", "track_id", SLICE]
    order = Window.partitionBy(*group).orderBy("started_at_seconds", "ended_at_seconds")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sliced = windows.withColumn(SLICE, slice_of("started_at_seconds", slice_seconds))
    reach = F.max("ended_at_seconds").over(before)
    starts = F.when(reach.isNull() | (F.col("started_at_seconds") > reach), 1).otherwise(0)
    numbered = sliced.withColumn("_starts", starts).withColumn(
        "_block", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    length = F.col("ended_at_seconds") - F.col("started_at_seconds")
    return numbered.groupBy(*group, "_block").agg(
        F.min("started_at_seconds").alias("start"),
        F.max("ended_at_seconds").alias("end"),
        F.count(F.lit(1)).alias("windows"),
        F.sum(length).alias("evidence_seconds"),
        F.sum(length * F.col("confidence")).alias("weighted"),
    ).drop(SLICE)


def sessionize_windows(
    windows: DataFrame, gap: float = 12.0, slice_seconds: float = SLICE_SECONDS
) -> DataFrame:
    """Blocks with the start of their cluster: a new one begins after a silence above ``gap``."""
    keys, order = ["session_id", "track_id"], ["start", "end", "_block"]
    slices = slice_of("start", slice_seconds)
    reached = scan_slices(
        contiguous_blocks(windows, slice_seconds), keys, order, slices, max_before={"_reach": "end"}
    )
    flagged = reached.withColumn(
        "_opens",
        F.when(F.col("_reach").isNull() | (F.col("start") - F.col("_reach") > gap), F.col("start")),
    )
    return scan_slices(flagged, keys, order, slices, max_through={"cluster_start": "_opens"})


def interval_union_seconds(blocks: DataFrame) -> DataFrame:
    """Seconds covered per session and track, overlaps counted once."""
    new = F.col("end") - F.greatest("start", F.coalesce("_reach", F.col("start")))
    return blocks.groupBy("session_id", "track_id").agg(
        F.round(F.sum(F.greatest(F.lit(0.0), new)), 4).alias("covered_seconds")
    )


def _clusters(blocks: DataFrame) -> DataFrame:
    new = F.col("end") - F.greatest("start", F.coalesce("_reach", F.col("start")))
    return blocks.groupBy("session_id", "track_id", "cluster_start").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum(F.greatest(F.lit(0.0), new)).alias("covered"),
        F.sum("windows").alias("evidence_windows"),
        (F.sum("weighted") / F.greatest(F.sum("evidence_seconds"), F.lit(1e-12))).alias("mean"),
    )


def _confidence(mean: Column) -> Column:
    return F.round(F.least(F.lit(1.0), mean), 4)


def _events_of(clusters: DataFrame) -> DataFrame:
    return clusters.select(
        "session_id",
        "track_id",
        F.round("start", 4).alias("started_at_seconds"),
        F.round("end", 4).alias("ended_at_seconds"),
        F.round("covered", 4).alias("matched_seconds"),
        "evidence_windows",
        _confidence(F.col("mean")).alias("confidence"),
    )


def cluster_event(blocks: DataFrame) -> DataFrame:
    """One row per cluster: bounds, covered seconds, windows, weighted confidence.

    The confidence is a sum of sums; where the last digit hangs on the order of the
    additions, :func:`window_clusters` decides it.
    """
    return _events_of(_clusters(blocks))


def _summed_in_order(windows: DataFrame, clusters: DataFrame, slice_seconds: float) -> DataFrame:
    """``clusters`` with ``_ordered``: their mean confidence, added window by window from the earliest on.

    Running sums go through a cluster row by row, so that a long one takes time, not memory.
    """
    id_ = ["session_id", "track_id", "cluster_start"]
    spans = clusters.select(*id_, "end", F.explode(spanned_slices("start", "end", slice_seconds)).alias(SLICE))
    inside = (
        windows.withColumn(SLICE, slice_of("started_at_seconds", slice_seconds))
        .join(spans.hint("merge"), ["session_id", "track_id", SLICE])
        .where(F.col("started_at_seconds").between(F.col("cluster_start"), F.col("end")))
    )
    order = Window.partitionBy(*id_).orderBy("started_at_seconds", "ended_at_seconds", "confidence")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("ended_at_seconds") - F.col("started_at_seconds")
    sums = inside.select(
        *id_,
        F.sum(length * F.col("confidence")).over(running).alias("_weighted"),
        F.sum(length).over(running).alias("_seconds"),
    )
    # Terms are not negative, so the largest running sum is the last one.
    mean = F.max("_weighted") / F.greatest(F.max("_seconds"), F.lit(1e-12))
    return clusters.join(sums.groupBy(*id_).agg(mean.alias("_ordered")).hint("merge"), id_, "left")


def window_clusters(windows: DataFrame, gap: float = 12.0, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """:func:`cluster_event` of windows, with the confidence that adding them in order of time gives.

    Two orders of adding differ by a known bound; only the few clusters in which it reaches
    over a rounding border are added up again in order.
    """
    blocks = sessionize_windows(windows, gap, slice_seconds)
    bound = (F.col("evidence_windows") * 4 + 8) * F.lit(2.0**-53)
    low, high = (_confidence(F.col("mean") * (1 + sign * bound)) for sign in (-1, 1))
    clusters = cut(_clusters(blocks).withColumn("_open", (F.col("evidence_windows") > 2) & (low != high)))
    settled = _summed_in_order(windows, clusters.where("_open"), slice_seconds)
    mean = F.coalesce("_ordered", "mean")
    both = clusters.where(~F.col("_open")).unionByName(settled.withColumn("mean", mean).drop("_ordered"))
    return _events_of(both)


def play_events(windows: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Clusters long enough to count as a play."""
    events = window_clusters(windows, cfg.max_gap_seconds)
    long_enough = F.col("ended_at_seconds") - F.col("started_at_seconds") >= cfg.min_play_seconds
    return events.where(long_enough).withColumn(
        "event_id", stable_id("session_id", "track_id", "started_at_seconds")
    )


def transitions(events: DataFrame) -> DataFrame:
    """A boundary wherever the next event in the session is another track."""
    following = scan_slices(
        events,
        ["session_id"],
        ["started_at_seconds", "ended_at_seconds", "track_id"],
        slice_of("started_at_seconds", SLICE_SECONDS),
        following={"_next": ["track_id", "started_at_seconds", "confidence"]},
    ).where(F.col("_next").isNotNull() & (F.col("_next.track_id") != F.col("track_id")))
    overlapping = F.col("_next.started_at_seconds") <= F.col("ended_at_seconds")
    middle = (F.col("ended_at_seconds") + F.col("_next.started_at_seconds")) / 2.0
    at = F.when(overlapping, F.col("_next.started_at_seconds")).otherwise(middle)
    return following.select(
        "session_id",
        F.round(at, 4).alias("at_seconds"),
        F.round((F.col("confidence") + F.col("_next.confidence")) / 2.0, 5).alias("novelty_score"),
        F.array(F.lit(IDENTITY)).alias("reasons"),
    )


def all_boundaries(acoustic: DataFrame, identity: DataFrame) -> DataFrame:
    """Both kinds of boundary; acoustic ones come first at equal times."""
    columns = ["session_id", "at_seconds", "novelty_score", "reasons"]
    return (
        acoustic.select(*columns)
        .withColumn("source_order", F.lit(0))
        .unionByName(identity.select(*columns).withColumn("source_order", F.lit(1)))
    )


def merge_boundaries(boundaries: DataFrame, gap: float = 5.0) -> DataFrame:
    """Chains of boundaries at most ``gap`` apart become one.

    The strongest identity change gives the time, else the strongest boundary; equal
    scores go to the earlier one.
    """
    keys, slices = ["session_id"], slice_of("at_seconds", SLICE_SECONDS)
    # Equal rows are interchangeable here, so any order among them is a total order.
    order = ["at_seconds", "source_order", "novelty_score"]
    chained = scan_slices(boundaries, keys, order, slices, max_before={"_prev": "at_seconds"}).withColumn(
        "_opens",
        F.when(F.col("_prev").isNull() | (F.col("at_seconds") - F.col("_prev") > gap), F.col("at_seconds")),
    )
    chained = scan_slices(chained, keys, order, slices, max_through={"_chain": "_opens"})
    identity = F.array_contains("reasons", IDENTITY).cast("int")
    choice = F.struct(identity, "novelty_score", -F.col("at_seconds"), -F.col("source_order"))
    merged = chained.groupBy("session_id", "_chain").agg(
        F.max_by("at_seconds", choice).alias("at"),
        F.max("novelty_score").alias("score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
    )
    return merged.select(
        "session_id",
        F.round("at", 4).alias("at_seconds"),
        F.round("score", 5).alias("novelty_score"),
        "reasons",
    )


def nearby_boundaries(events: DataFrame, boundaries: DataFrame, margin: float = 5.0) -> DataFrame:
    """Events with the sorted times of merged boundaries inside or within ``margin``."""
    low = F.col("started_at_seconds") - F.lit(margin)
    high = F.col("ended_at_seconds") + F.lit(margin)
    points = boundaries.select(
        "session_id", slice_of("at_seconds", SLICE_SECONDS).alias(SLICE), F.col("at_seconds").alias("_at")
    )
    found = (
        events.select("event_id", "session_id", low.alias("_low"), high.alias("_high"))
        .withColumn(SLICE, F.explode(spanned_slices("_low", "_high", SLICE_SECONDS)))
        .join(points, ["session_id", SLICE])
        .where(F.col("_at").between(F.col("_low"), F.col("_high")))
        .groupBy("event_id")
        .agg(F.array_sort(F.collect_list(F.round("_at", 4))).alias("nearby_boundary_seconds"))
    )
    none = F.array().cast("array<double>")
    return events.join(found, "event_id", "left").withColumn(
        "nearby_boundary_seconds", F.coalesce("nearby_boundary_seconds", none)
    )


def unknown_intervals(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Stretches of each session no event covers."""
    order = ["started_at_seconds", "ended_at_seconds", "track_id"]
    reached = scan_slices(
        events,
        ["session_id"],
        order,
        slice_of("started_at_seconds", SLICE_SECONDS),
        max_before={"_reach": "ended_at_seconds"},
    )
    inner = reached.select(
        "session_id",
        F.coalesce("_reach", F.lit(0.0)).alias("started_at_seconds"),
        F.col("started_at_seconds").alias("ended_at_seconds"),
    )
    ends = events.groupBy("session_id").agg(F.max("ended_at_seconds").alias("_end"))
    tail = sessions.join(ends, "session_id", "left").select(
        "session_id",
        F.coalesce("_end", F.lit(0.0)).alias("started_at_seconds"),
        F.col("duration_seconds").cast("double").alias("ended_at_seconds"),
    )
    return inner.unionByName(tail).where(F.col("ended_at_seconds") > F.col("started_at_seconds"))


def overlap_pairs(events: DataFrame) -> DataFrame:
    """(event_id, other_id) for events of different tracks that share time.

    A pair meets in the slice where the later of the two starts, so it appears once
    each way and needs no deduplication.
    """
    e = events.select(
        "session_id", "event_id", "track_id", "started_at_seconds", "ended_at_seconds"
    ).withColumn(
        SLICE, F.explode(spanned_slices("started_at_seconds", "ended_at_seconds", SLICE_SECONDS))
    )
    o = e.select(
        "session_id",
        SLICE,
        *[F.col(c).alias(f"o_{c}") for c in ("event_id", "track_id", "started_at_seconds", "ended_at_seconds")],
    )
    later = F.greatest("started_at_seconds", "o_started_at_seconds")
    return (
        e.join(o, ["session_id", SLICE])
        .where(
            (F.col("track_id") != F.col("o_track_id"))
            & (F.col("started_at_seconds") < F.col("o_ended_at_seconds"))
            & (F.col("o_started_at_seconds") < F.col("ended_at_seconds"))
            & (slice_of(later, SLICE_SECONDS) == F.col(SLICE))
        )
        .select("session_id", "event_id", F.col("o_event_id").alias("other_id"))
    )


def overlapping_events(events: DataFrame) -> DataFrame:
    """Events with the ids of the events they overlap."""
    lists = overlap_pairs(events).groupBy("event_id").agg(
        F.array_sort(F.collect_list("other_id")).alias("overlaps_event_ids")
    )
    none = F.array().cast("array<string>")
    return events.join(lists, "event_id", "left").withColumn(
        "overlaps_event_ids", F.coalesce("overlaps_event_ids", none)
    )


def segment(
    sessions: DataFrame,
    windows: DataFrame,
    acoustic: DataFrame | None = None,
    cfg: SegmenterConfig = SegmenterConfig(),
) -> tuple[DataFrame, DataFrame]:
    """(play events with nearby boundaries, merged boundaries); overlaps are kept."""
    # Events and boundaries are few beside the windows and read several times below.
    events = cut(play_events(valid_windows(windows, sessions, cfg.min_confidence), cfg))
    identity = transitions(events)
    both = identity.withColumn("source_order", F.lit(1)) if acoustic is None else all_boundaries(acoustic, identity)
    merged = cut(merge_boundaries(both, cfg.boundary_merge_seconds))
    return nearby_boundaries(events, merged, cfg.boundary_merge_seconds), merged
