"""Match windows to play events, boundaries, overlaps and unknown intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.operators import segmentation as seg
from suite.projections import Tables
from suite.registry import query

EVENT = ["session_id", "track_id", "started_at_seconds", "ended_at_seconds", "matched_seconds", "evidence_windows", "confidence"]


def valid(t: Tables) -> DataFrame:
    return seg.valid_windows(t.windows, t.sessions)


def events(t: Tables) -> DataFrame:
    return seg.play_events(valid(t))


@query("valid_windows", "select event_id, s, e, confidence from valid_w")
def _(t: Tables) -> DataFrame:
    return valid(t).select("event_id", F.col("started_at_seconds").alias("s"), F.col("ended_at_seconds").alias("e"), "confidence")


@query(
    "checked_windows",
    """select event_id, concat_ws('; ', case when event_id % 5 = 0 then 'track_id is required' end,
     case when e <= s + event_id % 40 then 'match windows require a positive, forward time range' end,
     case when confidence * 1.1 > 1 then 'match confidence must be in [0, 1]' end) as errors from windows""",
)
def _(t: Tables) -> DataFrame:
    broken = t.windows.withColumns(
        {
            "track_id": F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("track_id")),
            "ended_at_seconds": F.col("ended_at_seconds") - F.col("event_id") % 40,
            "confidence": F.col("confidence") * 1.1,
        }
    )
    return seg.check_windows(broken).select("event_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "window_clusters",
    f"select {', '.join(EVENT)} from all_clusters",
)
def _(t: Tables) -> DataFrame:
    return seg.window_clusters(valid(t)).select(*EVENT)


@query(
    "covered_seconds",
    "select session_id, track_id, round(sum(greatest(0, e - greatest(s, coalesce(reach, s)))), 4) as covered_seconds from reached group by 1, 2",
)
def _(t: Tables) -> DataFrame:
    return seg.interval_union_seconds(seg.sessionize_windows(valid(t)))


@query("play_events", f"select {', '.join(EVENT)} from play_events")
def _(t: Tables) -> DataFrame:
    return events(t).select(*EVENT)


@query("identity_transitions", "select session_id, at_seconds, novelty_score from identity_b")
def _(t: Tables) -> DataFrame:
    return seg.transitions(events(t)).select("session_id", "at_seconds", "novelty_score")


@query("merged_boundaries", "select session_id, round(at_seconds, 4) as at_seconds, round(novelty_score, 5) as novelty_score, 'fingerprint_identity_change' as reasons from merged_b")
def _(t: Tables) -> DataFrame:
    _events, merged = seg.segment(t.sessions, t.windows)
    return merged.select("session_id", "at_seconds", "novelty_score", F.array_join("reasons", ",").alias("reasons"))


@query(
    "segmented_events",
    """select p.session_id, p.track_id, p.started_at_seconds, p.ended_at_seconds, count(b.at_seconds) as boundaries, coalesce(sum(round(b.at_seconds, 4)), 0.0) as boundary_sum
    from play_events p left join merged_b b on b.session_id = p.session_id and b.at_seconds between p.started_at_seconds - 5 and p.ended_at_seconds + 5 group by 1, 2, 3, 4""",
)
def _(t: Tables) -> DataFrame:
    found, _merged = seg.segment(t.sessions, t.windows)
    near = F.col("nearby_boundary_seconds")
    return found.select(
        "session_id", "track_id", "started_at_seconds", "ended_at_seconds", F.size(near).cast("bigint").alias("boundaries"),
        F.aggregate(near, F.lit(0.0), lambda a, x: a + x).alias("boundary_sum"),
    )


@query(
    "unknown_intervals",
    """select session_id, s, e from (
      select session_id, coalesce(max(ended_at_seconds) over (partition by session_id order by started_at_seconds, ended_at_seconds, track_id rows between unbounded preceding and 1 preceding), 0.0) as s,
        started_at_seconds as e from play_events
      union all select session_id, coalesce((select max(ended_at_seconds) from play_events p where p.session_id = sessions.session_id), 0.0), duration_seconds from sessions) where e > s""",
)
def _(t: Tables) -> DataFrame:
    found = seg.unknown_intervals(t.sessions, events(t))
    return found.select("session_id", F.col("started_at_seconds").alias("s"), F.col("ended_at_seconds").alias("e"))


@query(
    "overlapping_events",
    """select a.session_id, a.track_id, a.started_at_seconds, count(b.track_id) as overlaps from play_events a left join play_events b on a.session_id = b.session_id and a.track_id <> b.track_id
     and a.started_at_seconds < b.ended_at_seconds and b.started_at_seconds < a.ended_at_seconds group by 1, 2, 3""",
)
def _(t: Tables) -> DataFrame:
    found = seg.overlapping_events(events(t))
    return found.select("session_id", "track_id", "started_at_seconds", F.size("overlaps_event_ids").cast("bigint").alias("overlaps"))


def acoustic(t: Tables) -> DataFrame:
    """An acoustic boundary for every event."""
    e = F.col("event_id")
    return t.raw("events").select(
        (F.col("user_id") % 5).alias("session_id"), (e * 2 + (e % 37) / 2).alias("at_seconds"), (e * 13 % 100 / 100).alias("novelty_score"),
        F.array(F.lit("acoustic_novelty")).alias("reasons"),
    )


BOTH_KINDS = """
all_b as (select session_id, at_seconds, novelty_score, 1 as ident from identity_b
  union all select user_id % 5, event_id * 2 + (event_id % 37) / 2.0::double, (event_id * 13 % 100) / 100.0::double, 0 from events),
steps_b as (select *, lag(at_seconds) over (partition by session_id order by at_seconds) as p from all_b),
chains_b as (select *, sum(case when p is null or at_seconds - p > 5 then 1 else 0 end) over (partition by session_id order by at_seconds rows unbounded preceding) as chain from steps_b),
both_b as (select session_id, round(arg_max(at_seconds, (ident, novelty_score, -at_seconds)), 4) as at_seconds, round(max(novelty_score), 5) as novelty_score,
   case when min(ident) = 0 then 'acoustic_novelty' || case when max(ident) = 1 then ',fingerprint_identity_change' else '' end else 'fingerprint_identity_change' end as reasons
  from chains_b group by session_id, chain)"""


@query("boundaries_of_both_kinds", f"select * from (with {BOTH_KINDS.strip()} select * from both_b)")
def _(t: Tables) -> DataFrame:
    _events, merged = seg.segment(t.sessions, t.windows, acoustic(t))
    return merged.select("session_id", "at_seconds", "novelty_score", F.array_join("reasons", ",").alias("reasons"))


@query(
    "segmented_with_acoustic",
    f"""select * from (with {BOTH_KINDS.strip()} select p.session_id, p.track_id, p.started_at_seconds, p.ended_at_seconds,
      coalesce(string_agg(cast(cast(round(b.at_seconds * 10000, 0) as bigint) as varchar), ',' order by b.at_seconds), '') as nearby
    from play_events p left join both_b b on b.session_id = p.session_id and b.at_seconds between p.started_at_seconds - 5 and p.ended_at_seconds + 5 group by 1, 2, 3, 4)""",
)
def _(t: Tables) -> DataFrame:
    found, _merged = seg.segment(t.sessions, t.windows, acoustic(t))
    times = F.transform("nearby_boundary_seconds", lambda x: F.round(x * 10000).cast("bigint").cast("string"))
    return found.select("session_id", "track_id", "started_at_seconds", "ended_at_seconds", F.array_join(times, ",").alias("nearby"))
