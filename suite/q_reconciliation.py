"""Candidates against station logs, scorecards, slices and the shadow report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.functions.columns import midpoint, seconds_between, title_artist_key
from spinledger.functions.lineage import cut
from spinledger.operators import ops
from spinledger.operators import reconciliation as rec
from spinledger.plans.report import report_summary, shadow_report
from suite.projections import Tables
from suite.registry import query

HOUR = 3600.0


def catalog(t: Tables) -> DataFrame:
    return t.recordings.select("recording_id", "title", "artist", "isrc")


def reconciled(t: Tables) -> DataFrame:
    return rec.reconcile_log(t.candidates, t.station_log, catalog(t), HOUR)


def classified(t: Tables) -> DataFrame:
    return rec.classify_gap(rec.log_gaps(t.station_log, reconciled(t)), catalog(t))


def settled(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reconciled candidates, classified gaps and the rows per source, each computed once."""
    found = cut(reconciled(t))
    gaps = rec.classify_gap(rec.log_gaps(t.station_log, found), catalog(t))
    return found, gaps, rec.reconciliation_rows(t.pilot_sources, found, gaps)


@query("title_artist_key", "select recording_id, tkey as text_key from cat_keys")
def _(t: Tables) -> DataFrame:
    return t.recordings.select("recording_id", title_artist_key("title", "artist").alias("text_key"))


@query("candidate_times", "select detection_id, mid_us, 30.0::double as seconds from candidates")
def _(t: Tables) -> DataFrame:
    return t.candidates.select(
        "detection_id",
        F.unix_micros(midpoint("started_at", "ended_at")).alias("mid_us"),
        seconds_between("started_at", "ended_at").alias("seconds"),
    )


@query(
    "reconcile_log",
    "select detection_id, log_index, case when log_index is null then 'candidate_not_in_log' else 'confirmed_by_log' end as log_reconciliation from reconciled",
)
def _(t: Tables) -> DataFrame:
    return reconciled(t).select("detection_id", "log_index", "log_reconciliation")


@query("log_gaps", "select source_code, log_index from gaps")
def _(t: Tables) -> DataFrame:
    return rec.log_gaps(t.station_log, reconciled(t)).select("source_code", "log_index")


@query("classified_gaps", "select source_code, log_index, cast(is_known as int) as is_known from gaps")
def _(t: Tables) -> DataFrame:
    return classified(t).select("source_code", "log_index", F.col("is_known").cast("int").alias("is_known"))


RECON = """select s.source_code, count(c.detection_id) filter (log_index is not null) as confirmed_by_log, count(c.detection_id) filter (log_index is null) as candidate_not_in_log
 from pilot_sources s left join reconciled c using (source_code) group by 1"""
GAPS = """select s.source_code, count(g.log_index) filter (is_known) as possible_false_negatives, count(g.log_index) filter (not is_known) as local_repertoire_gaps
 from pilot_sources s left join gaps g using (source_code) group by 1"""


@query(
    "reconciliation_rows",
    f"""select *, round(confirmed_by_log / nullif(confirmed_by_log + candidate_not_in_log, 0), 4) as agreement_rate from ({RECON}) join ({GAPS}) using (source_code)""",
)
def _(t: Tables) -> DataFrame:
    return settled(t)[2]


@query(
    "scorecard",
    f"""select *, round(confirmed_by_log / nullif(total_candidates, 0), 4) as log_agreement_rate, verified + rejected as reviewed, round(verified / nullif(verified + rejected, 0), 4) as precision
    from (select s.source_code, count(c.detection_id) as total_candidates, count(*) filter (status = 'verified') as verified, count(*) filter (status = 'rejected') as rejected,
      count(*) filter (status in ('candidate', 'disputed')) as unreviewed, count(log_index) as confirmed_by_log from pilot_sources s left join reconciled c using (source_code) group by 1)
    join ({GAPS}) using (source_code)""".replace("select *, round(confirmed", "select * exclude (confirmed_by_log), round(confirmed", 1),
)
def _(t: Tables) -> DataFrame:
    found, _gaps, rows = settled(t)
    return rec.scorecard(t.pilot_sources, found, rows)


@query(
    "precision_slices",
    """select source_code, dimension, value, count(*) as reviewed, count(*) filter (status = 'verified') as verified, count(*) filter (status = 'rejected') as rejected,
      round(count(*) filter (status = 'verified') / count(*), 4) as precision from (
       select source_code, status, 'confidence_band' as dimension, case when confidence_hint >= 0.6 then 'high' when confidence_hint >= 0.35 then 'medium' else 'low' end as value from candidates
       union all select source_code, status, 'tempo', case when tempo_scale is null then null when abs(tempo_scale - 1.0) < 0.025 then 'unshifted' when tempo_scale > 1 then 'sped_up' else 'slowed_down' end from candidates
       union all select source_code, status, 'region', region from candidates join pilot_sources using (source_code))
    where status in ('verified', 'rejected') and value is not null group by 1, 2, 3""",
)
def _(t: Tables) -> DataFrame:
    regions = t.pilot_sources.select("source_code", "region")
    return rec.precision_slices(t.candidates.join(regions, "source_code"))


@query(
    "review_outcomes",
    """select count(*) filter (detection_id % 4 = 2 or detection_id % 9 = 0) as candidate, count(*) filter (status = 'verified' and detection_id % 9 <> 0) as verified,
     count(*) filter (status = 'rejected' and detection_id % 9 <> 0) as rejected, count(*) filter (status = 'disputed' and detection_id % 9 <> 0) as disputed from candidates""",
)
def _(t: Tables) -> DataFrame:
    odd = F.when(F.col("detection_id") % 9 == 0, "escalated").otherwise(F.col("status"))
    return rec.review_outcomes(t.candidates.withColumn("status", odd))


@query(
    "quality_by_class",
    """select source_type, sum(v)::bigint as verified, sum(r)::bigint as rejected, sum(m)::bigint as missed, round(sum(v) / nullif(sum(v) + sum(r), 0), 4) as precision, round(sum(v) / nullif(sum(v) + sum(m), 0), 4) as recall
    from pilot_sources s left join (select source_code, count(*) filter (status = 'verified') as v, count(*) filter (status = 'rejected') as r from candidates group by 1) using (source_code)
    left join (select source_code, count(*) filter (is_known) as m from gaps group by 1) using (source_code) group by 1""",
)
def _(t: Tables) -> DataFrame:
    return ops.quality_by_class(t.candidates, settled(t)[1], t.pilot_sources)


def report(t: Tables) -> dict[str, DataFrame]:
    """Manifests of all events with one candidate for two thirds of them."""
    chunk = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    events = t.raw("events").select(
        chunk.alias("edge_chunk_id"), "event_id", "user_id", "event_type", "value"
    )
    candidates = events.where("event_type in ('click', 'purchase')").select(
        "edge_chunk_id",
        F.lit(0).alias("rank"),
        (F.col("user_id") % 50).cast("string").alias("recording_id"),
        (F.col("event_id") % 60).cast("int").alias("votes"),
        ((F.col("event_id") % 100) / 100.0).alias("confidence_hint"),
        F.lit(1.0).alias("tempo_scale"),
        F.lit("").alias("title"),
        F.lit(None).cast("string").alias("artist"),
    )
    reviews = events.where("event_id % 3 <> 0").select(
        "edge_chunk_id", F.when(F.col("event_id") % 3 == 1, "verified").otherwise("rejected").alias("status")
    )
    named = t.recordings.select(F.col("recording_id").cast("string").alias("recording_id"), "title", "artist", "isrc")
    logs = t.station_log.withColumn("source_code", F.concat(F.lit("NATION_"), "source_code"))
    return shadow_report(
        t.manifests, candidates, logs, reviews, named, t.sources, period=("2024-01-01", "2024-02-01"), tolerance_seconds=HOUR
    )


# Chunks that pass validation: see the faults planted in ``Tables.manifests``.
CHUNKS = """(select event_id, event_type, user_id % 50 as recording_id, 'NATION_' || (user_id % 30) as source_code, epoch_us(ts) // 1000000 * 1000000 + 15000000 as mid_us
   from events where event_id % 26 > 12)"""
IS_CANDIDATE = "s.agreed and event_type in ('click', 'purchase')"


@query(
    "shadow_report_sources",
    f"""select s.source_code, s.region, count(c.event_id) as chunk_count, count(c.event_id) filter ({IS_CANDIDATE}) as total_candidates,
      count(*) filter ({IS_CANDIDATE} and event_id % 3 = 1) as verified, count(*) filter ({IS_CANDIDATE} and event_id % 3 = 2) as rejected,
      count(c.event_id) filter ({IS_CANDIDATE} and event_id % 3 = 0) as unreviewed
    from sources s left join {CHUNKS} c using (source_code) group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return report(t)["sources"].select(
        "source_code", "region", "chunk_count", "total_candidates", "verified", "rejected", "unreviewed"
    )


@query(
    "shadow_report_reconciliation",
    f"""select s.source_code, count(distinct c.event_id) filter (found) as confirmed_by_log, count(distinct c.event_id) filter (not found) as candidate_not_in_log
    from sources s left join (select c.*, exists (select 1 from log_keys l join cat_keys k on k.recording_id = c.recording_id where 'NATION_' || l.source_code = c.source_code
        and abs(l.aired_us - c.mid_us) <= 3600000000 and (l.recording_id = k.rid or upper(l.isrc) = k.isrc or (l.tkey = k.tkey and l.tkey <> '|'))) as found
      from {CHUNKS} c where event_type in ('click', 'purchase')) c on c.source_code = s.source_code and s.agreed group by 1""",
)
def _(t: Tables) -> DataFrame:
    return report(t)["log_reconciliation"].select("source_code", "confirmed_by_log", "candidate_not_in_log")


@query(
    "shadow_report_warnings",
    f"""select count(*) as warnings from (select event_id from events where event_id % 26 <= 12
     union all select event_id from {CHUNKS} c where source_code not in (select source_code from sources where agreed))""",
)
def _(t: Tables) -> DataFrame:
    return report(t)["warnings"].agg(F.count(F.lit(1)).alias("warnings"))


@query(
    "shadow_report_summary",
    f"""select 25 as source_count, (select count(*) from {CHUNKS} where source_code in (select source_code from sources)) as chunks,
     (select count(*) from {CHUNKS} where event_type in ('click', 'purchase') and source_code in (select source_code from sources where agreed)) as candidates""",
)
def _(t: Tables) -> DataFrame:
    return report_summary(report(t)).select(F.col("source_count").cast("int").alias("source_count"), "chunks", "candidates")


@query(
    "both_way_gaps",
    f"""select source_code, 'chunk_without_candidate' as gap, count(*) as rows from {CHUNKS} where event_type not in ('click', 'purchase') group by 1
    union all select 'NATION_' || source_code, 'log_without_candidate', count(*) from gaps group by 1""",
)
def _(t: Tables) -> DataFrame:
    chunk = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    events = t.raw("events").withColumn("edge_chunk_id", chunk).withColumn(
        "source_code", F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string"))
    )
    chunks = events.where("event_id % 26 > 12")
    found = events.where("event_type in ('click', 'purchase')").select("edge_chunk_id")
    missing = rec.log_gaps(t.station_log, reconciled(t)).withColumn("source_code", F.concat(F.lit("NATION_"), "source_code"))
    return rec.both_way_gaps(chunks, found, missing)
