"""The projections of ``projections`` as DuckDB SQL, joined into WITH clauses on demand."""

from __future__ import annotations

import re

# Each text may name other projections; ``with_tables`` adds those too.
TABLES: dict[str, str] = {
    "sources": """
select cast(n_nationkey as bigint) as source_id, n_name as source_code, 'Station ' || n_name as display_name, r_name as region,
       case n_nationkey % 4 when 0 then 'fm_stream' when 1 then 'online_stream' when 2 then 'venue_edge' else 'vehicle_edge' end as source_type,
       n_nationkey % 5 <> 0 as agreed
  from nation join region on n_regionkey = r_regionkey""",
    "pilot_sources": "select * replace (cast(source_id as varchar) as source_code) from sources",
    "recordings": """
select p_partkey as recording_id, p_partkey % 7 as catalog_id, p_name as title, p_brand as artist,
       concat('UGAAA', lpad(cast(p_partkey as varchar), 7, '0')) as isrc, cast(120 + p_size as bigint) as reference_seconds from part""",
    "usage_rows": """
select o_orderkey as usage_id, cast(c_nationkey as bigint) as source_id, r.recording_id, r.catalog_id, cast(o_orderdate as date) as used_on,
       case o_orderstatus when 'F' then 'verified' when 'O' then 'candidate' else 'disputed' end as status,
       10 + o_orderkey % 170 as detected_seconds, r.reference_seconds, 100 + r.recording_id % 50 as base_rate_ugx
  from orders join customer on o_custkey = c_custkey
  join (select l_orderkey, min(l_partkey) as pk from lineitem group by l_orderkey) l on l_orderkey = o_orderkey
  join recordings r on r.recording_id = l.pk""",
    "split_lines": """
select recording_id as split_sheet_id, recording_id * 10 + line_no as split_line_id, line_no, (recording_id * 3 + line_no) % 10 as party_id,
       'role' || line_no as role,
       case line_no when 1 then 1000 + recording_id % 5000
            when 2 then cast(floor((9000 - recording_id % 5000) / 2) as bigint)
            else 9000 - recording_id % 5000 - cast(floor((9000 - recording_id % 5000) / 2) as bigint)
                 - case when recording_id % 97 = 0 then 1 else 0 end end as share_basis_points
  from recordings cross join (select unnest([1, 2, 3]) as line_no)""",
    "recording_works": """
select recording_id, recording_id % 500 as work_id, true as is_primary_work from recordings
union all select recording_id, (recording_id + 250) % 500, false from recordings where recording_id % 10 = 0""",
    "sheets": """
select recording_id as split_sheet_id, case when recording_id % 23 = 0 then (recording_id + 1) % 7 else catalog_id end as catalog_id,
       recording_id, cast(null as bigint) as work_id, 'master' as right_type, 1 as version,
       case when recording_id % 11 = 0 then 'draft' else 'active' end as status,
       make_date(1994 + recording_id % 5, 1, 1) as valid_from,
       case when recording_id % 13 = 0 then date '2000-06-30' end as valid_to,
       case when recording_id % 17 <> 0 then 'doc-' || recording_id end as source_document_key from recordings
union all
select work_id + 1000000, work_id % 7, null, work_id, 'composition', 1, case when work_id % 6 = 0 then 'retired' else 'active' end,
       make_date(1995 + work_id % 3, 7, 1), null, null from (select distinct work_id from recording_works)""",
    "weights": """
select cast(n_nationkey * 10 + y.yr - 1994 as bigint) as weight_id, cast(n_nationkey as bigint) as source_id, make_date(y.yr, 1, 1) as valid_from,
       case when y.yr = 2001 then null else make_date(y.yr, 12, 31) end as valid_to,
       cast(50 + ((n_nationkey + y.yr) % 4) * 25 as bigint) as weight_pct
  from nation cross join (select unnest(range(1994, 2002)) as yr) y""",
    "tariffs": """
select cast(n_nationkey as bigint) as tariff_id, cast(n_nationkey % 7 as bigint) as catalog_id, 'master' as right_type,
       case when n_nationkey % 3 <> 0 then case n_nationkey % 4 when 0 then 'fm_stream' when 1 then 'online_stream' when 2 then 'venue_edge' else 'vehicle_edge' end end as source_type,
       cast(100 + n_nationkey as bigint) as base_rate_ugx, make_date(1994 + n_nationkey % 5, 1, 1) as valid_from,
       case when n_nationkey % 2 = 1 then date '1999-12-31' end as valid_to from nation""",
    "windows": """
select event_id, user_id % 5 as session_id, event_type as track_id, cast(event_id * 2 as double) as s,
       cast(event_id * 2 + 20 + event_id % 37 as double) as e, (event_id * 7 % 100) / 100.0::double as confidence from events""",
    "sessions": """
select user_id % 5 as session_id, cast(max(event_id) * 2 - 100 as double) as duration_seconds from events group by 1""",
    "valid_w": """
select event_id, session_id, track_id, least(greatest(s, 0.0), duration_seconds) as s, least(greatest(e, 0.0), duration_seconds) as e, confidence
  from windows join sessions using (session_id) where confidence >= 0.35
   and least(greatest(e, 0.0), duration_seconds) > least(greatest(s, 0.0), duration_seconds)""",
    "reached": """
select *, max(e) over (partition by session_id, track_id order by s, e, event_id rows between unbounded preceding and 1 preceding) as reach from valid_w""",
    "clustered": """
select *, sum(case when reach is null or s - reach > 12 then 1 else 0 end) over (partition by session_id, track_id order by s, e, event_id) as cluster from reached""",
    "all_clusters": """
select session_id, track_id, cluster, round(min(s), 4) as started_at_seconds, round(max(e), 4) as ended_at_seconds,
       round(sum(greatest(0, e - greatest(s, coalesce(reach, s)))), 4) as matched_seconds, count(*) as evidence_windows,
       round(least(1.0, sum((e - s) * confidence) / greatest(sum(e - s), 1e-12)), 4) as confidence
  from clustered group by session_id, track_id, cluster""",
    "play_events": "select * from all_clusters where ended_at_seconds - started_at_seconds >= 15",
    "nexts": """
select *, lead(track_id) over w as n_track, lead(started_at_seconds) over w as n_start, lead(confidence) over w as n_conf
  from play_events window w as (partition by session_id order by started_at_seconds, ended_at_seconds, track_id)""",
    "identity_b": """
select session_id, round(case when n_start <= ended_at_seconds then n_start else (ended_at_seconds + n_start) / 2.0 end, 4) as at_seconds,
       round((confidence + n_conf) / 2.0, 5) as novelty_score from nexts where n_track is not null and n_track <> track_id""",
    "chain0": """
select *, lag(at_seconds) over (partition by session_id order by at_seconds, novelty_score) as p from identity_b""",
    "chain1": """
select *, sum(case when p is null or at_seconds - p > 5 then 1 else 0 end) over (partition by session_id order by at_seconds, novelty_score rows unbounded preceding) as chain from chain0""",
    "merged_b": """
select session_id, arg_max(at_seconds, (novelty_score, -at_seconds)) as at_seconds, max(novelty_score) as novelty_score from chain1 group by session_id, chain""",
    "candidates": """
select event_id as detection_id, cast(user_id % 25 as varchar) as source_code, user_id % 50 as recording_id, ts as started_at,
       ts + interval 30 second as ended_at, epoch_us(ts) + 15000000 as mid_us, event_id % 60 as votes, (event_id % 100) / 100.0::double as confidence_hint,
       case event_id % 5 when 1 then 0.9::double when 2 then 1.0::double when 3 then 1.05::double when 4 then 1.0::double end as tempo_scale,
       case event_id % 4 when 0 then 'verified' when 1 then 'rejected' when 2 then 'candidate' else 'disputed' end as status
  from events where event_type in ('click', 'purchase', 'signup')""",
    "station_log": """
select cast(user_id % 25 as varchar) as source_code, event_id as log_index, epoch_us(ts) as aired_us,
       case when event_id % 11 = 0 then 'Unlisted!' when event_id % 3 = 2 then upper(r.title) else '' end as title,
       case when event_id % 3 = 2 and event_id % 11 <> 0 then r.artist end as artist,
       case when event_id % 3 = 0 and event_id % 11 <> 0 then cast(user_id % 50 as varchar) end as recording_id,
       case when event_id % 3 = 1 and event_id % 11 <> 0 then lower(r.isrc) end as isrc,
       event_id % 7 <> 0 as known_catalog
  from events left join recordings r on r.recording_id = user_id % 50 where event_type in ('view', 'error')""",
    "cat_keys": """
select cast(recording_id as varchar) as rid, recording_id, upper(isrc) as isrc,
       trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')) as tkey from recordings""",
    "log_keys": """
select *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || coalesce(trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')), '') as tkey from station_log""",
    "reconciled": """
select c.*, min(l.log_index) as log_index
  from candidates c left join cat_keys k on k.recording_id = c.recording_id
  left join log_keys l on l.source_code = c.source_code and abs(l.aired_us - c.mid_us) <= 3600000000
   and (l.recording_id = cast(c.recording_id as varchar) or upper(l.isrc) = k.isrc or (l.tkey = k.tkey and l.tkey <> '|'))
 group by all""",
    "gaps": """
select l.*, l.known_catalog and (l.recording_id in (select rid from cat_keys) or coalesce(upper(l.isrc) in (select isrc from cat_keys), false)
       or l.tkey in (select tkey from cat_keys)) is true as is_known
  from log_keys l where not exists (select 1 from reconciled r where r.source_code = l.source_code and r.log_index = l.log_index)""",
    "doc_tokens": """
select doc_id as clip_id, 'd' as kind, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) - 1 as frame from documents
union all
select item_id, 'b', unnest(string_split(text, ' ')), generate_subscripts(string_split(text, ' '), 1) - 1 from benchmark""",
    "peaks": """
select kind, clip_id, frame, 1 + (cast(ascii(substr(w, 1, 1)) as bigint) * 7919 + cast(ascii(substr(w, 2, 1)) as bigint) * 104729
       + cast(ascii(substr(w, 3, 1)) as bigint) * 1299709 + cast(ascii(substr(w, length(w), 1)) as bigint) * 15485863 + length(w) * 31) % 65521 as bin
  from doc_tokens""",
    "paired": """
select a.kind, a.clip_id, a.frame as anchor_frame, cast(round_even(4096 * log2((b.bin + 0.5) / (a.bin + 0.5)), 0) as int) as ratio_bin, b.frame - a.frame as delta_frames,
       row_number() over (partition by a.kind, a.clip_id, a.frame order by b.frame, b.bin) as nth
  from peaks a join peaks b on a.kind = b.kind and a.clip_id = b.clip_id and b.frame between a.frame + 1 and a.frame + 4
qualify nth <= 2""",
    "marks": """
select *, row_number() over (partition by kind, clip_id order by anchor_frame, nth) - 1 as hash_index,
       count(*) over (partition by kind, clip_id) as hashes from paired""",
    "steps": """
select delta_frames, s, td, greatest(1, cast(round_even(delta_frames * s, 0) as int)) + td as key
  from (select distinct delta_frames from marks), (select unnest([0.90, 0.925, 0.95, 0.975, 1.0, 1.025, 1.05, 1.075, 1.10]::double[]) as s), (select unnest([-1, 0, 1]) as td)""",
    "hits": """
select q.clip_id as query_id, t.clip_id as track_id, s as tempo_scale, t.anchor_frame - cast(round_even(q.anchor_frame * s, 0) as int) as offset_frames,
       q.hash_index as query_index, rd as ratio_step, td as time_step, t.hash_index, q.hashes as query_hashes, t.hashes as track_hashes
  from (select m.*, st.s, st.td, st.delta_frames as q_delta, rd, m.ratio_bin - rd as q_ratio from (select * from marks where kind = 'b') m
         join steps st on st.key = m.delta_frames, (select unnest([-1, 0, 1]) as rd)) t
  join (select * from marks where kind = 'd') q on q.ratio_bin = t.q_ratio and q.delta_frames = t.q_delta""",
    "first_hits": """
select query_id, track_id, tempo_scale, offset_frames, query_index, query_hashes, track_hashes, min((ratio_step, time_step, hash_index)) as h from hits group by all""",
    "votes": """
select query_id, track_id, tempo_scale, offset_frames, query_hashes, track_hashes, count(*) as votes, count(distinct h[3]) as reference_hits,
       min((query_index, h[1], h[2], h[3])) as first_seen from first_hits group by query_id, track_id, tempo_scale, offset_frames, query_hashes, track_hashes""",
    "best": """
select * from votes qualify row_number() over (partition by query_id, track_id order by votes desc, tempo_scale, first_seen, offset_frames) = 1""",
    "covered": """
select *, round(votes / query_hashes, 6) as query_coverage, round(reference_hits / track_hashes, 6) as track_coverage, round(offset_frames * 1.0 / 10.0, 6) as offset_seconds from best""",
    "ranked": """
select *, row_number() over (partition by query_id order by votes desc, query_coverage desc, track_coverage desc, track_id) as rank,
       round(least(query_coverage, track_coverage) * least(1.0, votes / 20.0), 4) as confidence_hint from covered where votes >= 8 qualify rank <= 5""",
    "spectrum": """
select vec_id % 10 as clip_id, vec_id // 10 as frame, generate_subscripts(embedding, 1) - 1 as bin, abs(unnest(embedding)::double) as m from embeddings""",
    "features": """
select event_id % 4 as session_id, event_id // 4 as frame, (event_id // 4) * 0.5::double as at_seconds, cast(user_id % 40 - 60 as double) as rms_db,
       cast(user_id * 10 + 100 as double) as centroid, value as flux from events""",
    "deltas": """
select session_id, frame, at_seconds, flux, coalesce(abs(rms_db - lag(rms_db) over w), 0.0) as level_change,
       coalesce(abs(ln((centroid + 1.0) / (lag(centroid) over w + 1.0))), 0.0) as centroid_change from features
 window w as (partition by session_id order by frame)""",
    "tall": """
select session_id, frame, 'flux' as measure, flux as x from deltas union all select session_id, frame, 'level_change', level_change from deltas
union all select session_id, frame, 'centroid_change', centroid_change from deltas""",
    "meds": "select session_id, measure, median(x) as med from tall group by 1, 2",
    "mads": "select session_id, measure, any_value(med) as med, median(abs(x - med)) as mad from tall join meds using (session_id, measure) group by 1, 2",
    "novel": """
select d.session_id, frame, at_seconds,
       greatest(0.0, (flux - f.med) / greatest(f.mad * 1.4826, 1e-6)) + 0.4 * greatest(0.0, (level_change - l.med) / greatest(l.mad * 1.4826, 1e-6))
       + 0.25 * greatest(0.0, (centroid_change - c.med) / greatest(c.mad * 1.4826, 1e-6)) as novelty
  from deltas d join mads f on f.session_id = d.session_id and f.measure = 'flux'
  join mads l on l.session_id = d.session_id and l.measure = 'level_change' join mads c on c.session_id = d.session_id and c.measure = 'centroid_change'""",
    "scores": """
select session_id, frame, at_seconds, avg(novelty) over (partition by session_id order by frame rows between 2 preceding and 2 following) as score from novel""",
    "smed": "select session_id, median(score) as med from scores group by 1",
    "slimit": "select session_id, any_value(med) + 3.0 * greatest(median(abs(score - med)), 0.05) as lim from scores join smed using (session_id) group by 1",
    "tops": """
select * from (select *, max(score) over (partition by session_id order by frame rows between 8 preceding and 8 following) as top from scores)
  join slimit using (session_id) where score >= lim and score >= top - 1e-9""",
    "detections": """
select distinct user_id as detection_id, case user_id % 5 when 3 then 'verified' when 4 then 'disputed' else 'candidate' end as status from events""",
    "commands": """
select user_id as detection_id, event_id as seq, case when event_type in ('view', 'click') then 'decide' when event_type = 'purchase' then 'open' else 'resolve' end as command,
       'u' || (event_id % 9) as user_id, case event_id % 5 when 0 then 'viewer' when 1 then 'reviewer' when 2 then 'finance_reviewer' else 'catalog_admin' end as role,
       case event_type when 'view' then 'verified' when 'click' then 'rejected' when 'signup' then 'dismissed' when 'error' then 'upheld'
            else case when event_id % 10 = 9 then 'boredom' else 'duplicate' end end as value, 5 + event_id % 40 as note_length from events""",
    "outbox": """
select event_id as chunk_id, user_id % 25 as source_id, case event_type when 'view' then 'pending' when 'click' then 'retry' when 'purchase' then 'uploading' else 'uploaded' end as status,
       event_id % 20 as attempts, event_id * 11 % 5000 as byte_count, ts as created_at, ts + to_hours(cast(event_id % 24 as int)) as next_attempt_at,
       case when event_id % 6 = 0 then (event_id % 600)::double end as retry_after_seconds, event_id % 1500 as error_length from events""",
}


def spark_round(sql: str) -> str:
    """Round doubles as Spark does: half up on the shortest decimal text of the value."""
    out, at = [], 0
    for found in re.finditer(r"\bround\(", sql):
        if found.start() < at:
            continue
        depth, i = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        value, places = sql[found.end() : i - 1].rsplit(",", 1)
        out.append(sql[at : found.start()])
        out.append(f"cast(round(cast(cast({spark_round(value)} as varchar) as decimal(38, 20)),{places}) as double)")
        at = i
    return "".join(out) + sql[at:]


def with_tables(query: str) -> str:
    """``query`` preceded by the WITH clauses of every projection it uses."""
    needed: list[str] = []

    def visit_body(name: str) -> None:
        inner = TABLES[name]
        for other in TABLES:
            if other != name and other not in needed and re.search(rf"\b(from|join)\s+{other}\b", inner):
                visit_body(other)
        if name not in needed:
            needed.append(name)

    for name in TABLES:
        if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", query):
            visit_body(name)
    clauses = ",\n".join(f"{name} as ({TABLES[name].strip()})" for name in needed)
    return spark_round(f"with {clauses}\n{query.strip()}" if clauses else query.strip())
