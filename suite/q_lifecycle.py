"""Review commands, evidence views, outboxes, registry and payout reconciliation, access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.operators import access, lifecycle, ops
from suite.projections import Tables
from suite.registry import query

NOW = "2024-01-20T00:00:00"

# The oracle walks each detection's commands with a recursive query.
WALK = """
with recursive judged as (
  select detection_id, seq, row_number() over (partition by detection_id order by seq) as n,
    case command when 'open' then 'open' else value end as action,
    case when command = 'decide' and role not in ('reviewer', 'catalog_admin') then 'forbidden'
         when command = 'resolve' and role not in ('finance_reviewer', 'catalog_admin') then 'forbidden'
         when command = 'open' and value = 'boredom' then 'invalid_value'
         when note_length < case when command = 'open' then 20 else 10 end then 'note_too_short' end as error from commands),
walk as (
  select detection_id, 0::bigint as seq, 0::bigint as n, status, status = 'disputed' as opened, true as accepted, cast(null as varchar) as reason from detections
  union all
  select detection_id, seq, n, case when error is not null or not ok then status else new_status end,
    case when error is not null or not ok then opened else action = 'open' or (opened and action in ('verified', 'rejected')) end, error is null and ok,
    case when error is not null then error when ok then null when action in ('upheld', 'dismissed') then 'no_open_dispute'
         when action = 'open' and opened then 'dispute_already_open' else 'state_conflict' end
   from (select j.detection_id, j.seq, j.n, j.action, j.error, w.status, w.opened,
      case when j.action in ('verified', 'rejected') then w.status = 'candidate' when j.action = 'open' then w.status in ('candidate', 'verified') and not w.opened else w.opened end as ok,
      case j.action when 'open' then 'disputed' when 'upheld' then 'rejected' when 'dismissed' then 'verified' else j.action end as new_status
     from walk w join judged j on j.detection_id = w.detection_id and j.n = w.n + 1))
"""


def outcomes(t: Tables) -> DataFrame:
    return lifecycle.apply_commands(t.detections, t.disputes, t.commands)


@query(
    "apply_commands",
    f"select * from ({WALK} select detection_id, seq, cast(accepted as int) as accepted, reason, status as status_after from walk where n > 0)",
)
def _(t: Tables) -> DataFrame:
    return outcomes(t).select(
        "detection_id", "seq", F.col("accepted").cast("int").alias("accepted"), "reason", "status_after"
    )


@query(
    "latest_status",
    f"select * from ({WALK} select detection_id, arg_max(status, n) as status from walk group by 1)",
)
def _(t: Tables) -> DataFrame:
    return lifecycle.latest_status(t.detections, outcomes(t)).select("detection_id", "status")


@query(
    "status_counts",
    f"select * from (select status, count(*) as detections from ({WALK} select detection_id, arg_max(status, n) as status from walk group by 1) group by 1)",
)
def _(t: Tables) -> DataFrame:
    return lifecycle.status_counts(lifecycle.latest_status(t.detections, outcomes(t)))


@query(
    "command_audit",
    f"""select * from ({WALK} select case when action in ('verified', 'rejected') then 'detection.' || action when action = 'open' then 'dispute.opened' else 'dispute.' || action end as action, count(*) as events
     from walk join judged using (detection_id, seq) where accepted and walk.n > 0 group by 1)""",
)
def _(t: Tables) -> DataFrame:
    audit = lifecycle.command_audit(outcomes(t), t.commands)
    return audit.groupBy("action").agg(F.count(F.lit(1)).alias("events"))


def dispute_rows(t: Tables) -> DataFrame:
    """A dispute per order: every fourth open, the rest resolved after some days."""
    key = F.col("o_orderkey")
    status = F.when(key % 4 == 0, "open").when(key % 4 == 1, "upheld").otherwise("dismissed")
    reason = F.when(key % 3 == 0, "duplicate").when(key % 3 == 1, "wrong_split").otherwise("other")
    opened = F.col("o_orderdate").cast("timestamp")
    return t.raw("orders").select(
        key.alias("dispute_id"),
        key.alias("detection_id"),
        status.alias("status"),
        reason.alias("reason"),
        opened.alias("created_at"),
        F.when(key % 4 != 0, opened + F.expr("interval 6 hours") * (1 + key % 20)).alias("resolved_at"),
    )


DISPUTES = """(select o_orderkey as dispute_id, case o_orderkey % 4 when 0 then 'open' when 1 then 'upheld' else 'dismissed' end as status,
  case o_orderkey % 3 when 0 then 'duplicate' when 1 then 'wrong_split' else 'other' end as reason, o_orderdate as created_at,
  case when o_orderkey % 4 <> 0 then 6 * (1 + o_orderkey % 20) end as hours from orders)"""


@query("time_to_resolve", f"select status, count(*) as disputes, round(avg(hours), 4) as mean_hours from {DISPUTES} group by 1")
def _(t: Tables) -> DataFrame:
    return lifecycle.time_to_resolve(dispute_rows(t))


@query(
    "dispute_metrics",
    f"select reason, count(*) as disputes, count(*) filter (status = 'open') as open, round(avg(hours), 4) as mean_hours, median(hours) as median_hours from {DISPUTES} group by 1",
)
def _(t: Tables) -> DataFrame:
    return ops.dispute_metrics(dispute_rows(t))


@query(
    "active_split_validity",
    """select count(*) as active_sheets, count(*) filter (total = 10000) as valid_sheets, round(count(*) filter (total = 10000) / count(*), 4) as valid_ratio
    from (select s.split_sheet_id, coalesce(sum(share_basis_points), 0) as total from sheets s left join split_lines l using (split_sheet_id) where s.status = 'active' group by 1)""",
)
def _(t: Tables) -> DataFrame:
    return ops.active_split_validity(t.sheets, t.split_lines)


@query(
    "open_disputes",
    f"select dispute_id, reason from {DISPUTES} where status = 'open' order by created_at desc, dispute_id limit 50",
)
def _(t: Tables) -> DataFrame:
    return lifecycle.list_disputes(dispute_rows(t), status="open").select("dispute_id", "reason")


def evidence(t: Tables) -> DataFrame:
    """Detections of all usage with their open dispute."""
    usage = t.usage.join(t.sources.select("source_id", "source_code"), "source_id")
    key = F.col("usage_id")
    start = F.col("used_on").cast("timestamp")
    rows = usage.select(
        key.alias("detection_id"), (key + 7).alias("capture_chunk_id"), "source_id", "source_code", "recording_id",
        start.alias("started_at"), (start + F.expr("interval 30 seconds")).alias("ended_at"),
        (F.col("detected_seconds") / 7).alias("duration_seconds"), F.lit("v1").alias("matcher_version"),
        F.lit("v1").alias("fingerprint_schema_id"), (key % 99).alias("matched_hash_count"),
        ((key % 997) / 997).alias("match_confidence"), F.lit(1.0).alias("tempo_scale"), (key / 9).alias("offset_seconds"),
        "status", F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("timestamp").alias("reviewed_at"),
        F.lit(None).cast("string").alias("review_note"), F.lit("secret").alias("encrypted_object_key"),
    )
    return lifecycle.with_dispute(rows, dispute_rows(t))


@query(
    "evidence_view",
    """select usage_id as id, source_code, round(detected_seconds / 7, 3) as duration_seconds, round((usage_id % 997) / 997, 4) as match_confidence,
      round(usage_id / 9, 3) as offset_seconds, cast(usage_id % 4 = 0 as int) as dispute_open, case when usage_id % 4 = 0 then 'open' end as dispute_status
    from usage_rows join sources using (source_id)""",
)
def _(t: Tables) -> DataFrame:
    return lifecycle.evidence_view(evidence(t)).select(
        "id", F.col("source.code").alias("source_code"), "duration_seconds", F.col("evidence.match_confidence").alias("match_confidence"),
        F.col("evidence.offset_seconds").alias("offset_seconds"), F.col("dispute.open").cast("int").alias("dispute_open"),
        F.col("dispute.status").alias("dispute_status"),
    )


@query(
    "review_queue",
    """select usage_id as detection_id, cast(used_on as varchar) as used_on, (select count(*) from usage_rows where status = 'candidate' and source_id = 3) as total
    from usage_rows where status = 'candidate' and source_id = 3 order by used_on desc, usage_id limit 20 offset 40""",
)
def _(t: Tables) -> DataFrame:
    queue = lifecycle.review_queue(evidence(t), status="candidate", source_code="NATION_3", limit=20, offset=40)
    return queue.select("detection_id", F.to_date("started_at").cast("string").alias("used_on"), "total")


@query(
    "reconciliation_rate",
    """select count(*) as verified, count(*) filter (usage_id % 3 = 0) as on_statement, round(count(*) filter (usage_id % 3 = 0) / count(*), 4) as rate from usage_rows where status = 'verified'""",
)
def _(t: Tables) -> DataFrame:
    detections = t.usage.withColumnRenamed("usage_id", "detection_id")
    lines = detections.where("detection_id % 3 = 0").select("detection_id")
    return ops.reconciliation_rate(detections, lines.union(lines))


@query(
    "outbox_backlog",
    """select source_id, coalesce(sum(byte_count) filter (status <> 'uploaded'), 0)::bigint as queued_bytes, count(*) filter (status in ('pending', 'retry')) as pending_count,
      (epoch_us(timestamp '2024-01-20 00:00:00') - min(epoch_us(created_at)) filter (status <> 'uploaded')) / 1000000.0::double as oldest_age_seconds from outbox group by 1""",
)
def _(t: Tables) -> DataFrame:
    return ops.outbox_backlog(t.outbox, F.lit(NOW).cast("timestamp"))


@query(
    "retry_schedule",
    """select chunk_id, coalesce(nullif(retry_after_seconds, 0), least(21600.0, 30.0 * pow(2, greatest(attempts - 1, 0)))) as delay_seconds, error_length,
     epoch_us(timestamp '2024-01-20 00:00:00') + cast(coalesce(nullif(retry_after_seconds, 0), least(21600.0, 30.0 * pow(2, greatest(attempts - 1, 0)))) * 1000000 as bigint) as next_us from outbox where status = 'uploading'""",
)
def _(t: Tables) -> DataFrame:
    return ops.retry_schedule(t.outbox, F.lit(NOW).cast("timestamp")).select(
        "chunk_id", "delay_seconds", F.length("last_error").cast("bigint").alias("error_length"), F.unix_micros("next_attempt_at").alias("next_us")
    )


@query(
    "due_outbox",
    """select chunk_id, status from outbox where status in ('pending', 'retry') and next_attempt_at <= timestamp '2024-01-20 00:00:00' order by created_at, chunk_id limit 25""",
)
def _(t: Tables) -> DataFrame:
    return ops.due_outbox(t.outbox, F.lit(NOW).cast("timestamp"), 25).select("chunk_id", "status")


@query(
    "registry_reconcile",
    """select recording_id as lookup_id, case when recording_id % 3 = 0 then 'unavailable' when recording_id % 4 = 1 then 'ambiguous' else 'found' end as state,
     case when recording_id % 3 <> 0 then 'ext-' || recording_id end as external_record_id from recordings""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("recording_id")
    lookups = t.recordings.select(
        key.alias("lookup_id"), F.lit("registry-a").alias("provider"), F.lit("isrc").alias("identifier_type"), F.col("isrc").alias("identifier_value")
    )
    answer = lambda state, days: t.recordings.where("recording_id % 3 <> 0").select(
        F.lit("registry-a").alias("provider"), F.lit("isrc").alias("identifier_type"), F.col("isrc").alias("identifier_value"),
        (F.lit("2024-01-01").cast("timestamp") + F.expr(f"interval {days} days")).alias("retrieved_at"), state.alias("state"),
        F.concat(F.lit("ext-"), key.cast("string")).alias("external_record_id"), F.sha2(key.cast("string"), 256).alias("source_payload_sha256"),
        F.lit("ok").alias("message"),
    )
    new = answer(F.when(key % 4 == 1, "ambiguous").otherwise("found"), 5)
    return ops.registry_reconcile(lookups, answer(F.lit("not_found"), 1).unionByName(new)).select("lookup_id", "state", "external_record_id")


@query(
    "payout_reconcile",
    """select o_orderkey as payout_id, case when o_orderkey % 50 = 0 then 'refused' when o_orderkey % 10 = 9 then 'duplicate' when o_orderkey % 3 = 0 then 'unknown' else 'paid' end as state,
     case when o_orderkey % 50 <> 0 and k % 3 <> 0 then 'ref-' || k end as provider_reference, case when k % 3 <> 0 then 1 else 0 end as duplicates
    from (select o_orderkey, case when o_orderkey % 10 = 9 then o_orderkey - 1 else o_orderkey end as k from orders)""".replace(
        "when o_orderkey % 3 = 0 then 'unknown'", "when k % 3 = 0 then 'unknown'"
    ),
)
def _(t: Tables) -> DataFrame:
    """Payout 9 of every ten repeats the key of payout 8; each answered key is answered twice."""
    key = F.col("o_orderkey")
    idem = F.when(key % 10 == 9, key - 1).otherwise(key)
    payouts = t.raw("orders").select(
        key.alias("payout_id"), idem.alias("idempotency_key"), F.when(key % 50 == 0, 0).otherwise(key + 100).alias("amount_ugx")
    )
    answered = t.raw("orders").where(F.col("o_orderkey") % 3 != 0).where("o_orderkey % 10 <> 9")
    events = answered.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        key.alias("idempotency_key"),
        (F.lit("2024-01-01").cast("timestamp") + F.expr("interval 1 hour") * F.col("copy")).alias("received_at"),
        (key * 2 + F.col("copy")).alias("event_id"),
        F.when(F.col("copy") == 0, "paid").otherwise("failed").alias("state"),
        F.concat(F.lit("ref-"), key.cast("string")).alias("provider_reference"),
    )
    return ops.payout_reconcile(payouts, events).select(
        "payout_id", "state", "provider_reference", F.col("duplicates").cast("int").alias("duplicates")
    )


def members(t: Tables) -> DataFrame:
    """User 4 is a member of three of the seven catalogs, with three different roles."""
    role = F.when(F.col("c_custkey") % 3 == 0, "viewer").when(F.col("c_custkey") % 3 == 1, "catalog_editor").otherwise("catalog_admin")
    return t.raw("customer").select(
        (F.col("c_custkey") % 7).alias("catalog_id"), (F.col("c_custkey") / 7).cast("bigint").alias("user_id"), role.alias("member_role")
    )


MEMBERS = """(select c_custkey % 7 as catalog_id, c_custkey // 7 as user_id, case c_custkey % 3 when 0 then 'viewer' when 1 then 'catalog_editor' else 'catalog_admin' end as member_role from customer)"""


def domain(t: Tables) -> dict[str, DataFrame]:
    return {"recordings": t.recordings, "split_sheets": t.sheets, "split_lines": t.split_lines}


@query(
    "visible_recordings",
    f"select recording_id from recordings where catalog_id in (select catalog_id from {MEMBERS} where user_id = 4 and member_role in ('catalog_editor', 'catalog_admin'))",
)
def _(t: Tables) -> DataFrame:
    return access.visible_rows("recordings", domain(t), members(t), 4, "write").select("recording_id")


@query(
    "visible_split_lines",
    f"""select split_line_id from split_lines where split_sheet_id in (select split_sheet_id from sheets
      where (status = 'draft' and catalog_id in (select catalog_id from {MEMBERS} where user_id = 4 and member_role in ('catalog_editor', 'catalog_admin')))
         or (status <> 'draft' and catalog_id in (select catalog_id from {MEMBERS} where user_id = 4 and member_role = 'catalog_admin')))""",
)
def _(t: Tables) -> DataFrame:
    return access.visible_rows("split_lines", domain(t), members(t), 4, "write").select("split_line_id")
