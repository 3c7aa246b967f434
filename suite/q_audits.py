"""Each integrity audit over tables with planted violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.operators import audits
from suite.projections import Tables
from suite.registry import query


def works(t: Tables) -> DataFrame:
    work = F.col("work_id")
    return t.recording_works.select("work_id").distinct().select(work, (work % 7).alias("catalog_id"))


def releases(t: Tables) -> tuple[DataFrame, DataFrame]:
    rec = F.col("recording_id")
    links = t.recordings.select((rec % 100).alias("release_id"), rec)
    return links.select("release_id").distinct().withColumn("catalog_id", F.col("release_id") % 7), links


def keyed(df: DataFrame) -> DataFrame:
    return df.select("key")


@query(
    "audit_split_total",
    """select cast(split_sheet_id as varchar) as key, 'active split sheet totals ' || coalesce(sum(share_basis_points), 0) || ' basis points' as message from sheets left join split_lines using (split_sheet_id)
     where status = 'active' group by split_sheet_id having coalesce(sum(share_basis_points), 0) <> 10000""",
)
def _(t: Tables) -> DataFrame:
    return audits.audit_split_totals({"split_sheets": t.sheets, "split_lines": t.split_lines}).select("key", "message")


@query("audit_release_catalog", "select (recording_id % 100) || '|' || recording_id as key from recordings where recording_id % 100 % 7 <> catalog_id")
def _(t: Tables) -> DataFrame:
    table, links = releases(t)
    return keyed(audits.audit_release_catalog({"releases": table, "release_recordings": links, "recordings": t.recordings}))


@query(
    "audit_sheet_catalog",
    """select cast(split_sheet_id as varchar) as key from sheets s left join recordings r using (recording_id) where s.catalog_id is distinct from coalesce(r.catalog_id, s.work_id % 7)""",
)
def _(t: Tables) -> DataFrame:
    return keyed(audits.audit_sheet_catalog({"split_sheets": t.sheets, "recordings": t.recordings, "music_works": works(t)}))


@query("audit_work_catalog", "select recording_id || '|' || work_id as key from recording_works join recordings using (recording_id) where work_id % 7 <> catalog_id")
def _(t: Tables) -> DataFrame:
    return keyed(audits.audit_work_catalog({"recording_works": t.recording_works, "recordings": t.recordings, "music_works": works(t)}))


def capture(t: Tables) -> dict[str, DataFrame]:
    e, u, ts = F.col("event_id"), F.col("user_id"), F.col("ts").cast("timestamp")
    chunks = t.raw("events").select(
        e.alias("capture_chunk_id"), (u % 25).alias("source_id"), F.when(e % 3 != 0, u % 30).alias("edge_node_id"),
        ts.alias("started_at"), (ts + F.expr("interval 30 seconds")).alias("ended_at"),
        F.when(e % 50 == 1, -1).otherwise(e).alias("byte_count"),
        F.when(e % 50 == 2, "abc").otherwise(F.sha2(e.cast("string"), 256)).alias("content_sha256"),
        F.when(e % 50 == 3, "secret").otherwise("hashes_only").alias("capture_policy"),
        F.when(e % 50 == 4, "lost").otherwise("received").alias("status"),
        F.when(e % 50 == 5, "key").alias("encrypted_object_key"),
    )
    start = ts + F.expr("interval 1 second") * (e % 40)
    detections = t.raw("events").select(
        e.alias("detection_id"), e.alias("capture_chunk_id"), (u % 25 + F.when(e % 17 == 0, 1).otherwise(0)).alias("source_id"),
        start.alias("started_at"), (start + F.expr("interval 10 seconds")).alias("ended_at"), F.lit(10).cast("decimal(10,3)").alias("duration_seconds"),
        (e % 9 - 1).alias("matched_hash_count"), (e % 110 / 100).alias("match_confidence"), F.when(e % 13 == 0, "lost").otherwise("candidate").alias("status"),
        F.when(e % 4 != 0, F.lit(0.75) + (e % 6) * 0.1).alias("reference_per_query_tempo_scale"),
    )
    node = F.col("node")
    nodes = t.raw("events").select((u % 30).alias("node")).distinct().select(node.alias("edge_node_id"), (node % 25).alias("source_id"))
    return {"capture_chunks": chunks, "detection_events": detections, "edge_nodes": nodes}


@query("audit_capture_source", "select cast(event_id as varchar) as key from events where event_id % 3 <> 0 and user_id % 30 % 25 <> user_id % 25")
def _(t: Tables) -> DataFrame:
    return keyed(audits.audit_capture_source(capture(t)))


@query(
    "audit_detection_capture",
    """select cast(event_id as varchar) as key, case when event_id % 17 = 0 then 'detection source must equal its capture source' else 'detection time must lie within its capture chunk' end as message
     from events where event_id % 17 = 0 or event_id % 40 > 20""",
)
def _(t: Tables) -> DataFrame:
    return audits.audit_detection_capture(capture(t)).select("key", "message")


def ledger(t: Tables) -> dict[str, DataFrame]:
    """Runs, usage items, allocations and payouts of all usage, with planted faults."""
    key, rec = F.col("usage_id"), F.col("recording_id")
    usage = t.usage
    items = usage.select(
        key.alias("usage_item_id"), F.col("catalog_id").alias("royalty_run_id"), key.alias("detection_id"),
        (rec + F.when(key % 19 == 0, 7).otherwise(0)).alias("split_sheet_id"),
        F.when(key % 29 == 0, "composition").otherwise("master").alias("right_type"), F.lit(100).cast("bigint").alias("gross_settled"),
    )
    runs = usage.select("catalog_id").distinct().select(
        F.col("catalog_id").alias("royalty_run_id"), "catalog_id", F.when(F.col("catalog_id") == 0, "draft").otherwise("approved").alias("status")
    )
    parts = items.withColumn("line_no", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    no = F.col("line_no")
    lines = t.split_lines
    allocations = parts.join(lines.hint("merge"), ["split_sheet_id", "line_no"]).select(
        (F.col("usage_item_id") * 10 + no).alias("allocation_id"), "usage_item_id", "split_line_id",
        (F.col("party_id") + F.when(F.col("usage_item_id") % 31 == 0, 1).otherwise(0)).alias("party_id"),
        F.col("role").alias("role_snapshot"), "share_basis_points",
        F.when(no == 1, 34).otherwise(F.when(F.col("usage_item_id") % 23 == 0, 30).otherwise(33)).cast("bigint").alias("settled_amount"),
    )
    payouts = usage.select(
        key.alias("payout_id"), (key % 2).alias("payout_batch_id"), (key % 10).alias("party_id"), (key % 20).alias("payment_account_id"),
        F.lit(66).cast("bigint").alias("amount_ugx"), F.when(key % 3 == 0, "queued").otherwise("paid").alias("status"),
    )
    item_rows = usage.withColumn("n", F.explode(F.when(key % 5 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))).select(
        key.alias("payout_id"), (key * 2 + F.col("n")).alias("allocation_id"), F.lit(33).cast("bigint").alias("amount_ugx")
    )
    owed = usage.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (key * 2 + F.col("n")).alias("allocation_id"), (key % 10 + F.when(key % 37 == 0, 1).otherwise(0)).alias("party_id"),
        F.when(key % 41 == 0, 34).otherwise(33).cast("bigint").alias("settled_amount"),
    )
    account = F.col("s_suppkey")
    accounts = t.raw("supplier").select(
        account.alias("payment_account_id"), (account % 10).alias("party_id"), F.when(account % 2 == 0, "mtn_momo").otherwise("airtel_money").alias("provider"),
        F.when(account == 7, "closed").otherwise("active").alias("status"),
    )
    region = F.col("r_regionkey")
    batches = t.raw("region").select(
        region.cast("bigint").alias("payout_batch_id"), F.when(region == 0, "mtn_momo").otherwise("airtel_money").alias("provider")
    )
    return {
        "royalty_runs": runs, "royalty_usage_items": items, "royalty_allocations": allocations, "split_lines": lines, "payouts": payouts,
        "payout_allocation_items": item_rows, "owed": owed, "payment_accounts": accounts, "payout_batches": batches,
        "detection_events": usage.select(key.alias("detection_id"), rec, "status"), "recordings": t.recordings, "split_sheets": t.sheets,
        "recording_works": t.recording_works,
    }


ITEMS = """(select usage_id, catalog_id as run, u.recording_id, u.status, u.catalog_id, u.recording_id + case when usage_id % 19 = 0 then 7 else 0 end as sheet,
  case when usage_id % 29 = 0 then 'composition' else 'master' end as right_type from usage_rows u)"""


@query(
    "audit_usage_links",
    f"""select cast(usage_id as varchar) as key, message from (select usage_id, case when i.status <> 'verified' then 'only verified detections may enter royalty calculations'
       when s.catalog_id is distinct from i.run then 'run, recording and split sheet must share one catalog'
       when s.right_type is distinct from i.right_type then 'usage right type must match the split sheet'
       when i.right_type = 'master' and s.recording_id is distinct from i.recording_id then 'master sheet must belong to the matched recording' end as message
      from {ITEMS} i left join sheets s on s.split_sheet_id = i.sheet) where message is not null""",
)
def _(t: Tables) -> DataFrame:
    return audits.audit_usage_links(ledger(t)).select("key", "message")


@query(
    "audit_allocation_snapshot",
    f"select cast(usage_id * 10 + line_no as varchar) as key from {ITEMS} i join split_lines l on l.split_sheet_id = i.sheet where usage_id % 31 = 0",
)
def _(t: Tables) -> DataFrame:
    return keyed(audits.audit_allocation_snapshot(ledger(t)))


@query("audit_payout_account", "select cast(usage_id as varchar) as key from usage_rows where usage_id % 20 = 7")
def _(t: Tables) -> DataFrame:
    return keyed(audits.audit_payout_account(ledger(t)))


@query(
    "audit_payout_item",
    """select usage_id || '|' || (usage_id * 2 + n) as key from (select usage_id, unnest(case when usage_id % 5 = 0 then [0] else [0, 1] end) as n from usage_rows)
     where usage_id % 37 = 0 or usage_id % 41 = 0""",
)
def _(t: Tables) -> DataFrame:
    tables = ledger(t)
    return keyed(audits.audit_payout_item({**tables, "royalty_allocations": tables["owed"]}))


@query("audit_payout_total", "select cast(usage_id as varchar) as key from usage_rows where usage_id % 3 <> 0 and usage_id % 5 = 0")
def _(t: Tables) -> DataFrame:
    return keyed(audits.audit_payout_total(ledger(t)))


@query(
    "audit_run_totals",
    f"""select cast(usage_id as varchar) as key from {ITEMS} i where run <> 0 and (usage_id % 23 = 0 or sheet not in (select split_sheet_id from split_lines))""",
)
def _(t: Tables) -> DataFrame:
    return keyed(audits.audit_run_totals(ledger(t)))


@query(
    "audit_unique_keys",
    """select key, count(*) as n from (
      select 'recordings (isrc) is held by ' || count(*) || ' rows' as key from (select recording_id % 1500 as isrc from recordings) group by isrc having count(*) > 1
      union all select 'recording_works (recording_id) is held by ' || count(*) || ' rows' from (select recording_id % 1900 as r, recording_id from recording_works) where recording_id % 3 <> 0 group by r having count(*) > 1
      union all select 'artists (party_id, stage_name) is held by ' || count(*) || ' rows' from (select c_custkey % 50 as p, c_mktsegment as s from customer) group by p, s having count(*) > 1
      union all select 'detection_disputes (detection_id) is held by ' || count(*) || ' rows' from (select o_custkey as d from orders where o_orderstatus = 'O') group by d having count(*) > 1) group by key""",
)
def _(t: Tables) -> DataFrame:
    """ISRCs repeat after 1 500 recordings, primary works after 1 900; artists differ only in case."""
    rec = F.col("recording_id")
    segment = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    tables = {
        "recordings": t.recordings.select((rec % 1500).cast("string").alias("isrc")),
        "recording_works": t.recording_works.select((rec % 1900).alias("recording_id"), (rec % 3 != 0).alias("is_primary_work")),
        "artists": t.raw("customer").select((F.col("c_custkey") % 50).alias("party_id"), segment.alias("stage_name")),
        "detection_disputes": t.raw("orders").select(
            F.col("o_custkey").alias("detection_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("dismissed").alias("status")
        ),
    }
    return audits.audit_unique_keys(tables).groupBy(F.col("message").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_foreign_keys",
    f"""select 'royalty_usage_items.split_sheet_id ' || sheet || ' is not in split_sheets' as message, cast(usage_id as varchar) as key from {ITEMS} where sheet not in (select split_sheet_id from sheets)
     union all select 'split_sheets.work_id ' || work_id || ' is not in music_works', cast(split_sheet_id as varchar) from sheets where work_id % 9 = 0""",
)
def _(t: Tables) -> DataFrame:
    tables = ledger(t)
    chosen = {k: tables[k] for k in ("royalty_usage_items", "split_sheets", "recordings", "detection_events")}
    return audits.audit_foreign_keys({**chosen, "music_works": works(t).where("work_id % 9 <> 0")}).select("message", "key")


@query(
    "audit_row_checks",
    """select cast(event_id as varchar) as key, 'matched_hash_count is negative' as message from events where event_id % 9 = 0
     union all select cast(event_id as varchar), 'match_confidence outside [0, 1]' from events where event_id % 110 > 100
     union all select cast(event_id as varchar), 'status outside its domain' from events where event_id % 13 = 0
     union all select cast(event_id as varchar), 'tempo scale outside [0.80, 1.20]' from events where event_id % 4 <> 0 and event_id % 6 in (0, 5)
     union all select cast(event_id as varchar), case event_id % 50 when 1 then 'byte_count is negative' when 2 then 'content_sha256 is malformed' when 3 then 'capture_policy outside its domain'
       when 4 then 'status outside its domain' else 'hashes_only chunk has an object key' end from events where event_id % 50 between 1 and 5""",
)
def _(t: Tables) -> DataFrame:
    tables = capture(t)
    found = audits.audit_row_checks("detection_events", tables["detection_events"], ["detection_id"])
    return found.unionByName(audits.audit_row_checks("capture_chunks", tables["capture_chunks"], ["capture_chunk_id"])).select("key", "message")


@query(
    "audit_weight_overlap",
    """select distinct b.source_id || '|' || cast(b.valid_from as varchar) as key from (select source_id, valid_from, case when weight_id % 4 = 1 then null else valid_to end as valid_to from weights) a
    join weights b on a.source_id = b.source_id and a.valid_from < b.valid_from and (a.valid_to is null or a.valid_to >= b.valid_from)""",
)
def _(t: Tables) -> DataFrame:
    stretched = t.weights.withColumn("valid_to", F.when(F.col("weight_id") % 4 != 1, F.col("valid_to")))
    return keyed(audits.audit_weight_overlap({"source_weights": stretched}))


@query(
    "split_findings",
    """select split_sheet_id, 'SPLIT_TOTAL_INVALID' as code, 'error' as severity from sheets left join split_lines using (split_sheet_id) group by 1 having coalesce(sum(share_basis_points), 0) <> 10000
     union all select split_sheet_id, 'SOURCE_DOCUMENT_MISSING', 'warning' from sheets where source_document_key is null
     union all select split_sheet_id, 'CONFLICTING_ACTIVE_SHEETS', 'error' from (select split_sheet_id, count(*) over (partition by coalesce(recording_id % 1800, work_id + 100000)) as n from sheets where status = 'active') where n > 1
     union all select split_sheet_id, 'ISRC_MISSING', 'info' from sheets where recording_id % 1800 % 8 = 0""",
)
def _(t: Tables) -> DataFrame:
    """Recordings repeat after 1 800, so some assets have two active sheets; every eighth lacks an ISRC."""
    rec = F.col("recording_id")
    sheets = t.sheets.withColumn("recording_id", rec % 1800)
    bare = t.recordings.select((rec % 1800).alias("recording_id")).distinct().select(rec, F.when(rec % 8 != 0, "known").alias("isrc"))
    found = audits.split_findings({"split_sheets": sheets, "split_lines": t.split_lines, "recordings": bare})
    return found.select("split_sheet_id", "code", "severity")
