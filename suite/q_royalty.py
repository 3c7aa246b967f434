"""Gross, allocation, effective dating, runs, payouts and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.operators import effective, royalty
from suite.projections import Tables
from suite.registry import query


def weighted(t: Tables) -> DataFrame:
    return effective.effective_weight(t.usage, t.weights)


def settled_usage(t: Tables) -> DataFrame:
    """Verified usage priced at its own rate and the weight of its day."""
    rows = effective.effective_weight(t.usage.where("status = 'verified'"), t.weights)
    return royalty.gross(rows.withColumn("split_sheet_id", F.col("recording_id")))


WEIGHTED = """
weighted as (select u.*, w.weight_pct from usage_rows u join weights w on w.source_id = u.source_id and used_on >= valid_from and (valid_to is null or used_on <= valid_to))"""
PRICED = WEIGHTED + """,
priced as (select *, base_rate_ugx * weight_pct * detected_seconds as n, 100 * reference_seconds as d from weighted where status = 'verified'),
settled as (select *, (2 * n + d) // (2 * d) as gross_settled from priced)"""
ALLOCATED = PRICED + """,
sound as (select split_sheet_id from split_lines group by 1 having sum(share_basis_points) = 10000),
parts as (select s.*, l.line_no, l.split_line_id, l.party_id, l.role, l.share_basis_points, (n * share_basis_points) // (d * 10000) as fl, (n * share_basis_points) % (d * 10000) as rest
  from settled s join split_lines l on l.split_sheet_id = s.recording_id where l.split_sheet_id in (select split_sheet_id from sound)),
allocated as (select *, fl + case when row_number() over (partition by usage_id order by rest desc, line_no) <= gross_settled - sum(fl) over (partition by usage_id) then 1 else 0 end as settled_amount from parts)"""


def _with(ctes: str, tail: str) -> str:
    """Private CTEs go after the projections they read: nest them in a subquery."""
    return f"select * from (with {ctes.strip()} {tail})"


@query(
    "gross_settled",
    _with(PRICED, "select usage_id, cast(gross_settled as bigint) as gross_settled from settled"),
)
def _(t: Tables) -> DataFrame:
    return settled_usage(t).select("usage_id", F.col("gross_settled").cast("bigint").alias("gross_settled"))


@query(
    "royalty_allocations",
    _with(ALLOCATED, "select usage_id, line_no, party_id, cast(share_basis_points as bigint) as share_basis_points, cast(settled_amount as bigint) as settled_amount from allocated"),
)
def allocations(t: Tables) -> DataFrame:
    return royalty.allocate(settled_usage(t), t.split_lines).select(
        "usage_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        "party_id",
        F.col("share_basis_points").cast("bigint").alias("share_basis_points"),
        F.col("settled_amount").cast("bigint").alias("settled_amount"),
    )


@query(
    "largest_remainder",
    _with(ALLOCATED, "select usage_id, line_no, cast(settled_amount as bigint) as settled_amount from allocated"),
)
def _(t: Tables) -> DataFrame:
    lines, _refused = royalty.validate_recipients(t.split_lines)
    rows = settled_usage(t).join(lines.hint("merge"), "split_sheet_id")
    return royalty.largest_remainder(rows).select(
        "usage_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("settled_amount").cast("bigint").alias("settled_amount")
    )


@query(
    "settlement_preserves_gross",
    _with(ALLOCATED, """select usage_id, any_value(gross_settled)::bigint as gross_settled, sum(settled_amount)::bigint as paid,
     count(*) as lines from allocated group by usage_id"""),
)
def _(t: Tables) -> DataFrame:
    return (
        royalty.allocate(settled_usage(t), t.split_lines)
        .groupBy("usage_id")
        .agg(
            F.max("gross_settled").cast("bigint").alias("gross_settled"),
            F.sum("settled_amount").cast("bigint").alias("paid"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


@query(
    "invalid_recipients",
    """select split_sheet_id, count(*) as lines, sum(share_basis_points)::bigint as total_basis_points,
    'split shares must total 10000 basis points, received ' || sum(share_basis_points) as errors
    from split_lines group by 1 having sum(share_basis_points) <> 10000""",
)
def _(t: Tables) -> DataFrame:
    _sound, refused = royalty.validate_recipients(t.split_lines)
    return refused.select(
        "split_sheet_id", "lines", F.col("total_basis_points").cast("bigint").alias("total_basis_points"),
        F.array_join("errors", "; ").alias("errors"),
    )


@query(
    "effective_weight",
    """select u.usage_id, w.weight_pct from usage_rows u left join weights w on w.source_id = u.source_id
    and used_on >= valid_from and (valid_to is null or used_on <= valid_to)""",
)
def _(t: Tables) -> DataFrame:
    return weighted(t).select("usage_id", (F.col("weight") * 100).cast("bigint").alias("weight_pct"))


@query(
    "effective_tariff",
    """select u.usage_id, t.tariff_id, t.base_rate_ugx as rate from usage_rows u join sources s using (source_id)
    left join tariffs t on t.catalog_id = u.catalog_id and (t.source_type is null or t.source_type = s.source_type)
     and used_on >= valid_from and (valid_to is null or used_on <= valid_to)
    qualify row_number() over (partition by u.usage_id order by t.source_type is null, valid_from desc, tariff_id desc) = 1""",
)
def _(t: Tables) -> DataFrame:
    asked = (
        t.usage.drop("base_rate_ugx")
        .join(t.sources.select("source_id", "source_type"), "source_id")
        .withColumn("right_type", F.lit("master"))
    )
    return effective.effective_tariff(asked, t.tariffs).select(
        "usage_id", "tariff_id", F.col("base_rate_ugx").cast("bigint").alias("rate")
    )


@query(
    "active_split",
    """select u.usage_id, r.right_type, rw.work_id, s.split_sheet_id from usage_rows u cross join (select unnest(['master', 'composition']) as right_type) r
    left join recording_works rw on r.right_type <> 'master' and rw.recording_id = u.recording_id
    left join sheets s on s.status = 'active' and s.right_type = r.right_type
     and (r.right_type = 'master' and s.recording_id = u.recording_id or s.work_id = rw.work_id) and used_on >= valid_from and (valid_to is null or used_on <= valid_to)""",
)
def _(t: Tables) -> DataFrame:
    asked = t.usage.withColumn("right_type", F.explode(F.array(F.lit("master"), F.lit("composition"))))
    found = effective.active_split(asked, t.sheets, t.recording_works)
    return found.select("usage_id", "right_type", "work_id", "split_sheet_id")


@query(
    "overlapping_weights",
    """select distinct b.weight_id from (select weight_id, source_id, valid_from, case when weight_id % 3 = 0 then valid_from + 400 else valid_to end as valid_to from weights) a
    join (select weight_id, source_id, valid_from, case when weight_id % 3 = 0 then valid_from + 400 else valid_to end as valid_to from weights) b
     on a.source_id = b.source_id and a.valid_from < b.valid_from and (a.valid_to is null or a.valid_to >= b.valid_from)""",
)
def _(t: Tables) -> DataFrame:
    stretched = t.weights.withColumn(
        "valid_to", F.when(F.col("weight_id") % 3 == 0, F.date_add("valid_from", 400)).otherwise(F.col("valid_to"))
    )
    return effective.overlapping_weights(stretched).select("weight_id")


@query(
    "held_usage",
    """select usage_id, concat_ws(',', case when status <> 'verified' then 'status:' || status end,
      case when usage_id % 10 = 3 then 'open_dispute' end, case when usage_id % 8 = 0 then 'overlap_unresolved' end) as hold_reasons
    from usage_rows where status <> 'verified' or usage_id % 10 = 3 or usage_id % 8 = 0""",
)
def _(t: Tables) -> DataFrame:
    usage = t.usage.withColumnRenamed("usage_id", "detection_id").withColumn("overlap_resolved", F.col("detection_id") % 8 != 0)
    disputes = t.raw("orders").select(
        F.col("o_orderkey").alias("detection_id"), F.when(F.col("o_orderkey") % 10 == 3, "open").otherwise("dismissed").alias("status")
    )
    _eligible, held = royalty.eligible_usage(usage, disputes)
    return held.select(F.col("detection_id").alias("usage_id"), F.array_join("hold_reasons", ",").alias("hold_reasons"))


@query(
    "usage_errors",
    """select o_orderkey as usage_id, concat_ws('; ', case when o_orderkey % 7 = 0 then 'base_rate_ugx must be finite' end,
      case when o_totalprice - 20000 < 0 then 'rate and source weight cannot be negative' end,
      case when o_orderkey % 5 = 0 then 'durations must be non-negative and reference duration must be positive' end,
      case when o_orderkey % 4 = 1 then 'detected_seconds has more than 3 decimal places' end) as errors from orders""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    rows = t.raw("orders").select(
        key.alias("usage_id"),
        F.lit("master").alias("right_type"),
        F.when(key % 7 == 0, F.when(key % 2 == 0, "NaN").otherwise("a lot")).otherwise("100.5").alias("base_rate_ugx"),
        (F.col("o_totalprice").cast("decimal(12,2)") - 20000).alias("weight"),
        F.when(key % 4 == 1, "30.0005").otherwise("30.500").alias("detected_seconds"),
        F.when(key % 5 == 0, 0).otherwise(180).alias("reference_seconds"),
    )
    return royalty.validate_usage(rows).select("usage_id", F.array_join("errors", "; ").alias("errors"))


def run(t: Tables) -> dict[str, DataFrame]:
    """Both rights of catalog 3, with open disputes, unresolved overlaps and days that are local ones."""
    key = F.col("usage_id")
    hours = F.make_dt_interval(hours=(key % 24).cast("int"))
    detections = t.usage.join(t.sources.select("source_id", "source_type"), "source_id").select(
        key.alias("detection_id"), "source_id", "source_type", "recording_id", "catalog_id", (F.col("used_on").cast("timestamp") + hours).alias("started_at"),
        "status", "detected_seconds", "reference_seconds", (key % 8 != 0).alias("overlap_resolved"),
    )
    order = F.col("o_orderkey")
    disputes = t.raw("orders").select(order.alias("detection_id"), F.when(order % 10 == 3, "open").otherwise("dismissed").alias("status"))
    tariffs = t.tariffs.unionByName(
        t.tariffs.withColumns(
            {"tariff_id": F.col("tariff_id") + 100, "right_type": F.lit("composition"), "base_rate_ugx": (F.col("base_rate_ugx") + 50).cast(t.tariffs.schema["base_rate_ugx"].dataType)}
        )
    )
    work, no = F.col("work_id"), F.col("line_no")
    shares = F.when(work % 9 == 0, F.array(*map(F.lit, (6000, 4000, 0)))).otherwise(F.array(*map(F.lit, (6000, 4000))))
    of_works = t.recording_works.select("work_id").distinct().select("work_id", F.posexplode(shares).alias("line_no", "share_basis_points")).select(
        (work + 1_000_000).alias("split_sheet_id"), (work * 10 + no + 10_000_000).alias("split_line_id"), (no + 1).alias("line_no"),
        ((work + no) % 10).alias("party_id"), F.lit("composer").alias("role"), "share_basis_points",
    )
    return royalty.royalty_run(
        detections, disputes, t.weights, tariffs, t.sheets, t.split_lines.unionByName(of_works), t.recording_works,
        catalog_id=3, period=("1996-01-01", "2001-01-01"), right_types=("master", "composition"),
    )


RUN = """
chosen as (select u.* replace (cast(used_on + case when usage_id % 24 >= 21 then 1 else 0 end as date) as used_on), s.source_type from usage_rows u join sources s using (source_id)
  where catalog_id = 3 and cast(used_on + case when usage_id % 24 >= 21 then 1 else 0 end as date) between date '1996-01-01' and date '2000-12-31'),
asked as (select c.*, r.right_type, rw.work_id from chosen c cross join (select unnest(['master', 'composition']) as right_type) r
  left join recording_works rw on r.right_type <> 'master' and rw.recording_id = c.recording_id
  where status = 'verified' and usage_id % 10 <> 3 and usage_id % 8 <> 0),
w as (select c.*, x.weight_pct from asked c left join weights x on x.source_id = c.source_id and used_on >= x.valid_from and (x.valid_to is null or used_on <= x.valid_to)),
f as (select w.*, t.tariff_id + case when w.right_type = 'master' then 0 else 100 end as tariff_id, t.base_rate_ugx + case when w.right_type = 'master' then 0 else 50 end as rate
   from w left join tariffs t on t.catalog_id = w.catalog_id and (t.source_type is null or t.source_type = w.source_type)
   and used_on >= valid_from and (valid_to is null or used_on <= valid_to)
  qualify row_number() over (partition by w.usage_id, w.right_type, w.work_id order by t.source_type is null, valid_from desc, t.tariff_id desc) = 1),
z as (select f.*, s.split_sheet_id from f left join sheets s on s.status = 'active' and s.right_type = f.right_type and (f.right_type = 'master' and s.recording_id = f.recording_id or s.work_id = f.work_id)
   and used_on >= valid_from and (valid_to is null or used_on <= valid_to)),
all_lines as (select split_sheet_id, line_no, party_id, share_basis_points from split_lines
  union all select work_id + 1000000, n, (work_id + n - 1) % 10, case n when 1 then 6000 when 2 then 4000 else 0 end
   from (select distinct work_id from recording_works) cross join (select unnest([1, 2, 3]) as n) where n < 3 or work_id % 9 = 0),
bad as (select split_sheet_id from all_lines group by 1 having sum(share_basis_points) <> 10000),
items as (select *, rate * weight_pct * detected_seconds as n, 100 * reference_seconds as d from z where weight_pct is not null and tariff_id is not null
   and split_sheet_id is not null and split_sheet_id not in (select split_sheet_id from bad)),
priced as (select *, (2 * n + d) // (2 * d) as gross_settled from items)"""


@query(
    "royalty_run_items",
    _with(RUN, "select usage_id as detection_id, right_type, work_id, tariff_id, split_sheet_id, cast(gross_settled as bigint) as gross_settled from priced"),
)
def _(t: Tables) -> DataFrame:
    return run(t)["usage_items"].select(
        "detection_id", "right_type", "work_id", "tariff_id", "split_sheet_id", F.col("gross_settled").cast("bigint").alias("gross_settled")
    )


@query(
    "royalty_run_held",
    _with(RUN, """select usage_id as detection_id, null as right_type, null as work_id, concat_ws(',', case when status <> 'verified' then 'status:' || status end,
       case when usage_id % 10 = 3 then 'open_dispute' end, case when usage_id % 8 = 0 then 'overlap_unresolved' end) as hold_reasons
      from chosen where status <> 'verified' or usage_id % 10 = 3 or usage_id % 8 = 0
      union all select usage_id, right_type, work_id, case when weight_pct is null or tariff_id is null or split_sheet_id is null then concat_ws(',', case when weight_pct is null then 'no_source_weight' end,
        case when tariff_id is null then 'no_tariff' end, case when split_sheet_id is null then 'no_active_split' end) else 'split_invalid' end
      from z where weight_pct is null or tariff_id is null or split_sheet_id is null or split_sheet_id in (select split_sheet_id from bad)"""),
)
def _(t: Tables) -> DataFrame:
    return run(t)["held"].select("detection_id", "right_type", "work_id", F.array_join("hold_reasons", ",").alias("hold_reasons"))


@query(
    "royalty_run_allocations",
    _with(RUN + """,
parts as (select p.*, l.line_no, l.party_id, (n * share_basis_points) // (d * 10000) as fl, (n * share_basis_points) % (d * 10000) as rest from priced p join all_lines l using (split_sheet_id)),
al as (select *, fl + case when row_number() over (partition by usage_id, right_type, work_id order by rest desc, line_no) <= gross_settled - sum(fl) over (partition by usage_id, right_type, work_id) then 1 else 0 end as settled_amount from parts)""",
        "select usage_id as detection_id, right_type, work_id, line_no, party_id, cast(settled_amount as bigint) as settled_amount from al"),
)
def _(t: Tables) -> DataFrame:
    return run(t)["allocations"].select(
        "detection_id", "right_type", "work_id", F.col("line_no").cast("bigint").alias("line_no"), "party_id", F.col("settled_amount").cast("bigint").alias("settled_amount")
    )


def due(t: Tables) -> DataFrame:
    """Allocations of the whole table in yearly runs, every ninth held and every seventh in review."""
    return royalty.allocate(settled_usage(t), t.split_lines).select(
        F.year("used_on").cast("string").alias("royalty_run_id"),
        (F.col("usage_id") * 10 + F.col("line_no")).alias("allocation_id"),
        "usage_id", "party_id", "source_id", "used_on", "detected_seconds", "share_basis_points", "raw_amount_ugx", "settled_amount",
        F.when(F.col("usage_id") % 7 == 0, "review").otherwise("approved").alias("status"),
        (F.col("usage_id") % 9 == 0).alias("held"),
    )


def accounts(t: Tables) -> DataFrame:
    """Every supplier is an account of one of ten parties; parties 0 and 7 have no active one."""
    key = F.col("s_suppkey")
    return t.raw("supplier").select(
        key.alias("payment_account_id"),
        (key % 10).alias("party_id"),
        F.when(key % 3 == 0, "mtn_momo").otherwise("airtel_money").alias("provider"),
        F.when(key % 10 % 7 == 0, "suspended").otherwise("active").alias("status"),
    )


ACCOUNT = """,
acc as (select s_suppkey % 10 as party_id, arg_min(case when s_suppkey % 3 = 0 then 'mtn_momo' else 'airtel_money' end, s_suppkey) as provider, min(s_suppkey) as payment_account_id
  from supplier where s_suppkey % 10 % 7 <> 0 group by 1)"""


@query(
    "payout_batches",
    _with(ALLOCATED + ACCOUNT, """select cast(year(used_on) as varchar) as royalty_run_id, provider, party_id, any_value(payment_account_id) as payment_account_id, sum(settled_amount)::bigint as amount_ugx, count(*) as items
      from allocated join acc using (party_id) where usage_id % 7 <> 0 and usage_id % 9 <> 0 and settled_amount > 0 group by 1, 2, 3"""),
)
def _(t: Tables) -> DataFrame:
    payouts, _items = royalty.payout_batches(due(t), accounts(t))
    return payouts.select(
        "royalty_run_id", "provider", "party_id", "payment_account_id", F.col("amount_ugx").cast("bigint").alias("amount_ugx"), "items"
    )


@query(
    "party_statement_totals",
    _with(ALLOCATED, """select party_id, case when usage_id % 7 = 0 then 'review' else 'approved' end as status, count(*) as lines, sum(settled_amount)::bigint as settled_amount from allocated group by 1, 2"""),
)
def _(t: Tables) -> DataFrame:
    _lines, totals = royalty.party_statement(due(t))
    return totals.withColumn("settled_amount", F.col("settled_amount").cast("bigint"))


@query(
    "party_statement_lines",
    _with(ALLOCATED, """select party_id, usage_id, cast(used_on as varchar) as used_on, detected_seconds, cast(share_basis_points as bigint) as share_basis_points, cast(settled_amount as bigint) as settled_amount from allocated"""),
)
def _(t: Tables) -> DataFrame:
    lines, _totals = royalty.party_statement(due(t))
    return lines.select(
        "party_id", "usage_id", F.col("used_on").cast("string").alias("used_on"), "detected_seconds",
        F.col("share_basis_points").cast("bigint").alias("share_basis_points"), F.col("settled_amount").cast("bigint").alias("settled_amount"),
    )
