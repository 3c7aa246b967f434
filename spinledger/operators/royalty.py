"""Royalty amounts: gross, largest-remainder allocation, runs, payouts, statements.

Money is exact. Rate, weight and durations become whole numbers of their smallest
unit, so gross is one fraction ``numerator / denominator`` that is never rounded before
settlement. An amount beyond 38 digits fails loudly under Spark's ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from spinledger.functions.columns import error_list, is_blank, local_date, stable_id
from spinledger.functions.lineage import cut
from spinledger.functions.skew import salted_lookup
from spinledger.operators.effective import active_split, effective_tariff, effective_weight
from spinledger.schemas import BASIS_POINTS

# Decimal places of the inputs.
RATE_PLACES, WEIGHT_PLACES, SECONDS_PLACES = 4, 6, 3


PLACES = {
    "base_rate_ugx": RATE_PLACES, "weight": WEIGHT_PLACES, "detected_seconds": SECONDS_PLACES, "reference_seconds": SECONDS_PLACES
}


def _too_long(name: str) -> Column:
    """Whether a number has more decimal places than the contract holds; NULL where it is none."""
    value = F.col(name).cast("string").try_cast("decimal(38,12)")
    exact = value.cast("string").try_cast("double") == F.col(name).cast("string").try_cast("double")
    return ~exact | (value != F.round(value, PLACES[name]))


def usage_errors() -> Column:
    """What is wrong with raw usage inputs, given as text, double or decimal."""
    numbers = ["base_rate_ugx", "weight", "detected_seconds", "reference_seconds"]
    value = {c: F.col(c).cast("string").try_cast("double") for c in numbers}
    finite = {c: value[c].isNotNull() & ~F.isnan(value[c]) & (F.abs(value[c]) != float("inf")) for c in numbers}
    return error_list(
        (is_blank(F.col("usage_id").cast("string")) | is_blank("right_type"), "usage_event_id and right_type are required"),
        *[(~finite[c], f"{c} must be finite") for c in numbers],
        (
            (finite["base_rate_ugx"] & (value["base_rate_ugx"] < 0)) | (finite["weight"] & (value["weight"] < 0)),
            "rate and source weight cannot be negative",
        ),
        (
            (finite["detected_seconds"] & (value["detected_seconds"] < 0))
            | (finite["reference_seconds"] & (value["reference_seconds"] <= 0)),
            "durations must be non-negative and reference duration must be positive",
        ),
        *[(finite[c] & _too_long(c), f"{c} has more than {n} decimal places") for c, n in PLACES.items()],
    )


def validate_usage(usage: DataFrame) -> DataFrame:
    return usage.withColumn("errors", usage_errors())


def eligible_usage(detections: DataFrame, disputes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eligible, held with reasons). ``overlap_resolved`` must be true to be eligible."""
    opened = disputes.where(F.col("status") == "open").select("detection_id").distinct().withColumn("_open", F.lit(True))
    reasons = error_list(
        (~F.col("status").eqNullSafe("verified"), F.concat(F.lit("status:"), F.col("status"))),
        (F.col("_open").isNotNull(), "open_dispute"),
        (~F.coalesce("overlap_resolved", F.lit(False)), "overlap_unresolved"),
    )
    marked = detections.join(opened.hint("merge"), "detection_id", "left").withColumn("hold_reasons", reasons).drop("_open")
    return marked.where(F.size("hold_reasons") == 0).drop("hold_reasons"), marked.where(F.size("hold_reasons") > 0)


def gross(usage: DataFrame, quantum_digits: int = 0) -> DataFrame:
    """Add ``numerator``, ``denominator``, ``gross_raw_ugx`` and ``gross_settled`` units.

    One unit is ten to the minus ``quantum_digits`` UGX. Settlement rounds half up. A
    number with more decimal places than its contract ends the job; it is never rounded.
    """
    if not 0 <= quantum_digits <= 4:
        raise ValueError("the settlement quantum must be a power of ten from 0.0001 to 1")
    kinds = {f.name: f.dataType for f in usage.schema.fields}

    def whole(c: str, digits: int, places: int) -> Column:
        kind, value = kinds[c], F.col(c)
        if not isinstance(kind, IntegralType) and not (isinstance(kind, DecimalType) and kind.scale <= places):
            value = F.when(_too_long(c), F.raise_error(F.lit(f"{c} has more than {places} decimal places"))).otherwise(value)
        return (value.cast(f"decimal({digits},{places})") * F.lit(10**places).cast("decimal(8,0)")).cast(f"decimal({digits},0)")

    product = whole("base_rate_ugx", 18, 4) * whole("weight", 12, 6)
    numerator = (product.cast("decimal(30,0)") * whole("detected_seconds", 10, 3)).cast("decimal(38,0)")
    denominator = (
        whole("reference_seconds", 10, 3) * F.lit(10 ** (RATE_PLACES + WEIGHT_PLACES)).cast("decimal(11,0)")
    ).cast("decimal(22,0)")
    units = F.lit(10**quantum_digits).cast("decimal(5,0)")
    priced = usage.withColumn("numerator", numerator).withColumn("denominator", denominator)
    return priced.withColumn(
        "gross_raw_ugx", (F.col("numerator") / F.col("denominator")).cast("decimal(20,8)")
    ).withColumn(
        "gross_settled",
        F.expr(f"(2 * numerator * {10**quantum_digits} + denominator) div (2 * denominator)"),
    ).withColumn("unit_ugx", (F.lit(1).cast("decimal(9,4)") / units).cast("decimal(9,4)"))


def recipient_errors(lines: DataFrame, sheet: str = "split_sheet_id") -> DataFrame:
    """Per sheet: line count, total and why it cannot settle; empty when it can."""
    blank = is_blank(F.col("split_line_id").cast("string")) | is_blank(F.col("party_id").cast("string")) | is_blank("role")
    per_line = lines.groupBy(sheet, "split_line_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("share_basis_points").alias("bp"),
        F.count_if(~F.coalesce(F.col("share_basis_points").between(0, BASIS_POINTS), F.lit(False))).alias("out"),
        F.count_if(blank).alias("blank"),
    )
    totals = per_line.groupBy(sheet).agg(
        F.sum("n").alias("lines"),
        F.coalesce(F.sum("bp"), F.lit(0)).alias("total_basis_points"),
        F.max("n").alias("_same"),
        F.sum("out").alias("_out"),
        F.sum("blank").alias("_blank"),
    )
    return totals.withColumn(
        "errors",
        error_list(
            (F.col("_blank") > 0, "split_line_id, party_id, and role are required"),
            (F.col("_out") > 0, "split shares must be between 0 and 10,000 basis points"),
            (F.col("_same") > 1, "split line IDs must be unique within a calculation"),
            (
                F.col("total_basis_points") != BASIS_POINTS,
                F.concat(
                    F.lit(f"split shares must total {BASIS_POINTS} basis points, received "),
                    F.col("total_basis_points").cast("string"),
                ),
            ),
        ),
    ).drop("_same", "_out", "_blank")


def validate_recipients(lines: DataFrame, sheet: str = "split_sheet_id") -> tuple[DataFrame, DataFrame]:
    """(lines of sheets that can settle, sheets that cannot)."""
    judged = recipient_errors(lines, sheet)
    sound = judged.where(F.size("errors") == 0).select(sheet)
    return lines.join(sound.hint("merge"), sheet, "left_semi"), judged.where(F.size("errors") > 0)


def largest_remainder(rows: DataFrame, item: str = "usage_id", quantum_digits: int = 0) -> DataFrame:
    """Settle long rows of ``item, line_no, share_basis_points, numerator, denominator, gross_settled``.

    Every line gets its floor; the units left over go to the largest remainders,
    earlier lines first. An item has as many rows as its sheet has lines.
    """
    scaled = f"(numerator * {10**quantum_digits} * share_basis_points)"
    each = rows.withColumn("_floor", F.expr(f"{scaled} div (denominator * {BASIS_POINTS})")).withColumn(
        "_rest", F.expr(f"{scaled} % (denominator * {BASIS_POINTS})")
    )
    group = Window.partitionBy(item)
    order = group.orderBy(F.desc("_rest"), F.asc("line_no"))
    left_over = F.col("gross_settled") - F.sum("_floor").over(group)
    bonus = F.when(F.row_number().over(order) <= left_over, 1).otherwise(0)
    return each.withColumn("settled_amount", F.col("_floor") + bonus).drop("_floor", "_rest")


def sheet_arrays(lines: DataFrame, sheet: str = "split_sheet_id") -> DataFrame:
    """One row per valid sheet with its lines in order.

    Positive shares of a valid sheet number at most 10 000, and a zero share can
    never earn a unit, so the array is bounded; zero lines are settled separately.
    """
    return (
        lines.where(F.col("share_basis_points") > 0)
        .groupBy(sheet)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("line_no", "split_line_id", "party_id", "role", "share_basis_points"))
            ).alias("lines")
        )
    )


def allocate(
    usage: DataFrame, lines: DataFrame, sheet: str = "split_sheet_id", quantum_digits: int = 0
) -> DataFrame:
    """Split each priced usage row over its sheet so that the parts sum to the gross.

    Sheets are folded into one row each and looked up once. The remainders are then
    ranked inside the row, so nothing is shuffled by usage.
    """
    sound, _ = validate_recipients(lines, sheet)
    key = [c for c in ("usage_id", "right_type") if c in usage.columns]
    met = salted_lookup(usage, sheet_arrays(sound, sheet), [sheet], spread_by=key, how="inner")
    base = F.col("denominator") * F.lit(BASIS_POINTS)
    units = F.lit(10**quantum_digits)

    def part(x: Column) -> Column:
        amount = (F.col("numerator") * units * x["share_basis_points"]).cast("decimal(38,0)")
        return F.struct(
            (-(amount % base)).alias("rest"),
            x["line_no"].alias("line_no"),
            # Not ``/``: decimal division would round.
            ((amount - amount % base) / base).cast("bigint").alias("floor"),
            x.alias("line"),
        )

    ranked = met.withColumn("_parts", F.array_sort(F.transform("lines", part))).withColumn(
        "_left",
        F.col("gross_settled") - F.aggregate("_parts", F.lit(0).cast("bigint"), lambda a, p: a + p["floor"]),
    )
    settled = ranked.select(*usage.columns, "_left", F.posexplode("_parts").alias("_rank", "p")).select(
        *usage.columns,
        F.col("p.line.split_line_id").alias("split_line_id"),
        F.col("p.line_no").alias("line_no"),
        F.col("p.line.party_id").alias("party_id"),
        F.col("p.line.role").alias("role"),
        F.col("p.line.share_basis_points").alias("share_basis_points"),
        (F.col("gross_raw_ugx") * F.col("p.line.share_basis_points") / F.lit(BASIS_POINTS))
        .cast("decimal(20,8)")
        .alias("raw_amount_ugx"),
        (F.col("p.floor") + F.when(F.col("_rank") < F.col("_left"), 1).otherwise(0)).alias("settled_amount"),
    )
    zero = sound.where(F.col("share_basis_points") == 0).select(
        sheet, "split_line_id", "line_no", "party_id", "role", "share_basis_points"
    )
    unpaid = usage.join(zero.hint("merge"), sheet).select(
        *usage.columns,
        "split_line_id",
        "line_no",
        "party_id",
        "role",
        "share_basis_points",
        F.lit(0).cast("decimal(20,8)").alias("raw_amount_ugx"),
        F.lit(0).cast("bigint").alias("settled_amount"),
    )
    return settled.unionByName(unpaid)


def usage_inputs(
    usage: DataFrame,
    weights: DataFrame,
    tariffs: DataFrame,
    sheets: DataFrame,
    recording_works: DataFrame,
) -> DataFrame:
    """Freeze the weight, tariff and split in force for each usage row and right, and each linked work of the latter."""
    return active_split(effective_tariff(effective_weight(usage, weights), tariffs), sheets, recording_works)


def royalty_run(
    detections: DataFrame,
    disputes: DataFrame,
    weights: DataFrame,
    tariffs: DataFrame,
    sheets: DataFrame,
    lines: DataFrame,
    recording_works: DataFrame,
    *,
    catalog_id: object,
    period: tuple[object, object],
    right_types: tuple[str, ...] = ("master",),
    calculation_version: str = "1",
) -> dict[str, DataFrame]:
    """Price and allocate one catalog's verified usage in ``[start, end)``.

    A detection's day is ``used_on``, or without that column the local date of its
    ``started_at``. Returns ``usage_items``, one for each linked work of rights in works,
    ``allocations`` and ``held``. Keys are hashes of the run, the detection and the work,
    so a rerun writes the same rows.
    """
    if "used_on" not in detections.columns:
        detections = detections.withColumn("used_on", local_date("started_at"))
    scope = (F.col("catalog_id") == F.lit(catalog_id)) & (F.col("used_on") >= F.lit(period[0])) & (F.col("used_on") < F.lit(period[1]))
    chosen = detections.where(scope)
    eligible, held = eligible_usage(chosen, disputes)
    asked = eligible.withColumn("usage_id", F.col("detection_id")).withColumn(
        "right_type", F.explode(F.array(*[F.lit(r) for r in right_types]))
    )
    frozen = usage_inputs(asked, weights, tariffs, sheets, recording_works)
    judged_sheets = recipient_errors(lines).select("split_sheet_id", F.size("errors").alias("_faults"))
    checked = salted_lookup(frozen, judged_sheets, ["split_sheet_id"], spread_by=["usage_id", "right_type"])
    missing = error_list(
        (F.col("weight").isNull(), "no_source_weight"),
        (F.col("tariff_id").isNull(), "no_tariff"),
        (F.col("split_sheet_id").isNull(), "no_active_split"),
        (F.col("split_sheet_id").isNotNull() & F.col("_faults").isNull(), "split_empty"),
        (F.col("_faults") > 0, "split_invalid"),
    )
    judged = cut(checked.withColumn("hold_reasons", missing).drop("_faults"))
    run = stable_id(F.lit(str(catalog_id)), F.lit(str(period[0])), F.lit(str(period[1])), F.lit(calculation_version))
    priced = gross(judged.where(F.size("hold_reasons") == 0).drop("hold_reasons")).withColumn("royalty_run_id", run)
    items = priced.withColumn("usage_item_id", stable_id("royalty_run_id", "detection_id", "right_type", "work_id"))
    allocations = allocate(items, lines).withColumn("allocation_id", stable_id("usage_item_id", "split_line_id"))
    columns = ["detection_id", "right_type", "work_id", "hold_reasons"]
    all_held = (
        held.withColumn("right_type", F.lit(None).cast("string"))
        .withColumn("work_id", F.lit(None).cast(judged.schema["work_id"].dataType))
        .select(*columns)
        .unionByName(judged.where(F.size("hold_reasons") > 0).select(*columns))
    )
    return {"usage_items": items, "allocations": allocations, "held": all_held}


def payout_batches(allocations: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payouts per run, provider and party; the allocation items inside each).

    Only approved, unheld allocations with an active account are paid. A party with
    several active accounts is paid into the one with the smallest id.
    """
    account = (
        accounts.where(F.col("status") == "active")
        .groupBy("party_id")
        .agg(F.min(F.struct("payment_account_id", "provider")).alias("a"))
        .select("party_id", "a.payment_account_id", "a.provider")
    )
    due = allocations.where(
        (F.col("status") == "approved") & ~F.coalesce("held", F.lit(False)) & (F.col("settled_amount") > 0)
    )
    items = salted_lookup(due, account, ["party_id"], spread_by=["allocation_id"], how="inner").select(
        "royalty_run_id",
        stable_id("royalty_run_id", "provider").alias("payout_batch_id"),
        stable_id("royalty_run_id", "provider", "party_id").alias("payout_id"),
        "provider",
        "party_id",
        "payment_account_id",
        "allocation_id",
        F.col("settled_amount").alias("amount_ugx"),
    )
    payouts = items.groupBy(
        "royalty_run_id", "payout_batch_id", "payout_id", "provider", "party_id", "payment_account_id"
    ).agg(F.sum("amount_ugx").alias("amount_ugx"), F.count(F.lit(1)).alias("items"))
    return payouts, items.select("payout_id", "allocation_id", "amount_ugx")


def party_statement(allocations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statement lines with their evidence, totals per party and status)."""
    rounding = (F.col("settled_amount") - F.col("raw_amount_ugx")).alias("rounding_ugx")
    evidence = [
        c
        for c in (
            "source_id", "used_on", "detected_seconds", "reference_seconds", "weight", "tariff_id",
            "base_rate_ugx", "split_sheet_id", "share_basis_points", "status",
        )
        if c in allocations.columns
    ]
    lines = allocations.select("party_id", "usage_id", *evidence, "raw_amount_ugx", "settled_amount", rounding)
    totals = allocations.groupBy("party_id", "status").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("settled_amount").alias("settled_amount")
    )
    return lines, totals
