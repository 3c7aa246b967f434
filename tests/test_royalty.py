"""Worked examples of gross, split and rounding, and exactness against fractions."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spinledger.operators import effective, royalty

USAGE = "usage_id string, split_sheet_id string, base_rate_ugx decimal(18,4), weight decimal(12,6), detected_seconds decimal(10,3), reference_seconds decimal(10,3)"
LINES = "split_sheet_id string, split_line_id string, line_no int, party_id string, role string, share_basis_points int"


def lines_of(sheet, shares):
    return [(sheet, f"{sheet}-{i}", i, f"p{i}", "r", bp) for i, bp in enumerate(shares)]


def price(spark, rate, weight, detected, reference, shares, digits=0):
    row = [("u", "s", Decimal(rate), Decimal(weight), Decimal(detected), Decimal(reference))]
    usage = royalty.gross(spark.createDataFrame(row, USAGE), digits)
    lines = spark.createDataFrame(lines_of("s", shares), LINES)
    return usage, royalty.allocate(usage, lines, quantum_digits=digits)


@pytest.mark.parametrize(
    ("rate", "weight", "detected", "reference", "shares", "gross", "parts"),
    [
        ("1000", "2", "90", "180", [5000, 2500, 2500], 1000, [500, 250, 250]),
        ("5", "1", "1", "1", [3333, 3333, 3334], 5, [2, 1, 2]),
        ("1.5", "1", "1", "3", [10000], 1, [1]),
        ("1", "1", "1", "3", [5000, 5000], 0, [0, 0]),
        ("7", "1", "1", "1", [10000, 0], 7, [7, 0]),
    ],
)
def test_worked_examples(spark, rate, weight, detected, reference, shares, gross, parts):
    usage, allocated = price(spark, rate, weight, detected, reference, shares)
    assert usage.first().gross_settled == gross
    assert [r.settled_amount for r in allocated.orderBy("line_no").collect()] == parts


def test_hundredths(spark):
    usage, allocated = price(spark, "1", "1", "1", "3", [5000, 5000], digits=2)
    assert usage.first().gross_settled == 33
    assert [r.settled_amount for r in allocated.orderBy("line_no").collect()] == [17, 16]
    with pytest.raises(ValueError):
        royalty.gross(usage, -2)


def test_random_sheets_sum_to_gross(spark):
    rng = random.Random(9)
    usage_rows, line_rows, expected = [], [], {}
    for i in range(60):
        cuts = sorted(rng.sample(range(1, 10000), rng.randrange(0, 6)))
        shares = [b - a for a, b in zip([0, *cuts], [*cuts, 10000], strict=True)]
        rate, weight = Decimal(rng.randrange(1, 10**8)) / 10000, Decimal(rng.randrange(1, 10**7)) / 1000000
        detected, reference = Decimal(rng.randrange(1, 10**6)) / 1000, Decimal(rng.randrange(1, 10**6)) / 1000
        usage_rows.append((f"u{i}", f"s{i}", rate, weight, detected, reference))
        line_rows += lines_of(f"s{i}", shares)
        gross = Fraction(rate) * Fraction(weight) * Fraction(detected) / Fraction(reference)
        total = int(gross + Fraction(1, 2))
        raw = [gross * bp / 10000 for bp in shares]
        parts = [int(r) for r in raw]
        for k in sorted(range(len(raw)), key=lambda k: (-(raw[k] - parts[k]), k))[: total - sum(parts)]:
            parts[k] += 1
        expected[f"u{i}"] = parts
    usage = royalty.gross(spark.createDataFrame(usage_rows, USAGE))
    lines = spark.createDataFrame(line_rows, LINES)
    got = {}
    for r in royalty.allocate(usage, lines).orderBy("usage_id", "line_no").collect():
        got.setdefault(r.usage_id, []).append(r.settled_amount)
    assert got == expected
    long = royalty.largest_remainder(usage.join(lines, "split_sheet_id")).orderBy("usage_id", "line_no").collect()
    again = {}
    for r in long:
        again.setdefault(r.usage_id, []).append(r.settled_amount)
    assert again == expected


def test_invalid_sheets_are_refused(spark):
    rows = lines_of("short", [9999]) + lines_of("good", [6000, 4000]) + [
        ("twice", "x", 0, "p", "r", 5000), ("twice", "x", 1, "p", "r", 5000), ("far", "y", 0, "p", "r", 10001), ("far", "z", 1, "p", " ", -1),
    ]
    lines = spark.createDataFrame(rows, LINES)
    sound, refused = royalty.validate_recipients(lines)
    assert {r.split_sheet_id for r in sound.collect()} == {"good"}
    errors = {r.split_sheet_id: r.errors for r in refused.collect()}
    assert errors["short"] == ["split shares must total 10000 basis points, received 9999"]
    assert errors["twice"] == ["split line IDs must be unique within a calculation"]
    assert len(errors["far"]) == 2


def test_not_a_number_is_refused(spark):
    rows = spark.createDataFrame(
        [("u", "master", "NaN", "1", "1", "1"), ("v", "master", "1", "-1", "1", "0"), ("w", "master", "1", "1", "1", "1")],
        "usage_id string, right_type string, base_rate_ugx string, weight string, detected_seconds string, reference_seconds string",
    )
    errors = {r.usage_id: r.errors for r in royalty.validate_usage(rows).collect()}
    assert errors["u"] == ["base_rate_ugx must be finite"] and len(errors["v"]) == 2 and errors["w"] == []


def test_validity_is_inclusive_and_later_wins(spark):
    versions = spark.createDataFrame(
        [(1, "2024-01-01", "2024-06-30", 1.0), (1, "2024-06-30", None, 2.0), (2, "2024-03-01", "2024-03-31", 3.0)],
        "source_id int, valid_from string, valid_to string, weight double",
    ).withColumns({"valid_from": F.to_date("valid_from"), "valid_to": F.to_date("valid_to")})
    facts = spark.createDataFrame(
        [(1, 1, "2024-06-29"), (2, 1, "2024-06-30"), (3, 1, "2031-01-01"), (4, 1, "2023-12-31"), (5, 2, "2024-03-31"), (6, 2, "2024-04-01")],
        "usage_id int, source_id int, used_on string",
    ).withColumn("used_on", F.to_date("used_on"))
    got = {r.usage_id: r.weight for r in effective.effective_weight(facts, versions).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 2.0, 4: None, 5: 3.0, 6: None}
    plan = effective.effective_weight(facts, versions)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_equal_facts_stay_apart(spark):
    facts = spark.createDataFrame([("u", "s", "2026-02-01")] * 2 + [("v", "s", "2027-01-01")], "usage_id string, source_id string, used_on string")
    versions = spark.createDataFrame(
        [("w1", "s", "2026-01-01", None, 1), ("w2", "s", "2026-01-15", "2026-03-01", 2)],
        "weight_id string, source_id string, valid_from string, valid_to string, weight int",
    )
    dated = versions.withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")})
    found = effective.effective_weight(facts.withColumn("used_on", F.col("used_on").cast("date")), dated).collect()
    assert sorted((r.usage_id, r.weight) for r in found) == [("u", 2), ("u", 2), ("v", 1)]


def test_one_key_with_most_facts(spark):
    """A third of all facts of one source, most of them on one day: no version is copied and nothing is lost."""
    day = F.when(F.col("id") % 6 == 0, F.lit("2024-05-05")).otherwise(F.date_add(F.lit("2019-01-01").cast("date"), (F.col("id") % 3000).cast("int")))
    facts = spark.range(30_000).select(
        F.col("id").alias("usage_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string"))).alias("source_id"), day.cast("date").alias("used_on")
    )
    versions = spark.range(500 * 4).select(
        F.when(F.col("id") % 500 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string"))).alias("source_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 500).cast("int") * 400).alias("valid_from"),
        F.when(F.col("id") < 500, F.lit("2020-12-31").cast("date")).alias("valid_to"), F.col("id").alias("weight"),
    )
    found = effective.effective_weight(facts, versions)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 1  # the two ends of each version, as points
    expected = facts.join(versions, (facts.source_id == versions.source_id) & (F.col("used_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("used_on") <= F.col("valid_to"))), "left")
    latest = expected.groupBy("usage_id").agg(F.max_by("weight", "valid_from").alias("weight"))
    assert found.count() == 30_000 and found.select("usage_id", "weight").exceptAll(latest).count() == 0


def test_extra_decimals_are_refused(spark):
    schema = "usage_id string, right_type string, base_rate_ugx string, weight string, detected_seconds string, reference_seconds string"
    rows = spark.createDataFrame([("a", "master", "0.00004", "1", "1", "1"), ("b", "master", "0.00010", "1.0000001", "1.0005", "1e1"), ("c", "master", "1.5", "0.25", "1.125", "3")], schema)
    errors = {r.usage_id: r.errors for r in royalty.validate_usage(rows).collect()}
    assert errors == {
        "a": ["base_rate_ugx has more than 4 decimal places"],
        "b": ["weight has more than 6 decimal places", "detected_seconds has more than 3 decimal places"],
        "c": [],
    }
    with pytest.raises(Exception, match="more than [46] decimal places"):
        royalty.gross(rows).collect()
    exact = royalty.gross(rows.where("usage_id = 'c'")).first()
    assert exact.gross_settled == 0 and exact.gross_raw_ugx == Decimal("0.14062500")


def test_every_linked_work_has_its_sheet(spark):
    sheets = spark.createDataFrame(
        [("m", "r", None, "master"), ("w1", None, "x", "composition"), ("w2", None, "y", "composition")],
        "split_sheet_id string, recording_id string, work_id string, right_type string",
    ).withColumns({"status": F.lit("active"), "valid_from": F.lit("2024-01-01").cast("date"), "valid_to": F.lit(None).cast("date")})
    works = spark.createDataFrame([("r", "x"), ("r", "y"), ("r", "z")], "recording_id string, work_id string")
    usage = spark.createDataFrame([("u", "r", "master"), ("u", "r", "composition"), ("v", "q", "composition")], "usage_id string, recording_id string, right_type string")
    found = effective.active_split(usage.withColumn("used_on", F.lit("2024-02-01").cast("date")), sheets, works).collect()
    assert {(r.usage_id, r.work_id, r.split_sheet_id) for r in found} == {("u", None, "m"), ("u", "x", "w1"), ("u", "y", "w2"), ("u", "z", None), ("v", None, None)}
    assert len(found) == 5
