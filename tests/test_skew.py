"""Lookups in dimensions that grow."""

import pytest
from pyspark.sql import functions as F

from spinledger.functions.skew import salted_lookup
from suite.projections import Tables
from suite.q_audits import ledger


@pytest.mark.parametrize("salts", [1, 8])
def test_a_growing_dimension_is_not_broadcast_by_its_compressed_size(spark, tmp_path, salts):
    path = str(tmp_path / "dims")
    spark.range(300_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("v")).coalesce(1).write.parquet(path)
    dims = spark.read.parquet(path)
    facts = spark.range(1_000).select((F.col("id") * 7).alias("fact"), (F.col("id") % 3 * 150_000).alias("k"))
    found = salted_lookup(facts, dims, ["k"], spread_by=["fact"], salts=salts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    met = {r["fact"]: r["v"] for r in found.collect()}
    wanted = {r["k"]: r["v"] for r in dims.where(F.col("k").isin(0, 150_000, 300_000)).collect()}
    assert len(met) == 1_000 and all(v == wanted.get(f // 7 % 3 * 150_000) for f, v in met.items())


def test_a_small_dimension_is_still_broadcast(spark, tmp_path):
    path = str(tmp_path / "dims")
    spark.range(25).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v")).coalesce(1).write.parquet(path)
    facts = spark.range(1_000_000).select(F.col("id").alias("fact"), (F.col("id") % 25).alias("k"))
    found = salted_lookup(facts, spark.read.parquet(path), ["k"], spread_by=["fact"])
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert found.where(F.col("v") == F.col("k") + 1).count() == 1_000_000


def test_split_lines_of_allocations_are_not_broadcast(spark, tmp_path):
    """Lines are exploded from recordings, which Spark's size check counts as one row each."""
    source = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{source}/part.parquet")
    shifted = parts.crossJoin(spark.range(20).withColumnRenamed("id", "k")).withColumn("p_partkey", F.expr("p_partkey + k * 1000000")).drop("k")
    shifted.write.parquet(str(tmp_path / "part.parquet"))
    for name in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{source}/{name}.parquet")
    lines = ledger(Tables(spark, str(tmp_path)))["royalty_allocations"]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    joins = [step for step in plan.splitlines() if "Join" in step and "line_no" in step]
    assert joins and all("SortMergeJoin" in step for step in joins)
