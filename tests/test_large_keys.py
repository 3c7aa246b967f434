"""Queries over tables whose keys go beyond a million, against their SQL."""

import duckdb
import pytest

from suite import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["activation_outcomes", "activated_sheets", "next_version"])
def test_recordings_beyond_a_million(spark, tmp_path, name):
    con = duckdb.connect()
    listed = "select i as p_partkey, 'title ' || i as p_name, 'b' as p_brand, cast(i % 50 as int) as p_size from (select unnest(range({}, {})) as i)"
    con.execute(f"create table part as {listed.format(1, 301)} union all {listed.format(999_900, 1_000_200)}")
    con.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, result.fetchall()))
