"""The plans that large tables get: merge joins, a hot key, reused shuffles."""

import os
from contextlib import contextmanager

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.01"
DIMENSIONS = ["orders", "customer", "part", "supplier", "nation"]
NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "8",
}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    """A third of the line items go to one supplier and one part."""
    path = tmp_path_factory.mktemp("hot")
    hot = F.col("l_orderkey") % 3 == 0
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").withColumns(
        {c: F.when(hot, 7).otherwise(F.col(c)) for c in ("l_suppkey", "l_partkey")}
    )
    rows.repartition(8).write.parquet(f"{path}/lineitem.parquet")
    for table in DIMENSIONS:
        os.symlink(f"{SMALL}/{table}.parquet", f"{path}/{table}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def duck(hot_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{hot_dir}/lineitem.parquet/*.parquet'")
    for table in DIMENSIONS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize(
    "name, scans_share_joins",
    [
        ("salary_quantiles_two_phase", True),
        ("salary_range_by_role", True),
        ("salary_by_size", True),
        ("skill_premium", False),
        ("top_states_by_volume", False),
    ],
)
def test_hot_key_with_merge_joins(spark, hot_dir, duck, name, scans_share_joins):
    with settings(spark, NO_BROADCAST):
        df = entry.queries()[name](spark, hot_dir)
        ours = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    theirs = duck.sql(entry.oracle_sql()[name]).project(", ".join(sorted(df.columns))).fetchall()
    assert sorted(ours, key=str) == sorted(theirs, key=str)
    assert "SortMergeJoin(skew=true)" in final  # the hot key's partition was split
    if scans_share_joins:
        assert "ReusedExchange" in final
    # Broadcast are the country table and, for quantiles, the open bins.
    assert final.count("BroadcastHashJoin") <= 2 and "NestedLoop" not in final
