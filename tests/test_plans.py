"""Plans keep the shape that they were designed with."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import history, replication, segments, shard, state


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "t")
    spark.range(5000).select(F.col("id").alias("seq"), F.lit("PUT").alias("op"), F.concat(F.lit("k"), F.col("id") % 700).alias("key"), F.lit("v").alias("value"), F.lit("x" * 40).alias("wide")).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_state_needs_no_sort_aggregate_or_window(log):
    p = plan(state.current_state(log))
    assert "SortAggregate" not in p and "Window" not in p and "wide" not in p
    assert "HashAggregate" in p


def test_point_reads_push_the_key_to_the_scan(log):
    p = plan(state.get(log, "k17"))
    assert p.count("EqualTo(key,k17)") == p.count("FileScan")
    assert plan(state.scan(log, "k1", "k2")).count("GreaterThanOrEqual(key,k1)") >= 2


def test_pages_are_top_k(log):
    for df in (state.scan_page(log, 20, 10), state.scan_limit(log, "k1", None), state.scan_after(log, "k3")):
        assert "TakeOrderedAndProject" in plan(df) and "Window" not in plan(df)


def test_routing_does_not_shuffle_keys(spark, log):
    keys = log.select("key")
    p = plan(shard.route(keys, shard.ring(spark, 3)))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "Cartesian" not in p and "NestedLoop" not in p


def test_asof_is_no_range_join(spark):
    h = spark.createDataFrame([], "seq long, key string, op string, value string, start_us long, end_us long, success boolean, result string")
    p = plan(history.register_violations(h))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_merge_needs_no_sort_aggregate(log):
    seg = log.withColumn("file_id", (F.col("seq") % 5)).withColumn("level", F.lit(0))
    p = plan(segments.merge(seg))
    assert "SortAggregate" not in p
    assert "SortAggregate" not in plan(segments.compact_all(seg))


def test_apply_committed_is_filtered_at_the_scan(log):
    raft = log.withColumnRenamed("seq", "idx")
    assert "GreaterThan(seq,10)" in plan(replication.apply_committed(raft, 10, 400))
