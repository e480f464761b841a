"""Comparing states: replicas, backups, snapshots, expected data, key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import state


def diff(reference: DataFrame, other: DataFrame) -> DataFrame:
    """key, status (only_ref, only_this, value_diff), ref_value, this_value: differing keys."""
    a, b = reference.select("key", F.col("value").alias("ref_value")), other.select("key", F.col("value").alias("this_value"))
    joined = a.join(b, "key", "full_outer")
    status = F.when(F.col("this_value").isNull(), "only_ref").when(F.col("ref_value").isNull(), "only_this").when(F.col("ref_value") != F.col("this_value"), "value_diff")
    return joined.withColumn("status", status).where("status is not null").select("key", "status", "ref_value", "this_value")


def first_differences(reference: DataFrame, other: DataFrame, n: int = 5) -> DataFrame:
    return diff(reference, other).orderBy("key").limit(n)


def pairwise_equal(states: dict[int, DataFrame]) -> DataFrame:
    """node_a, node_b, differing, equal for each pair of nodes.

    One pass: values are gathered per key over all nodes, and each pair compares two entries."""
    nodes = sorted(states)
    rows = reduce(DataFrame.unionByName, [s.select(F.lit(n).alias("node"), "key", "value") for n, s in states.items()])
    wide = rows.groupBy("key").pivot("node", nodes).agg(F.max("value"))
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]
    cols = [F.count_if(~F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"d_{a}_{b}") for a, b in pairs]
    stacked = ", ".join(f"{a}, {b}, d_{a}_{b}" for a, b in pairs)
    return wide.agg(*cols).selectExpr(f"stack({len(pairs)}, {stacked}) as (node_a, node_b, differing)").withColumn("equal", F.col("differing") == 0)


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """outcome (match, mismatch, missing), n."""
    joined = expected.select("key", F.col("value").alias("want")).join(actual.select("key", F.col("value").alias("got")), "key", "left")
    outcome = F.when(F.col("got").isNull(), "missing").when(F.col("want") == F.col("got"), "match").otherwise("mismatch")
    return joined.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def recovery(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """found, missing, first_missing (least idx), percent; expected has idx and key."""
    joined = expected.join(actual.select("key", F.lit(True).alias("there")), "key", "left")
    gone = F.col("there").isNull()
    return joined.agg(
        F.count_if(~gone).alias("found"), F.count_if(gone).alias("missing"),
        F.min(F.when(gone, F.col("idx"))).alias("first_missing"), F.round(100 * F.count_if(~gone) / F.count("*"), 6).alias("percent"),
    )


def coverage(expected: DataFrame, actual: DataFrame, least: float = 95.0) -> DataFrame:
    """n_expected, n_found, percent, passed."""
    joined = expected.select("key").distinct().join(actual.select("key", F.lit(1).alias("there")), "key", "left")
    got = joined.agg(F.count("*").alias("n_expected"), F.count("there").alias("n_found"))
    return got.withColumn("percent", F.round(100 * F.col("n_found") / F.col("n_expected"), 6)).withColumn("passed", F.col("percent") >= least)


def keys_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, key: keys that only one of the two has."""
    left = a.select("key").join(b.select("key"), "key", "left_anti").select(F.lit("only_a").alias("side"), "key")
    return left.unionByName(b.select("key").join(a.select("key"), "key", "left_anti").select(F.lit("only_b").alias("side"), "key"))


def keys_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, same: keys of both, and whether the values agree."""
    return a.select("key", F.col("value").alias("va")).join(b.select("key", F.col("value").alias("vb")), "key").select("key", F.col("va").eqNullSafe(F.col("vb")).alias("same"))


def snapshot(log: DataFrame, seq: int, flushed_upto: int | None = None) -> DataFrame:
    """State as of a seq; with `flushed_upto`, without the rows that were still in memory then."""
    upto = seq if flushed_upto is None else min(seq, flushed_upto)
    return state.current_state(log.where(F.col("seq") <= upto))


def backup(log: DataFrame, path: str) -> None:
    """Write the resolved log (tombstones included), sorted by key."""
    state.latest(log).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)
