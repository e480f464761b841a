"""Consistent hashing: ring, routing, distribution, moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schemas import VNODES

SLOTS = 4096
WIDTH = (1 << 31) // SLOTS


def key_hash(key: Column) -> Column:
    """The low 31 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 25, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)


def ring(spark: SparkSession, nodes: int, vnodes: int = VNODES) -> DataFrame:
    """pos, node; where two points meet, the later node holds the position."""
    points = spark.range(nodes).select(F.col("id").cast("int").alias("node")).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))))
    name = F.concat(F.lit("node_"), F.col("node").cast("string"), F.lit("_vnode_"), F.col("v").cast("string"))
    return points.select("node", key_hash(name).alias("pos")).groupBy("pos").agg(F.max("node").alias("node"))


def lookup_table(ring_: DataFrame) -> DataFrame:
    """slot, points: for each of SLOTS stretches of the ring the points in it, in order, and the one
    after it; the ring's first point follows its last."""
    packed = ring_.agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("all"))
    slots = packed.select("all", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))).alias("slot"))
    low, high = F.col("slot") * WIDTH, (F.col("slot") + 1) * WIDTH
    inside = F.filter("all", lambda p: (p["pos"] >= low) & (p["pos"] < high))
    after = F.coalesce(F.get(F.filter("all", lambda p: p["pos"] >= high), F.lit(0)), F.get("all", F.lit(0)))
    return slots.select("slot", inside.alias("points"), after["node"].alias("next_node"))


def route(keys: DataFrame, ring_: DataFrame) -> DataFrame:
    """keys with node: the first point at or after the key's hash, else the ring's first.

    The ring is cut into a fixed number of slots, a table of that many rows, whose broadcast is
    bounded by the cluster's size and not by the keys; a key meets the few points of its slot and
    is not shuffled."""
    table = F.broadcast(lookup_table(ring_).select(F.col("slot").alias("__slot"), "points", "next_node"))
    hashed = keys.withColumn("__h", key_hash(F.col("key")))
    joined = hashed.join(table, F.floor(F.col("__h") / WIDTH) == F.col("__slot"))
    inside = F.get(F.filter("points", lambda p: p["pos"] >= F.col("__h")), F.lit(0))
    return joined.select(*keys.columns, F.coalesce(inside["node"], F.col("next_node")).alias("node"))


def distribution(keys: DataFrame, ring_: DataFrame) -> DataFrame:
    return route(keys.select("key"), ring_).groupBy("node").agg(F.count("*").alias("n"))


def moves(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """from_node, to_node, n: keys that move when the ring changes."""
    a = route(keys.select("key"), before).withColumnRenamed("node", "from_node")
    both = route(a, after).withColumnRenamed("node", "to_node")
    return both.where("from_node <> to_node").groupBy("from_node", "to_node").agg(F.count("*").alias("n"))


def gathered_keys(shards: list[DataFrame]) -> DataFrame:
    """The shards' key lists one after another, duplicates kept."""
    out = shards[0].select("key")
    for s in shards[1:]:
        out = out.union(s.select("key"))
    return out
