"""Operational counters, ratios, rates, sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import with_previous


def op_counters(log: DataFrame, reads: DataFrame) -> DataFrame:
    """puts_total, deletes_total, gets_total (hits only), get_misses_total.  reads has column hit."""
    writes = log.agg(F.count_if(F.col("op") == "PUT").alias("puts_total"), F.count_if(F.col("op") == "DEL").alias("deletes_total"))
    gets = reads.agg(F.count_if("hit").alias("gets_total"), F.count_if(~F.col("hit")).alias("get_misses_total"))
    return writes.join(F.broadcast(gets))  # one row each


def hit_ratio(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count("*").alias("reads"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count("*"), 6).alias("ratio"))


def engine_stats(log: DataFrame, manifest: DataFrame, unflushed: DataFrame, wal: bool = True) -> DataFrame:
    """memtable_size, sstable_count, total_keys (puts less deletes: an estimate), wal_enabled."""
    keys = log.agg((F.count_if(F.col("op") == "PUT") - F.count_if(F.col("op") == "DEL")).alias("total_keys"))
    used = unflushed.agg(F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).cast("long").alias("memtable_size"))
    files = manifest.agg(F.count("*").alias("sstable_count"))
    return used.join(F.broadcast(files)).join(F.broadcast(keys)).withColumn("wal_enabled", F.lit(int(wal)))


def rate(samples: DataFrame) -> DataFrame:
    """name, bucket, per_bucket: growth of a cumulative counter since its last sample, per unit; null for the first."""
    prev = with_previous(samples, "name", ["bucket"], F.expr("bucket div 10000"), pt="total", pb="bucket")
    return prev.select("name", "bucket", F.round((F.col("total") - F.col("pt")) / (F.col("bucket") - F.col("pb")), 6).alias("per_bucket"))


def pivot(samples: DataFrame, names: list[str]) -> DataFrame:
    """A row a node, a column a metric; the names are given, so no job looks for them."""
    return samples.groupBy("node").pivot("name", names).agg(F.max("value"))


#: Fixed names, kinds and help texts of the exposition format, in its order.
EXPOSED = (
    ("kv_uptime_seconds", "gauge", "Server uptime in seconds"),
    ("kv_puts_total", "counter", "Total number of PUT operations"),
    ("kv_gets_total", "counter", "Total number of GET operations (hits)"),
    ("kv_get_misses_total", "counter", "Total number of GET misses"),
    ("kv_deletes_total", "counter", "Total number of DELETE operations"),
    ("kv_scans_total", "counter", "Total number of SCAN operations"),
    ("kv_compactions_total", "counter", "Total number of compaction runs"),
    ("raft_state", "gauge", "Current Raft state (0=Follower, 1=Candidate, 2=Leader, -1=unknown)"),
    ("raft_term", "gauge", "Current Raft term"),
    ("raft_commit_index", "gauge", "Raft commit index"),
    ("raft_last_applied", "gauge", "Raft last applied index"),
    ("raft_is_leader", "gauge", "1 if this node is the leader"),
    ("raft_log_count", "gauge", "Number of committed log entries"),
    ("raft_snapshot_index", "gauge", "Last included index in snapshot (0=no snapshot)"),
)


def prometheus_text(stats: DataFrame) -> DataFrame:
    """node, body: a row's metrics (a column each, those of EXPOSED that it has) as text."""
    parts = [F.concat(F.lit(f"# HELP {n} {h}\n# TYPE {n} {k}\n{n} "), F.col(n).cast("string"), F.lit("\n")) for n, k, h in EXPOSED if n in stats.columns]
    return stats.select("node", F.concat_ws("\n", *parts).alias("body"))


def sweep_ok(sweep: DataFrame) -> DataFrame:
    return sweep.where("status = 'OK'")


def sweep_means(sweep: DataFrame, by: str = "memtable_kb", metric: str = "write_ops") -> DataFrame:
    return sweep_ok(sweep).groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(metric), 4).alias("mean"))


def sweep_best(sweep: DataFrame, by: str = "memtable_kb", metric: str = "write_ops") -> DataFrame:
    return sweep_ok(sweep).agg(F.max_by(by, F.struct(metric, by)).alias(by), F.max(metric).alias("best"))


def run_average(runs: DataFrame) -> DataFrame:
    """config, n_runs, ops: mean of operations by mean of time; zero time gives zero."""
    t, n = F.avg("seconds"), F.avg("entries")
    return runs.groupBy("config").agg(F.count("*").alias("n_runs"), F.round(F.when(t > 0, n / t).otherwise(F.lit(0.0)), 4).alias("ops"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
