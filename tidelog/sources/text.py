"""Text formats: file catalog, metrics, benchmark reports, sweeps, histories, test reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schemas

MANIFEST_LINE = r"^file=(\d+),level=(\d+),size=(\d+),smallest=([0-9a-f]*),largest=([0-9a-f]*)$"


def manifest_lines(manifest: DataFrame) -> DataFrame:
    """line: the text of catalog rows, keys in hexadecimal."""
    hexed = [F.lower(F.hex(F.col(c).cast("binary"))) for c in ("smallest", "largest")]
    return manifest.select(F.format_string("file=%d,level=%d,size=%d,smallest=%s,largest=%s", "file_id", "level", "file_size", *hexed).alias("line"))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Catalog rows from lines; others (version, next file) are left out."""
    g = [F.regexp_extract("line", MANIFEST_LINE, i) for i in range(1, 6)]
    return lines.where(F.col("line").rlike(MANIFEST_LINE)).select(
        g[0].cast("long").alias("file_id"), g[1].cast("int").alias("level"), g[2].cast("long").alias("file_size"),
        F.unhex(g[3]).cast("string").alias("smallest"), F.unhex(g[4]).cast("string").alias("largest"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path).toDF("line"))


def parse_metrics(lines: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and name, value of `name value` lines; comments and what is not a number are
    left out."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines.where(~F.trim("line").startswith("#")).select(*keep, F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).try_cast("double").alias("value"))
    return rows.where("value is not null")


def parse_benchmark(lines: DataFrame) -> DataFrame:
    """One row of seven figures from a benchmark's report lines (column line)."""

    def last(pattern: str, kind: str):
        return F.coalesce(F.max(F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1).try_cast(kind))), F.lit(0).cast(kind))

    return lines.agg(
        last(r"Write.*?([\d.]+) ops/sec", "double").alias("write_ops_per_sec"), last(r"Write.*?cost ([\d.]+) sec,", "double").alias("write_time_sec"),
        last(r"Read.*random.*?hit (\d+)", "long").alias("read_hits"), last(r"Read.*random.*?miss (\d+)", "long").alias("read_misses"),
        last(r"Read.*random.*?cost ([\d.]+) sec", "double").alias("read_time_sec"), last(r"Scan all keys[^:]*:\s*(\d+)", "long").alias("scan_count"),
        last(r":\s*(\d+)[^:]*errors found", "long").alias("verify_errors"),
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HISTORY).json(path)


def write_history(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").json(path)


def read_snapshot_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SNAPSHOT_META).json(path)


def health_json(stats: DataFrame) -> DataFrame:
    """body of the health endpoint, fields in their fixed order."""
    fields = ("role", "raft_term", "raft_commit_index", "raft_applied_index", "last_snapshot_index", "memtable_size", "sstable_count", "total_keys", "wal_enabled")
    return stats.select(F.to_json(F.struct(F.lit("ok").alias("status"), *fields)).alias("body"))


def junit_cases(results: DataFrame) -> DataFrame:
    """A test case element a row, from results (name, ok, ops, failures)."""
    return results.select(F.col("name").alias("_name"), F.lit("HistoryCheck").alias("_classname"), F.when(~F.col("ok"), F.struct(F.lit("LinearizabilityViolation").alias("_type"), F.concat(F.lit("ops="), "ops", F.lit(", failures="), "failures").alias("_VALUE"))).alias("failure"))


def write_junit(results: DataFrame, path: str) -> None:
    junit_cases(results).write.mode("overwrite").format("xml").option("rootTag", "testsuite").option("rowTag", "testcase").save(path)


def junit_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("tests"), F.count_if(~F.col("ok")).alias("failures"), F.lit(0).alias("errors"))
