"""Sorted segments (files) in levels: bounds, merging, compaction, flush batches.

A segment row has file_id, level, seq, op, key, value.  Recency is always seq, which compaction
keeps, never the order of files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators import state
from tidelog.operators.ordered import folded
from tidelog.schemas import L0_FILE_LIMIT, L1_BYTES, MAX_LEVELS, MEMTABLE_BYTES


def row_bytes() -> Column:
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))


def manifest(segments: DataFrame) -> DataFrame:
    """file_id, level, file_size, smallest, largest."""
    return segments.groupBy("file_id", "level").agg(F.sum(row_bytes()).cast("long").alias("file_size"), F.min("key").alias("smallest"), F.max("key").alias("largest"))


def add_files(catalog: DataFrame, files: DataFrame) -> DataFrame:
    return catalog.unionByName(files)


def remove_files(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids.select("file_id"), "file_id", "left_anti")


def list_files(catalog: DataFrame, level: int = -1) -> DataFrame:
    """Files of a level, or of all for a negative one."""
    return catalog if level < 0 else catalog.where(F.col("level") == level)


def next_file_id(catalog: DataFrame) -> DataFrame:
    return catalog.agg((F.coalesce(F.max("file_id"), F.lit(0)) + 1).alias("next_file_id"))


def segment_scan(segments: DataFrame, file_id: int) -> DataFrame:
    """A file's entries, one a key, in key order; tombstones included."""
    return state.latest(segments.where(F.col("file_id") == file_id)).select("key", "op", "value").orderBy("key")


def merge(segments: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """All runs and levels as one state: a union, then the newest row of each key."""
    return state.current_state(state.between(segments, start, end))


def level_usage(segments: DataFrame) -> DataFrame:
    """level, files, bytes, triggered: level 0 by its number of files, others by their bytes."""
    used = manifest(segments).groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").cast("long").alias("bytes"))
    limit = F.lit(float(L1_BYTES)) * F.pow(F.lit(10.0), F.col("level") - 1)
    hit = F.when(F.col("level") == 0, F.col("files") >= L0_FILE_LIMIT).when(F.col("level") < MAX_LEVELS, F.col("bytes") >= limit).otherwise(False)
    return used.withColumn("triggered", hit)


def compact_level(segments: DataFrame, level: int, drop_tombstones: bool = False, new_file: int | None = None) -> DataFrame:
    """Segments after files of `level` and the next were merged into one file of the next.

    Tombstones stay unless the caller says that nothing older lies below."""
    mine = F.col("level").isin(level, level + 1)
    rows = segments.select("file_id", "level", "seq", "op", "key", "value")
    merged = state.latest(rows.where(mine))
    if drop_tombstones:
        merged = merged.where(state.is_live())
    file_id = F.lit(new_file).cast("long") if new_file is not None else F.lit(-(level + 1)).cast("long")
    return rows.where(~mine).unionByName(merged.select(file_id.alias("file_id"), F.lit(level + 1).cast("int").alias("level"), "seq", "op", "key", "value"))


def compact_all(segments: DataFrame, bottom: int = MAX_LEVELS - 1) -> DataFrame:
    """One file at the bottom level.  Merging level by level keeps each key's newest row at every
    step, so one aggregation gives the same."""
    merged = state.latest(segments)
    return merged.select(F.lit(-bottom).cast("long").alias("file_id"), F.lit(bottom).cast("int").alias("level"), "seq", "op", "key", "value")


def poll(segments: DataFrame) -> DataFrame:
    """What the scheduler leaves behind after one look: if a level's usage triggers it, everything merged to the
    bottom, level by level; else the segments as they are."""
    due = level_usage(segments).agg(F.bool_or("triggered")).first()[0]
    return compact_all(segments) if due else segments.select("file_id", "level", "seq", "op", "key", "value")


def write_segments(rows: DataFrame, path: str, codec: str = "zstd") -> None:
    """Sorted files by key range; footers hold each file's bounds, which prune point reads."""
    rows.repartitionByRange("key").sortWithinPartitions("key", "seq").write.mode("append").option("compression", codec).parquet(path)


def read_footers(spark: SparkSession, path: str) -> DataFrame:
    """file, n_rows, smallest, largest of segment files, from the statistics in their footers."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column(0), batch.column(1)):
                meta = pq.ParquetFile(pa.BufferReader(raw.as_buffer())).metadata
                at = [meta.row_group(0).column(i).path_in_schema for i in range(meta.num_columns)].index("key") if meta.num_row_groups else 0
                stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
                rows.append((name.as_py(), meta.num_rows, min((x.min for x in stats), default=None), max((x.max for x in stats), default=None)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["file", "n_rows", "smallest", "largest"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, n_rows long, smallest string, largest string")


def prune(manifest_: DataFrame, key: str) -> DataFrame:
    """Files whose bounds admit a key."""
    return manifest_.where((F.col("smallest") <= key) & (F.col("largest") >= key))


def order_violations(segments: DataFrame) -> DataFrame:
    """Rows of a file that come after a row with a greater key."""
    w = Window.partitionBy("file_id").orderBy("seq")
    return segments.withColumn("prev_key", F.lag("key").over(w)).where("key < prev_key").select("file_id", "seq", "key", "prev_key")


def shared_prefix(a: Column, b: Column) -> Column:
    """Bytes that two strings share at their start."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    ha, hb = F.hex(a.cast("binary")), F.hex(b.cast("binary"))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(ha, i * 2 - 1, F.lit(2)) == F.substring(hb, i * 2 - 1, F.lit(2)))
    first = F.array_position(same, F.lit(False))
    return F.when(a.isNull() | b.isNull() | (n == 0), F.lit(0)).otherwise(F.when(first > 0, first - 1).otherwise(n)).cast("int")


def prefix_lengths(segments: DataFrame) -> DataFrame:
    """file_id, key, shared: prefix that an entry shares with the one before it in its file; each
    16th entry of a file restarts with none."""
    w = Window.partitionBy("file_id").orderBy("key")
    entries = segments.select("file_id", "key").distinct().withColumn("prev", F.lag("key").over(w)).withColumn("i", F.row_number().over(w) - 1)
    return entries.select("file_id", "key", F.when(F.col("i") % 16 == 0, F.lit(0)).otherwise(shared_prefix(F.col("prev"), F.col("key"))).alias("shared"))


def flush_batches(log: DataFrame, limit: int = MEMTABLE_BYTES, partition: str = "part") -> DataFrame:
    """seq, batch: which flush takes each row.  The running bytes restart from zero at each flush,
    so rows are folded in order, per partition of the log (a store's own log)."""

    def begin():
        batch = used = 0

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal batch, used
            upto = np.cumsum(pdf["bytes"].to_numpy())
            out, at, before = np.empty(len(pdf), np.int64), 0, 0
            while at < len(pdf):
                end = int(np.searchsorted(upto, limit - used + before)) + 1  # with the row that reaches the limit
                out[at:end] = batch
                if end > len(pdf):
                    used += int(upto[-1]) - before
                    break
                batch, used, at, before = batch + 1, 0, max(end, at + 1), int(upto[end - 1])
            return pd.DataFrame({partition: pdf[partition], "seq": pdf["seq"], "batch": out})

        return step

    sized = log.select(partition, "seq", row_bytes().cast("long").alias("bytes"))
    kind = sized.schema[partition].dataType.simpleString()
    return folded(sized, partition, ["seq"], begin, f"{partition} {kind}, seq long, batch long")
