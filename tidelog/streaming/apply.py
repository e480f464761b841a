"""Logs as streams: state per key, a durable state table, windowed metrics.

The state of a key is the row with its greatest seq, so files may come in any order and again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog import schemas
from tidelog.operators import state


def read_log(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schemas.OP_LOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_state(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Live keys in a memory table, by an aggregate whose state is one row a key."""
    agg = log.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("s")).select("key", "s.*")
    live = agg.where(state.is_live()).select("key", "value", "seq")
    return live.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_changes(log: DataFrame) -> DataFrame:
    """key, op, value, seq: a row whenever a key's newest row changes.  Rows at or below the seq
    that a key has seen are ignored, so replays change nothing."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], own: GroupState) -> Iterator[pd.DataFrame]:
        seen = own.get[0] if own.exists else -1
        best = None
        for pdf in parts:
            newer = pdf[pdf["seq"] > seen]
            if len(newer):
                best = newer.loc[newer["seq"].idxmax()]
                seen = int(best["seq"])
        if best is not None:
            own.update((seen,))
            yield pd.DataFrame({"key": [key[0]], "op": [best["op"]], "value": [best["value"]], "seq": [seen]})

    return log.groupBy("key").applyInPandasWithState(fold, "key string, op string, value string, seq long", "seq long", "update", GroupStateTimeout.NoTimeout)


def maintain_table(log: DataFrame, path: str, checkpoint: str, merge_every: int = 16) -> StreamingQuery:
    """A stored state that follows the log: each micro-batch adds its keys' last rows as a delta, and every
    `merge_every` batches the deltas are merged into a new base, so a batch costs what it holds.

    Deltas and bases carry their batch's number and count once they are complete; a repeated batch
    writes its own again.  What a base replaced stays until the next merge, for readers that have begun."""

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = state.latest(batch, unique_seq=False)
        if (epoch + 1) % merge_every:
            rows.write.mode("overwrite").parquet(f"{path}/delta={epoch}")
            return
        spark = batch.sparkSession
        old = read_table(spark, path, before=epoch)
        state.latest(rows if old is None else rows.unionByName(old), unique_seq=False).write.mode("overwrite").parquet(f"{path}/base={epoch}")
        _drop(spark, path, epoch - merge_every)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _complete(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the complete bases and deltas, read from the file system."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {"base": [], "delta": []}
    for status in fs.listStatus(root) if fs.exists(root) else ():
        kind, eq, number = status.getPath().getName().partition("=")
        if eq and kind in out and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out[kind].append(int(number))
    return out


def _drop(spark: SparkSession, path: str, upto: int) -> None:
    """Delete bases before number `upto` and deltas up to it: a base of that number or a later one holds them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, numbers in _complete(spark, path).items():
        for n in numbers:
            if n < upto or n == upto and kind == "delta":
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}"), True)


def read_table(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """key, op, value, seq: last rows of all keys after the newest complete batch (below `before`), or None."""
    found = {k: sorted(n for n in v if before is None or n < before) for k, v in _complete(spark, path).items()}
    base = found["base"][-1:]
    parts = [f"{path}/base={n}" for n in base] + [f"{path}/delta={n}" for n in found["delta"] if not base or n > base[0]]
    if not parts:
        return None
    rows = spark.read.parquet(*parts) if len(parts) > 1 else spark.read.parquet(parts[0])
    return state.latest(rows, unique_seq=False)


def windowed(samples: DataFrame, seconds: int = 5, late: str = "1 minute") -> DataFrame:
    """start, name, n, total: tumbling windows over event time, with a watermark on streams."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    return rows.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "name").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "name", "n", "total")
