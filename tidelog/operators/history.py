"""Checks of operation histories: registers, compare-and-set, increments.

Writes before a read end at or before its start; writes beside it overlap it, bounds included;
a write that ends exactly when the read starts is both.  Ties of end time are broken by seq.
The as-of lookup is a union of writes and probes with one ordered window per key (range) and
not a range join, so it costs one shuffle and one sort however many writes a key has.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ordered import folded, with_previous


def successful(history: DataFrame) -> DataFrame:
    return history.where("success")


def asof(probes: DataFrame, writes: DataFrame, stretch_us: int = 3_600_000_000) -> DataFrame:
    """probes with last_value, last_end_us, last_seq: the write of the key with the greatest
    (end_us, seq) that ended at or before the probe's start.  Keys: key; times: start_us, end_us.

    Ordered windows run within stretches of time; the last write of each stretch is carried to
    the later ones by a window over one row a stretch.  So a busy key is dealt to many tasks."""
    names = probes.columns
    w = writes.select("key", F.col("end_us").alias("__t"), F.lit(0).alias("__kind"), F.col("seq").alias("__s"), F.struct("end_us", "seq", "value").alias("__w"))
    p = probes.select("key", F.col("start_us").alias("__t"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__s"), F.struct(*names).alias("__p"))
    both = w.unionByName(p, allowMissingColumns=True).withColumn("__part", F.expr(f"__t div {stretch_us}"))
    upto = Window.partitionBy("key", "__part").orderBy("__t", "__kind", "__s").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("key", "__part").agg(F.max("__w").alias("__m")).select("key", "__part", F.max("__m").over(before).alias("__carried"))
    near = both.withColumn("__near", F.last("__w", ignorenulls=True).over(upto)).where("__kind = 1")
    seen = near.join(ends, ["key", "__part"]).withColumn("__last", F.coalesce("__near", "__carried"))
    return seen.select("__p.*", F.col("__last.value").alias("last_value"), F.col("__last.end_us").alias("last_end_us"), F.col("__last.seq").alias("last_seq"))


def overlapping(probes: DataFrame, writes: DataFrame, bucket_us: int = 60_000_000, fan: int = 64, within: DataFrame | None = None) -> DataFrame:
    """seq, write_seq: writes of the probe's key that overlap it.  Both sides are cut into time
    buckets, so the join is on key and bucket; a pair is kept in the bucket where it begins.

    Buckets have levels, each `fan` times as wide as the one below.  An operation is cut at the level where it
    spans at most `fan` buckets and at the wider ones, and a pair meets at the level of its longer
    operation; so one that stays open for long has few rows.  The longest operation sets the highest
    level, mostly the first; it is looked for in `within`, which holds both sides, if that is given."""
    lasted = F.coalesce(F.max(F.col("end_us") - F.col("start_us")), F.lit(0)).alias("d")
    sides = [within] if within is not None else [probes, writes]
    longest = max(side.agg(lasted).first()[0] for side in sides)
    top = 0
    while longest > bucket_us * fan ** (top + 1):
        top += 1
    sizes = [bucket_us * fan**k for k in range(top + 1)]
    size = F.element_at(F.array(*[F.lit(x).cast("long") for x in sizes]), F.col("level") + 1)
    own = sum((F.col("end_us") - F.col("start_us") > x * fan).cast("int") for x in sizes[:top]) if top else F.lit(0)

    def cut(df):
        levels = df.withColumn("own", own).withColumn("level", F.explode(F.sequence(F.col("own"), F.lit(top)))).withColumn("size", size)
        a, b = F.expr("start_us div size"), F.expr("end_us div size")
        return levels.withColumn("bucket", F.explode(F.sequence(a, F.greatest(a, b))))

    w = cut(writes).select("key", "level", "bucket", F.col("own").alias("w_own"), F.col("start_us").alias("w_start"), F.col("end_us").alias("w_end"), F.col("seq").alias("write_seq"), F.col("value").alias("w_value"))
    hit = (F.col("w_start") <= F.col("end_us")) & (F.col("w_end") >= F.col("start_us")) & (F.col("level") == F.greatest("own", "w_own")) & (F.col("bucket") == F.expr("greatest(start_us, w_start) div size"))
    return cut(probes).join(w, ["key", "level", "bucket"]).where(hit)


def register_violations(history: DataFrame) -> DataFrame:
    """Successful reads whose value neither the last write before nor a write beside them wrote."""
    ok = successful(history)
    reads = ok.where("op = 'get'").select("seq", "key", "start_us", "end_us", "result")
    writes = ok.where("op = 'put'").select("seq", "key", "start_us", "end_us", "value")
    suspect = asof(reads, writes).where("last_value is null or last_value <> result")
    beside = overlapping(suspect, writes, within=ok).where("w_value = result").select("seq").distinct()
    return suspect.join(beside, "seq", "left_anti").select("seq", "key", "result", "last_value")


def cas_violations(history: DataFrame) -> DataFrame:
    """Compare-and-sets that succeeded although the last write before them differs."""
    cas = history.where("op = 'cas' and result = 'true'").select("seq", "key", "start_us", "end_us", "value")
    writes = history.where("op = 'put' and success").select("seq", "key", "start_us", "end_us", "value")
    expected = F.when(F.instr("value", "->") > 0, F.split("value", "->")[0]).otherwise(F.lit(""))
    return asof(cas, writes).withColumn("expected", expected).where("last_seq is not null and value <> '' and last_value <> expected").select("seq", "key", "expected", "last_value")


def numeric(x: Column) -> Column:
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("long"))


def increments(history: DataFrame) -> DataFrame:
    return successful(history).where("op = 'inc'").withColumn("v", numeric(F.col("result"))).where("v is not null")


def increment_falls(history: DataFrame) -> DataFrame:
    """Increments whose result is less than the one before it, per key."""
    rows = with_previous(increments(history), "key", ["end_us", "seq"], F.expr("end_us div 3600000000"), prev="v")
    return rows.where("v < prev").select("seq", "key", "prev", "v")


def reads_above_increments(history: DataFrame) -> DataFrame:
    """Numeric reads greater than the number of successful increments of their key."""
    total = increments(history).groupBy("key").agg(F.count("*").alias("n"))
    reads = successful(history).where("op = 'get'").withColumn("v", numeric(F.col("result"))).where("v is not null")
    return reads.join(total, "key").where("v > n").select("seq", "key", "v", "n")


def throughput(history: DataFrame) -> DataFrame:
    """op, n, ok, error_rate, ops_per_sec by span of time."""
    span = (F.max("end_us") - F.min("start_us")) / 1e6
    agg = history.groupBy("op").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), span.alias("s"))
    return agg.select("op", "n", "ok", F.round(1 - F.col("ok") / F.col("n"), 6).alias("error_rate"), F.round(F.col("n") / F.greatest("s", F.lit(0.001)), 6).alias("ops_per_sec"))


def apply_register_ops(history: DataFrame) -> DataFrame:
    """seq, applied, value: a register's value after each put, inc and cas, in order of (end_us,
    seq).  Read-modify-write is a fold, so each key is folded in one ordered pass."""
    def begin():
        now = None

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal now
            out = []
            for op, value in zip(pdf["op"], pdf["value"]):
                done = True
                if op == "put":
                    now = value
                elif op == "inc":
                    now = str((int(now) if now and now.isdigit() else 0) + 1)
                else:
                    expected, arrow, new = (value or "").partition("->")
                    done = bool(arrow) and (now or "") == expected
                    now = new if done else now
                out.append((done, now))
            return pd.DataFrame({"seq": pdf["seq"].to_numpy(), "key": pdf["key"].to_numpy(), "applied": [a for a, _ in out], "value": [b for _, b in out]})

        return step

    rows = successful(history).where("op in ('put', 'inc', 'cas')").select("seq", "key", "op", "value", "end_us")
    return folded(rows, "key", ["end_us", "seq"], begin, "seq long, key string, applied boolean, value string")
