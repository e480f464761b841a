"""Keyed state from an ordered log of PUT and DEL rows.

A log has columns seq (unique), op, key and value.  The row with the greatest seq of a key
wins; a DEL, or a PUT of an empty value, means that the key is absent.  Filters on key are pushed to
the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schemas import SCAN_COUNT_DEFAULT, SCAN_COUNT_MAX


def is_live(op: str = "op", value: str = "value") -> Column:
    """An empty value is a tombstone."""
    return (F.col(op) == "PUT") & (F.octet_length(value) > 0)


def valid(log: DataFrame) -> DataFrame:
    """Rows with an empty or null key are rejected."""
    return log.where(F.octet_length("key") > 0)


def latest(log: DataFrame, unique_seq: bool = True) -> DataFrame:
    """key, op, value, seq: each key's last row, tombstones included.

    With a unique seq the greatest seq of each key is found first, by a hash aggregation over two
    narrow columns that reduces rows before they are shuffled, and the rows with these seqs are
    picked by a semi-join: without a shuffle of the log where the seqs can be broadcast, else with
    one by seq, which no key can skew.  Carrying rows through max_by shuffles them but once, but its
    buffers of strings need a sort of the log; `unique_seq=False` does so, and must where rows may
    come twice (replays), as a key's rows with one seq are all returned otherwise."""
    rows = log.select("key", "op", "value", "seq")
    if not unique_seq:
        return rows.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("s")).select("key", "s.*")
    last = rows.groupBy("key").agg(F.max("seq").alias("seq")).select("seq")
    return rows.join(last, "seq", "left_semi").select("key", "op", "value", "seq")


def current_state(log: DataFrame, unique_seq: bool = True) -> DataFrame:
    """key, value, seq of the live keys."""
    return latest(log, unique_seq).where(is_live()).select("key", "value", "seq")


def get(log: DataFrame, key: str) -> DataFrame:
    return current_state(log.where(F.col("key") == key))


def get_many(log: DataFrame, keys: DataFrame) -> DataFrame:
    """A row for each requested key; value is null on a miss.  keys has a column key."""
    return keys.join(current_state(log.join(keys.distinct(), "key", "left_semi")), "key", "left")


def lookup_status(log: DataFrame, keys: DataFrame) -> DataFrame:
    """status of each key: 0 found, -1 never written, -2 deleted."""
    found = latest(log.join(keys.distinct(), "key", "left_semi"))
    status = F.when(F.col("op").isNull(), -1).when(is_live(), 0).otherwise(-2)
    return keys.join(found, "key", "left").select("key", status.alias("status"))


def between(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Closed bounds; one that is None or empty does not bind; reversed bounds give nothing."""
    if start:
        rows = rows.where(F.col("key") >= start)
    if end:
        rows = rows.where(F.col("key") <= end)
    return rows


def scan(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Live keys within the bounds, in byte order of key."""
    return current_state(between(log, start, end)).orderBy("key")


def scan_limit(log: DataFrame, start: str | None, end: str | None, limit: int = 100) -> DataFrame:
    return scan(log, start, end).limit(limit)


def page_size(count: int | None) -> int:
    return SCAN_COUNT_DEFAULT if count is None or count <= 0 else min(count, SCAN_COUNT_MAX)


def scan_page(log: DataFrame, cursor: int = 0, count: int | None = None) -> DataFrame:
    """pos, key, value, next_cursor: a page of the ordered keys from a linear cursor.

    One key more than the page is taken, which tells whether a next page exists; the plan is a
    top-k over cursor + count + 1 rows, not a global window."""
    size, cursor = page_size(count), max(cursor, 0)
    page = current_state(log).orderBy("key").offset(cursor).limit(size + 1)
    rows = page.agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("r"))  # at most 1001 rows
    after = F.when(F.size("r") > size, F.lit(cursor + size)).otherwise(F.lit(0)).cast("long")
    got = rows.select(F.posexplode(F.slice("r", 1, size)).alias("i", "e"), after.alias("next_cursor"))
    return got.select((F.col("i") + F.lit(cursor + 1)).cast("long").alias("pos"), "e.key", "e.value", "next_cursor")


def scan_after(log: DataFrame, last_key: str | None, count: int | None = None) -> DataFrame:
    """Keyset paging: the page after a key.  Its cost does not grow with the page number."""
    rows = log if last_key is None else log.where(F.col("key") > last_key)
    return current_state(rows).orderBy("key").limit(page_size(count))


def write_sorted(log: DataFrame, path: str) -> DataFrame:
    """Live rows in files by key range, each row with its file's number and its place in the file."""
    rows = current_state(log).repartitionByRange("key").sortWithinPartitions("key")
    place = F.monotonically_increasing_id()  # the number of the partition above 33 bits of the place in it
    rows.select("key", "value", "seq", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")).write.parquet(path)
    return log.sparkSession.read.parquet(path)


def numbered_pages(rows: DataFrame, count: int | None = None) -> DataFrame:
    """page, pos, key, value, seq of all rows that write_sorted wrote: the pages of a whole walk in one plan.
    Only the files' row counts are numbered in one task, not the rows."""
    size = page_size(count)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    pos = F.col("offset") + F.col("place")
    return rows.join(F.broadcast(offsets), "part").select(F.expr(f"(offset + place) div {size}").alias("page"), pos.alias("pos"), "key", "value", "seq")


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a stored log.  Each call adds files; readers see a whole call or nothing of it."""
    valid(rows.select("seq", "op", "key", "value")).write.mode("append").parquet(path)


def hide(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with column hidden: entries of a memory table that were removed by a flag stay counted."""
    gone = keys.select("key").distinct().withColumn("hidden", F.lit(True))
    return rows.join(gone, "key", "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))


def apply_puts(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with PUTs of rows (key, value, seq) appended."""
    return log.select("seq", "op", "key", "value").unionByName(valid(rows.where("value is not null")).select("seq", F.lit("PUT").alias("op"), "key", "value"))


def apply_deletes(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with tombstones for rows (key, seq) appended, whether or not the keys exist."""
    return log.select("seq", "op", "key", "value").unionByName(valid(rows).select("seq", F.lit("DEL").alias("op"), "key", F.lit(None).cast("string").alias("value")))


def flush_all(log: DataFrame) -> DataFrame:
    """The log with a tombstone for every live key; all tombstones follow the last row."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    live = current_state(log)
    # seq + last is unique and after every row, and needs no numbering of the live keys.
    dels = live.join(F.broadcast(last)).select(F.col("key"), (F.col("seq") + F.col("last") + 1).alias("seq"))
    return apply_deletes(log, dels)


def tombstone_counts(log: DataFrame) -> DataFrame:
    """n_all, n_live, n_tombstones over the last row of every key."""
    return latest(log).agg(F.count("*").alias("n_all"), F.count_if(is_live()).alias("n_live"), F.count_if(~F.coalesce(is_live(), F.lit(False))).alias("n_tombstones"))


def memory_stats(log: DataFrame) -> DataFrame:
    """entries (with tombstones) and bytes of keys and values that a memory table would hold."""
    return latest(log).agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).cast("long").alias("bytes"))
