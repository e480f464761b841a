"""Labelled documents: the fold that may be learned from, and a bounded sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that are only for measuring: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Bytes of the texts of a sample, about: the row that exceeds them is the last.
MOST_BYTES = 128 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, text: str = "text", most_bytes: int = MOST_BYTES) -> list[tuple[bytes, int]]:
    """(text, label) pairs outside the held-out fold, those whose ids hash lowest: at most `limit`, and as many as
    have `most_bytes` together.  They come to the driver."""
    picked = labels.select("doc_id", F.col(f"`{label}`").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    picked = picked.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).join(F.broadcast(picked), "doc_id")  # `limit` rows
    # Rows that share an id could otherwise exceed the bound.
    found = rows.groupBy("doc_id").agg(F.min(F.struct("t", "y")).alias("r")).select("doc_id", "r.t", "r.y")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # of `limit` rows
    kept = found.withColumn("before", F.coalesce(F.sum(F.octet_length("t").cast("long")).over(before), F.lit(0))).where(F.col("before") < most_bytes)
    return sorted((r.t.encode("utf-8", "replace"), int(r.y)) for r in kept.select("t", "y").collect())
