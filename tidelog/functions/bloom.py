"""Bloom filters with double hashing, built in partial filters that are merged.

Each task folds its keys into one filter; filters of one size are or-ed.  The bits are a
parameter, so what is merged and broadcast has a fixed size; `sized` takes them from a count of the keys.
Keys beyond MOST_KEYS (a filter of 120 MB at 1 %) are for filters by segment, not for one.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.codecs import key_hashes

LN2, MOST_KEYS = 0.69314718056, 100_000_000


def params(n: int, p: float) -> tuple[int, int]:
    """Bits (rounded up to bytes) and number of hashes."""
    if n <= 0 or p >= 1:
        raise ValueError("a filter needs keys and a rate below 1")
    bits = (int(-n * math.log(p) / (LN2 * LN2)) + 7) & ~7
    return bits, max(1, int(bits * LN2 / n))


def sized(keys: DataFrame, p: float = 0.01) -> tuple[int, int]:
    """Bits and hashes for the keys that there are."""
    n = keys.where("key is not null").count()
    if n > MOST_KEYS:
        raise ValueError(f"{n} keys are too many for one filter; build one a segment")
    return params(max(n, 1), p)


def params_columns(n: Column, p: Column) -> tuple[Column, Column]:
    raw = F.floor(-n * F.log(p) / F.lit(LN2 * LN2)).cast("long")
    bits = F.floor((raw + 7) / 8).cast("long") * 8
    return bits, F.greatest(F.floor(bits * F.lit(LN2) / n), F.lit(1)).cast("long")


def positions(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    a, b = key_hashes(keys)
    i = np.arange(hashes, dtype=np.uint32)
    with np.errstate(over="ignore"):
        return ((a[:, None] + i * b[:, None]).astype(np.uint32) % np.uint32(bits)).astype(np.int64)


def serialize(bits: int, hashes: int, body: bytes) -> bytes:
    return struct.pack("<QI", bits, hashes) + body


def deserialize(raw: bytes) -> tuple[int, int, bytes]:
    bits, hashes = struct.unpack_from("<QI", raw)
    body = raw[12:]
    if len(body) < (bits + 7) // 8:
        raise ValueError("truncated filter")
    return bits, hashes, body[: (bits + 7) // 8]


def build(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """filter: one row, the serialized filter over column key."""

    def partial(batches):
        body = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = np.unique(positions([k.encode() for k in batch.column(0).to_pylist() if k is not None], bits, hashes))
            np.bitwise_or.at(body, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([body.tobytes()], pa.binary())], ["body"])

    def merge(batches):
        body = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for x in batch.column(0):
                body |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([serialize(bits, hashes, body.tobytes())], pa.binary())], ["filter"])

    parts = keys.select("key").mapInArrow(partial, "body binary")
    # Two levels: a task never merges more than the square root of all partial filters.
    some = parts.repartition(max(1, int(keys.sparkSession.sparkContext.defaultParallelism**0.5))).mapInArrow(merge, "filter binary").select(F.expr("substring(filter, 13)").alias("body"))
    return some.coalesce(1).mapInArrow(merge, "filter binary")


def may_contain(raw: bytes, key: Column) -> Column:
    """Probe a serialized filter."""
    bits, hashes, body = deserialize(raw)

    @F.pandas_udf("boolean")
    def probe(keys: pd.Series) -> pd.Series:
        at = positions([k.encode() for k in keys.fillna("")], bits, hashes)
        own = np.frombuffer(body, np.uint8)
        return pd.Series(((own[at >> 3] >> (at & 7)) & 1).all(axis=1))

    return probe(key)
