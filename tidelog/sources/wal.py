"""Write-ahead log files: encoding, ordered replay, torn tails.

A record is: length u32, type u8 (1 PUT, 2 DEL), key length u32, key, value length u32, value,
CRC-32 u32 over what stands between length and CRC; all little-endian.  Replay of a file stops
at its first torn or damaged record and goes on with the next file.  A file (100 MiB at most)
is decoded by one task.
"""

from __future__ import annotations

import struct
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"PUT": 1, "DEL": 2}
NAMES = {v: k for k, v in TYPES.items()}
SCHEMA = "file_seq long, pos long, op string, key string, value string"


def encode_record(op: str, key: bytes, value: bytes | None) -> bytes:
    if not key:
        raise ValueError("a key may not be empty")
    value = value or b""
    body = struct.pack("<BI", TYPES[op], len(key)) + key + struct.pack("<I", len(value)) + value
    return struct.pack("<I", len(body) + 4) + body + struct.pack("<I", crc32(body))


def decode_records(raw: bytes):
    """(op, key, value) of the valid prefix; an empty value is None."""
    at = 0
    while at + 4 <= len(raw):
        (size,) = struct.unpack_from("<I", raw, at)
        record = raw[at + 4 : at + 4 + size]
        if len(record) < size or size < 13 or struct.unpack_from("<I", record, size - 4)[0] != crc32(record[:-4]):
            return
        kind, klen = struct.unpack_from("<BI", record)
        (vlen,) = struct.unpack_from("<I", record, 5 + klen)
        value = record[9 + klen : 9 + klen + vlen]
        yield NAMES.get(kind, "PUT"), record[5 : 5 + klen], value or None
        at += 4 + size


def encode(log: DataFrame) -> DataFrame:
    """file_seq, content: one row a file from rows (file_seq, seq, op, key, value), by seq."""

    def pack(pdf):
        import pandas as pd

        pdf = pdf.sort_values("seq")
        parts = [encode_record(op, k.encode(), None if v is None else v.encode()) for op, k, v in zip(pdf["op"], pdf["key"], pdf["value"].where(pdf["value"].notna(), None))]
        return pd.DataFrame({"file_seq": [pdf["file_seq"].iloc[0]], "content": [b"".join(parts)]})

    return log.select("file_seq", "seq", "op", "key", "value").groupBy("file_seq").applyInPandas(pack, "file_seq long, content binary")


def replay(files: DataFrame) -> DataFrame:
    """file_seq, pos, op, key, value of files (file_seq, content); order by file_seq and pos."""

    def run(batches):
        for batch in batches:
            for seq, raw in zip(batch.column(0), batch.column(1)):
                rows = [(seq.as_py(), i, op, k.decode("utf-8", "replace"), None if v is None else v.decode("utf-8", "replace")) for i, (op, k, v) in enumerate(decode_records(raw.as_py()))]
                for i in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[i : i + 10_000]))
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file_seq", "pos", "op", "key", "value"])

    return files.select("file_seq", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Replay a directory of wal_<n>.log files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "wal_*.log").load(path)
    return replay(files.select(F.regexp_extract("path", r"wal_(\d+)\.log$", 1).cast("long").alias("file_seq"), "content"))


def truncate(records: DataFrame, pos: int) -> DataFrame:
    """Records before a position in their file."""
    return records.where(F.col("pos") < pos)


def record_bytes():
    """Size of a record in a file, from its columns."""
    return F.lit(17) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
