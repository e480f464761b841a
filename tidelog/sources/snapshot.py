"""Snapshot files: the files of a store, packed one after another.

A snapshot file is: last index u64, last term u64; for each file name length u32, name, size u64,
bytes; 0 as u32.  All little-endian.  Names follow each other in order.  A node's snapshot is one
file, which one task packs or unpacks; it is sent in chunks (see operators.replication).
"""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "last_included_index long, last_included_term long, name string, content binary"


def pack_files(index: int, term: int, files) -> bytes:
    """files: (name, bytes) pairs."""
    out = [struct.pack("<QQ", index, term)]
    for name, content in files:
        raw = name.encode()
        out += [struct.pack("<I", len(raw)), raw, struct.pack("<Q", len(content)), bytes(content)]
    return b"".join([*out, struct.pack("<I", 0)])


def unpack_files(raw: bytes):
    """(index, term, name, bytes) of the files; one that is cut short, and what follows, is left out."""
    if len(raw) < 16:
        return
    index, term = struct.unpack_from("<QQ", raw)
    at = 16
    while at + 4 <= len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        if n == 0 or at + 12 + n > len(raw):
            return
        (size,) = struct.unpack_from("<Q", raw, at + 4 + n)
        begin = at + 12 + n
        if begin + size > len(raw):
            return
        yield index, term, raw[at + 4 : at + 4 + n].decode("utf-8", "replace"), raw[begin : begin + size]
        at = begin + size


def pack(files: DataFrame, index: int, term: int) -> DataFrame:
    """node, content: a snapshot file for each node from its files (node, name, content)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "content": [pack_files(index, term, zip(pdf["name"], pdf["content"]))]})

    kind = files.schema["node"].dataType.simpleString()
    return files.select("node", "name", "content").groupBy("node").applyInPandas(one, f"node {kind}, content binary")


def unpack(snapshots: DataFrame) -> DataFrame:
    """node and the files of each snapshot file (node, content)."""
    kind = snapshots.schema["node"].dataType.simpleString()
    names = ["last_included_index", "last_included_term", "name", "content"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches):
        for batch in batches:
            for i, raw in enumerate(batch.column(1)):
                for row in unpack_files(raw.as_py()):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x], t) for x, t in zip(row, types))], ["node", *names])

    return snapshots.select("node", "content").mapInArrow(run, f"node {kind}, {SCHEMA}")
