"""Scalar codecs and hashes of the storage format."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the file format.
CODECS = {"none": 0, "zstd": 1, "lz4": 2}
PACKERS = {1: "zstd", 2: "lz4_raw"}
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193
FEW_KEYS = 16


def codec_id(name: Column) -> Column:
    """Unknown names, and null, mean zstd."""
    return F.when(name == "none", CODECS["none"]).when(name == "lz4", CODECS["lz4"]).otherwise(CODECS["zstd"])


def codec_name(codec: Column) -> Column:
    return F.when(codec == 0, "none").when(codec == 1, "zstd").when(codec == 2, "lz4").otherwise("unknown")


def varint_length(x: Column) -> Column:
    """Bytes of an unsigned LEB128 number: seven bits a byte."""
    out = F.lit(10)
    for k in range(9, 0, -1):
        out = F.when(F.shiftrightunsigned(x.cast("long"), 7 * k) == 0, F.lit(k)).otherwise(out)
    return out


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x.cast("binary")))


def from_hex(x: Column) -> Column:
    return F.unhex(x).cast("string")


def padded_key(prefix: str, i: Column, width: int = 8) -> Column:
    return F.format_string(f"{prefix}%0{width}d", i)


def encode_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def decode_varint(raw: bytes, at: int = 0) -> tuple[int, int]:
    """Value and the offset after it."""
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def compress(codec: Column, content: Column) -> Column:
    """A block as its codec (by number) packs it."""

    @F.pandas_udf("binary")
    def packed(ids: pd.Series, blocks: pd.Series) -> pd.Series:
        return pd.Series([bytes(b) if i == 0 else pa.Codec(PACKERS[i]).compress(b, asbytes=True) for i, b in zip(ids, blocks)])

    return packed(codec, content)


def decompress(codec: Column, content: Column, size: Column) -> Column:
    """A packed block as it was; its size is known from the block's header."""

    @F.pandas_udf("binary")
    def unpacked(ids: pd.Series, blocks: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([bytes(b) if i == 0 else pa.Codec(PACKERS[i]).decompress(b, decompressed_size=int(n), asbytes=True) for i, b, n in zip(ids, blocks, sizes)])

    return unpacked(codec, content, size)


def compress_bound(codec: Column, size: Column) -> Column:
    """The most bytes that a block of a size can take, by the bounds of the two formats."""
    zstd = size + F.shiftright(size, 8) + F.when(size < 131072, F.shiftright(131072 - size, 11)).otherwise(0)
    return F.when(codec == CODECS["none"], size).when(codec == CODECS["lz4"], size + F.floor(size / 255) + 16).otherwise(zstd).cast("long")


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a and times-33 hashes of 32 bits, a character of all keys at a time, over the keys one after
    another; memory is that of the keys.  The last characters of the few longest keys are taken in turn.
    Characters are signed, so those from 0x80 on enter with their sign extended."""
    a, b = np.full(len(keys), FNV_OFFSET, np.uint32), np.zeros(len(keys), np.uint32)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(-sizes, kind="stable")
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.frombuffer(b"".join(keys), np.int8)
    ends, j = sizes[order], 0
    while True:
        live = int(np.searchsorted(-ends, -j, "left"))  # keys with more than j characters
        if live <= FEW_KEYS:
            break
        own = order[:live]
        c = flat[begin[own] + j].astype(np.int32).view(np.uint32)
        a[own] = (a[own] ^ c) * np.uint32(FNV_PRIME)
        b[own] = b[own] * np.uint32(33) + c
        j += 1
    for i in order[:live].tolist():
        x, y = int(a[i]), int(b[i])
        for c in flat[begin[i] + j : begin[i] + sizes[i]].tolist():
            x = (x ^ (c & 0xFFFFFFFF)) * FNV_PRIME & 0xFFFFFFFF
            y = (y * 33 + c) & 0xFFFFFFFF
        a[i], b[i] = x, y
    return a, b


def _hash_column(which: int, key: Column) -> Column:
    @F.pandas_udf("long")
    def hashed(keys: pd.Series) -> pd.Series:
        return pd.Series(key_hashes([k.encode() for k in keys.fillna("")])[which].astype(np.int64))

    return hashed(key)


def fnv1a(key: Column) -> Column:
    return _hash_column(0, key)


def times33(key: Column) -> Column:
    return _hash_column(1, key)
