"""Frames of the server protocol: arrays of bulk strings to argument lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ARRAY, MAX_BULK = 256, 1 << 20


def parse_value(raw: bytes, at: int = 0):
    """(value, next offset); None for a null; raises ValueError on a broken frame."""
    end = raw.find(b"\r\n", at)
    if end < 0:
        raise ValueError("no line end")
    kind, line, at = raw[at : at + 1], raw[at + 1 : end], end + 2
    if kind in (b"+", b"-"):
        return line.decode("utf-8", "replace"), at
    if kind == b":":
        return int(line), at
    if kind == b"$":
        n = int(line)
        if n < 0:
            return None, at
        if n > MAX_BULK or raw[at + n : at + n + 2] != b"\r\n":
            raise ValueError("broken bulk string")
        return raw[at : at + n].decode("utf-8", "replace"), at + n + 2
    if kind == b"*":
        n = int(line)
        if n < 0:
            return None, at
        if n > MAX_ARRAY:
            raise ValueError("array too long")
        out = []
        for _ in range(n):
            value, at = parse_value(raw, at)
            out.append(value)
        return out, at
    raise ValueError("unknown type")


def parse_frame(raw: bytes) -> list | None:
    """argv of a command frame; None if it is broken or not an array."""
    try:
        value, _ = parse_value(bytes(raw))
    except (ValueError, TypeError):
        return None
    return [None if v is None else str(v) for v in value] if isinstance(value, list) else None


def parse_command(frame: Column) -> Column:
    @F.pandas_udf("array<string>")
    def parsed(frames: pd.Series) -> pd.Series:
        return frames.map(parse_frame)

    return parsed(frame)


def encode_command(*args: Column) -> Column:
    """A frame from string columns."""
    parts = [F.concat(F.lit("$"), F.octet_length(a).cast("string"), F.lit("\r\n"), a, F.lit("\r\n")) for a in args]
    return F.concat(F.lit(f"*{len(args)}\r\n"), *parts).cast("binary")
