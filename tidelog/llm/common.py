"""Helpers that the operators share: inputs, shared storage, byte-level words."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.  Only a session of one machine may leave that unset: then
    a local folder is taken, as executors elsewhere could not read each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidelog-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` to shared storage and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `written` made and nothing will read again."""
    spark, path = df.sparkSession, df._tidelog_path
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def text_bytes(text: str) -> Column:
    """The UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))


def row_key(text: str) -> Column:
    """Together with the id it tells rows apart whose texts differ."""
    return F.xxhash64(F.col(f"`{text}`"))


#: Copies of a table that is looked up by keys which most rows may share.
SALTS = 16


def looked_up(asking: DataFrame, table: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """asking joined with a table of distinct keys (null is one); rows of one key are dealt to tasks by `by`."""
    dealt = asking.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed(key, "__key")
    return dealt.join(copies, (F.col("__salt") == F.col("__copy")) & F.col(f"`{key}`").eqNullSafe(F.col("__key")), how).drop("__salt", "__copy", "__key")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def scan_schema(df: DataFrame, *added: str) -> str:
    """DDL of df's columns, then the added ones."""
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*own, *added])


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordTable(dict):
    """word -> index into growing arrays; `make(word)` gives the row of a new word.

    It is a cache: beyond `limit` words `trim` empties it between two batches, which
    changes no result."""

    def __init__(self, make, dtype, limit: int = 150_000):
        super().__init__()
        self.make, self.limit, self.n = make, limit, 0
        self.rows = np.zeros(1024, dtype)

    def __missing__(self, word):
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = self.make(word)
        self[word] = at = self.n
        self.n += 1
        return at

    def trim(self) -> None:
        if self.n > self.limit:
            self.clear()
            self.n = 0

    def look(self, words: list) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.rows[at]


#: An odd multiplier for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U64)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, base, U64))
    return out


def window_hashes(words: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width the hash of every window of that many consecutive values."""
    n = len(words)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum(words * powers(BASE, n), out=sums[1:])
        back = powers(BASE_INVERSE, n)
        return [mix((sums[k:] - sums[: n + 1 - k]) * back[: n + 1 - k]) if n >= k else np.zeros(0, U64) for k in widths]


class Words:
    """The words of several texts, one after another, by array operations on their bytes: `text` with one
    space behind each word, `cut` where each begins (and the end), `lengths` of the texts in words, `hashes`."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
        blank = (data == 32) | (data - np.uint8(9) < 5)
        after = blank.copy()
        after[:1] = False
        after[1:] &= ~blank[:-1]
        ends = np.flatnonzero(after)
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.lengths = np.diff(np.searchsorted(ends, text_ends), prepend=0)
        plain = np.where(blank, np.uint8(32), data)[~blank | after]
        self.text, self.bytes = plain.tobytes(), plain
        self.cut = np.append(0, np.flatnonzero(plain == 32) + 1)
        self.sums = np.zeros(len(plain) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum((plain.astype(U64) + U64(1)) * powers(BASE, len(plain))[: len(plain)], out=self.sums[1:])

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.hashes_of(self.cut[:-1], self.cut[1:] - 1)

    def hashes_of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of parts of the text, as word_hash gives them."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[begin]) * powers(BASE_INVERSE, len(self.bytes) + 1)[begin])

    def slice(self, at: int, n: int) -> bytes:
        return self.text[self.cut[at] : self.cut[at + n] - 1]


def word_hash(word: bytes) -> int:
    """The hash of one word."""
    total = 0
    for n, c in enumerate(word):
        total += (c + 1) * (POWERS[n] if n < len(POWERS) else pow(BASE, n, 1 << 64))
    x = total & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


POWERS, MASK = [pow(BASE, n, 1 << 64) for n in range(100)], (1 << 64) - 1


class Strings:
    """A set of hashes; most others are told by their low bits."""

    def __init__(self, ordered: np.ndarray):
        self.ordered, self.low = ordered, np.zeros(1 << 20, bool)
        self.low[(ordered & U64((1 << 20) - 1)).astype(np.int64)] = True

    def hold(self, values: np.ndarray) -> np.ndarray:
        out = self.low[(values & U64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = self.ordered[np.minimum(np.searchsorted(self.ordered, values[at]), len(self.ordered) - 1)] == values[at] if len(self.ordered) else False
        return out


#: Rows of an Arrow batch between Spark and Python, at most.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are so small that neither side of the pipe to Python holds
    many texts at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


_held: dict = {}


def held(key, make):
    """A worker's cache for `key`, kept from task to task.  A worker holds one at a time: the first
    use of another key frees it."""
    if key not in _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)  # a worker lives on, so give the memory back
        except (OSError, AttributeError):
            pass
        _held[key] = make()
    return _held[key]


def in_parts(batches, column: str, limit: int = 2_000_000):
    """Slices of Arrow batches whose binary `column` holds about `limit` bytes, or one row."""
    for batch in batches:
        sizes = np.array(pa.compute.binary_length(batch.column(column)).fill_null(0), np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


#: Tasks of a shuffle that deals out groups, at most; a task with several takes one at a time.
MOST_TASKS = 50_000


def dealt(df: DataFrame, group: str, groups: int, run, schema: str) -> DataFrame:
    """run(rows) over the rows of each group 0 .. groups - 1, where rows is an iterator of Arrow batches.
    Groups have a task each, or share MOST_TASKS tasks, in which they follow each other."""
    tasks = min(groups, MOST_TASKS)
    at = df.columns.index(group)

    def each(batches):
        held_batch: list = []

        def of_one():  # batches of one group, the first of another is held back
            first = held_batch.pop()
            own = first.column(at)[0].as_py()
            while True:
                column = first.column(at).to_numpy()
                end = int(np.searchsorted(column != own, True)) if column[-1] != own else len(column)
                yield first.slice(0, end)
                if end < len(column):
                    held_batch.append(first.slice(end))
                    return
                first = next((b for b in batches if b.num_rows), None)
                if first is None:
                    return
                if first.column(at)[0].as_py() != own:
                    held_batch.append(first)
                    return

        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            held_batch.append(first)
        while held_batch:
            rows = of_one()
            yield from run(rows)
            for _ in rows:  # what run has not read
                pass

    placed = df.repartitionById(tasks, F.col(group) if tasks == groups else F.pmod(F.col(group), F.lit(tasks)).cast("int"))
    if tasks < groups:
        placed = placed.sortWithinPartitions(group)
    return placed.mapInArrow(each, schema)
