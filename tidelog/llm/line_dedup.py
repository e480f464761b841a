"""Removal of lines that many documents share.

Keys of lines (white space stripped, A-Z lower-cased) are counted by 128-bit hash.  The
hashes found in enough documents are dealt to shards; each shard gets a minimal perfect hash
over its distinct line hashes, and arrays of fingerprints, counts and keeping documents in
the order of that hash.  Documents probe these arrays; no line is joined.  While all arrays
together stay below `broadcast_limit` bytes every task holds them.  Beyond it the hashes of a
document's lines travel to the shards, in salted parts so that a frequent line loads no single
task, and the line numbers to drop travel back; both ways give the same rows.

A null or empty text is one empty line.  Rows are documents, so a key in two rows with one id
counts twice, and all rows with the largest id keep it.  A null id sorts below all others.  A
key repeated in one document counts once; where its document keeps it, all its lines stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import U64, binary, in_parts, mix, partitions, row_key, scan_schema, small_batches, text_bytes, written

STRIP = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 200_000
SALTS = 16
LOWEST = -(1 << 63)


def long_lines(raw: bytes, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """All lines; numbers and 16-byte hashes of those whose key has `min_chars` code points."""
    lines = raw.split(b"\n")
    at, keys = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(STRIP).lower()  # of bytes: A-Z alone
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                at.append(i)
                keys.append(xxhash.xxh3_128_digest(key))
    return lines, at, keys


def split_hash(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit values.

    Level by level each value that is alone in its slot of a bit array is settled; its index is
    the rank of its bit over all levels, so indexes run from 0 to n-1."""

    LOAD = 0.6

    def __init__(self, words: list[np.ndarray], sizes: list[int]):
        self.words, self.sizes = words, sizes
        self.before = []
        total = 0
        for w in words:
            counts = np.bitwise_count(w).astype(np.int64)
            self.before.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())
        self.n = total

    @staticmethod
    def _slot(x: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(x + U64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, values: np.ndarray) -> PerfectHash:
        left, words, sizes = np.unique(values), [], []
        while len(left):
            size = -(-int(len(left) / cls.LOAD + 64) // 64) * 64
            slot = cls._slot(left, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(U64))
            sizes.append(size)
            left = left[~alone[slot]]
        return cls(words, sizes)

    def index(self, values: np.ndarray) -> np.ndarray:
        """Of each value its index; for a value that was not built in, some index or -1."""
        out = np.full(len(values), -1, np.int64)
        todo = np.arange(len(values))
        for level, (w, size, before) in enumerate(zip(self.words, self.sizes, self.before)):
            slot = self._slot(values[todo], level, size)
            word, bit = w[slot >> 6], (slot & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            low = word[hit] & ((U64(1) << bit[hit]) - U64(1))
            out[todo[hit]] = before[slot[hit] >> 6] + np.bitwise_count(low)
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def pack_shard(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, keeper: np.ndarray) -> bytes:
    ph = PerfectHash.build(lo.view(U64))
    # Two keys with one low half: the second half still tells them apart, so keep them in a list.
    place = ph.index(lo.view(U64))
    first = np.full(ph.n, -1, np.int64)
    first[place[::-1]] = np.arange(len(lo))[::-1]
    extra = np.setdiff1d(np.arange(len(lo)), first)
    head = np.array([len(ph.sizes), ph.n, len(extra), *ph.sizes], "<i8")
    arrays = [head, *ph.words]
    for order in (first, extra):
        arrays += [lo[order], hi[order], counts[order], keeper[order]]
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


class Shard:
    def __init__(self, blob: bytes):
        all_ = np.frombuffer(blob, "<i8")
        levels, n, extra = map(int, all_[:3])
        sizes = all_[3 : 3 + levels].tolist()
        at, words = 3 + levels, []
        for size in sizes:
            words.append(all_[at : at + size // 64].view(U64))
            at += size // 64
        self.hash = PerfectHash(words, sizes)
        self.main = [all_[at + i * n : at + (i + 1) * n] for i in range(4)]
        at += 4 * n
        self.extra = [all_[at + i * extra : at + (i + 1) * extra] for i in range(4)]

    def dropped(self, hi: np.ndarray, lo: np.ndarray, doc: np.ndarray, min_docs: int) -> np.ndarray:
        """Which probes are frequent lines of a document that does not keep them."""
        out = np.zeros(len(lo), bool)
        if self.hash.n:
            at = self.hash.index(lo)
            ok = at >= 0
            s_lo, s_hi, counts, keeper = (a[at[ok]] for a in self.main)
            out[ok] = (s_lo.view(U64) == lo[ok]) & (s_hi.view(U64) == hi[ok]) & (counts >= min_docs) & (keeper != doc[ok])
        for s_lo, s_hi, count, keeper in zip(*self.extra):
            out |= (lo.view(np.int64) == s_lo) & (hi.view(np.int64) == s_hi) & (count >= min_docs) & (keeper != doc)
        return out


def shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return (hi % U64(shards)).astype(np.int64)


def frequent_lines(docs: DataFrame, text: str, min_chars: int, min_docs: int) -> DataFrame:
    """hi, lo, docs, keeper: hashes of the line keys that `min_docs` documents hold."""

    def count(batches):
        for batch in in_parts(batches, "raw", 8_000_000):
            keys, owner = [], []
            for doc, raw in zip(batch.column("id"), batch.column("raw")):
                own = set(long_lines(raw.as_py(), min_chars)[2])
                keys += own
                owner += [doc.as_py()] * len(own)
            if keys:
                hi, lo = split_hash(keys)
                got = pd.DataFrame({"hi": hi.view(np.int64), "lo": lo.view(np.int64), "id": np.array(owner, np.int64)})
                got = got.groupby(["hi", "lo"], sort=False)["id"].agg(["size", "max"]).reset_index()
                yield pa.RecordBatch.from_arrays([pa.array(got[c].to_numpy(np.int64)) for c in got], ["hi", "lo", "docs", "keeper"])

    counted = small_batches(docs).select(F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), text_bytes(text).alias("raw")).mapInArrow(count, "hi long, lo long, docs long, keeper long")
    return counted.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper")).where(F.col("docs") >= min_docs)


def build_shards(frequent: DataFrame, shards: int) -> DataFrame:
    """shard, blob: perfect hash and arrays of each shard."""

    def pack(key, pdf):
        cols = [pdf[c].to_numpy(np.int64) for c in ("hi", "lo", "docs", "keeper")]
        return pd.DataFrame({"shard": [key[0]], "blob": [pack_shard(*cols)]})

    shard = F.pmod(F.col("hi"), F.lit(shards))  # a power of 2: the sign makes no difference
    return frequent.withColumn("shard", shard).groupBy("shard").applyInPandas(pack, "shard long, blob binary")


def cut_lines(raw: bytes, drop) -> bytes:
    drop = set(drop)
    return b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in drop) if drop else raw


def dedup_lines(docs: DataFrame, text: str = "text", min_chars: int = 40, min_docs: int = 5, broadcast_limit: int = 32 << 20) -> DataFrame:
    """docs' columns with `text` cut, then n_lines and n_dropped (in place of columns so named)."""
    docs = docs.drop("n_lines", "n_dropped")
    frequent = written(frequent_lines(docs, text, min_chars, min_docs))
    n = frequent.count()
    shards = 1 << max(0, (n // SHARD_KEYS).bit_length())
    arrays = written(build_shards(frequent, shards))
    size = arrays.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    way = _probe_held if size <= broadcast_limit else _probe_routed
    return way(docs, text, arrays, shards, min_chars, min_docs)


def _finish(docs: DataFrame, text: str, extra: str, drops) -> DataFrame:
    """Cut every text; `drops(batch, texts)` gives the numbers of the lines to drop."""
    names = docs.columns
    own = [F.col(f"`{c}`") for c in names if c != text]
    source = small_batches(docs).select(*own, *([extra] if extra else []), text_bytes(text).alias("__tidelog_text"))
    places = [c for c in names if c != text]

    def run(batches):
        for batch in in_parts(batches, "__tidelog_text", 8_000_000):
            raws = [x.as_py() for x in batch.column("__tidelog_text")]
            lost = drops(batch, raws)
            new = {
                text: pa.array([cut_lines(r, d).decode("utf-8", "replace") for r, d in zip(raws, lost)], pa.string()),
                "n_lines": pa.array([r.count(b"\n") + 1 for r in raws], pa.int64()),
                "n_dropped": pa.array([len(d) for d in lost], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(places.index(c)) for c in [*names, "n_lines", "n_dropped"]], [*names, "n_lines", "n_dropped"])

    schema = scan_schema(docs, "n_lines long", "n_dropped long")
    return source.mapInArrow(run, schema)


def _probe_held(docs, text, arrays, shards, min_chars, min_docs) -> DataFrame:
    blobs = {r.shard: bytes(r.blob) for r in arrays.collect()}  # below the limit checked above
    held = docs.sparkSession.sparkContext.broadcast(blobs)
    keyed = docs.withColumn("__tidelog_id", F.coalesce("doc_id", F.lit(LOWEST)))

    def drops(batch, raws):
        tables = {k: Shard(b) for k, b in held.value.items()}
        at, keys, row = [], [], []
        for i, raw in enumerate(raws):
            _, own, own_keys = long_lines(raw, min_chars)
            at += own
            keys += own_keys
            row += [i] * len(own)
        out: list[list[int]] = [[] for _ in raws]
        if keys:
            hi, lo = split_hash(keys)
            row_ = np.array(row)
            ids = batch.column("__tidelog_id").to_numpy()[row_]
            lost = np.zeros(len(row_), bool)
            dealt = shard_of(hi, shards)
            for k, t in tables.items():
                own = dealt == k
                lost[own] = t.dropped(hi[own], lo[own], ids[own], min_docs)
            for j in np.flatnonzero(lost).tolist():
                out[row[j]].append(at[j])
        return out

    return _finish(keyed, text, "", drops).drop("__tidelog_id")


def _probe_routed(docs, text, arrays, shards, min_chars, min_docs) -> DataFrame:
    keys = small_batches(docs).select(F.col("doc_id"), row_key(text).alias("key"), F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), text_bytes(text).alias("raw"))
    probe_schema = "shard long, salt int, kind int, doc_id long, key long, lines binary, blob binary"
    names = ["shard", "salt", "kind", "doc_id", "key", "lines", "blob"]

    def send(batches):
        for batch in in_parts(batches, "raw", 8_000_000):
            rows = []
            for doc, key, id_, raw in zip(*(batch.column(i) for i in range(4))):
                _, at, own = long_lines(raw.as_py(), min_chars)
                if not own:
                    continue
                hi, lo = split_hash(own)
                where, at_ = shard_of(hi, shards), np.array(at, np.int64)
                id_ = id_.as_py()
                for k in np.unique(where).tolist():
                    m = where == k
                    packed = np.stack([hi[m].view(np.int64), lo[m].view(np.int64), at_[m]]).tobytes()
                    rows.append((k, key.as_py() % SALTS, 1, doc.as_py(), key.as_py(), packed, None))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, kinds)], names)

    tables = arrays.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("lines"), "blob")
    dealt = keys.mapInArrow(send, probe_schema).unionByName(tables).repartition(partitions(docs), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def probe(batches):
        at, held = None, None
        for batch in batches:
            ids, ks, lost = [], [], []
            for shard, salt, kind, doc, key, lines, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    at, held = (shard, salt), Shard(blob)
                elif at == (shard, salt):
                    hi, lo, line = np.frombuffer(lines, "<i8").reshape(3, -1)
                    doc_ = np.full(len(hi), LOWEST if doc is None else doc, np.int64)
                    own = line[held.dropped(hi.view(U64).copy(), lo.view(U64).copy(), doc_, min_docs)]
                    if len(own):
                        ids.append(doc)
                        ks.append(key)
                        lost.append(own.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int64()), binary(lost)], ["__tidelog_l_doc", "__tidelog_l_key", "lost"])

    lost = dealt.mapInArrow(probe, "__tidelog_l_doc long, __tidelog_l_key long, lost binary").groupBy("__tidelog_l_doc", "__tidelog_l_key").agg(F.collect_list("lost").alias("__tidelog_lost"))
    keyed = docs.withColumn("__tidelog_key", row_key(text))
    joined = keyed.join(lost, F.col("doc_id").eqNullSafe(F.col("__tidelog_l_doc")) & (F.col("__tidelog_key") == F.col("__tidelog_l_key")), "left").drop("__tidelog_l_doc", "__tidelog_l_key")

    def drops(batch, raws):
        return [sorted(set(np.frombuffer(b"".join(x), "<i8").tolist())) if x else [] for x in batch.column("__tidelog_lost").to_pylist()]

    kept = joined.drop("__tidelog_lost", "__tidelog_key")
    return _finish_with(joined, kept.columns, text, drops)


def _finish_with(joined: DataFrame, names: list[str], text: str, drops) -> DataFrame:
    return _finish(joined.drop("__tidelog_key"), text, "", drops).select(*[f"`{c}`" for c in names], "n_lines", "n_dropped")


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of a whole table."""
    out = dedup_lines(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
