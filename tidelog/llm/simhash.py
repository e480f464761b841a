"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits differ in at most two once a block of bits
that holds a difference is masked.  Of the masks 1 to 4 (a quarter of the bits each) one does,
and then the two balls of radius one around the masked fingerprints meet.  So each distinct
fingerprint emits, for each mask, itself and its 48 variants; variants are shuffled, and what
meets in a bucket is verified on all 64 bits.

A bucket holds one variant, so its members are (flipped bit, masked block) pairs, all
different.  Links that join the same members need not all be emitted:
* members with one block value differ in at most two bits: they are chained;
* block values one bit apart differ in at most three: their chains are joined;
* members that flipped no bit and whose blocks differ in three bits are joined too.
Any other link has its differences in such places that another mask finds it in one of these
ways.  So links grow with the members, not with their pairs, and keep the same components.

A null or empty text has fingerprint zero, which links like any other.  Rows with one id or
one text each get a row; a null id is never the smallest unless all ids are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import U64, binary, dealt, in_parts, looked_up, partitions, row_key, small_batches, text_bytes, written
from tidelog.llm.components import components

SHINGLE, SEED, BITS, BLOCK = 3, 42, 64, 16
#: Fingerprints whose variants a task holds at once.
AT_ONCE = 20_000
LOWEST = -(1 << 63)


def fingerprint(raw: bytes) -> int:
    """Of UTF-8 bytes; a bit is set that over half of the shingles' XXH64 have."""
    words = raw.lower().split()  # of bytes: A-Z, and white space 09-0D and 20, alone
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[:-1] + 1).tolist()][:n]
    h = xxhash.xxh64_intdigest
    ends = ends[SHINGLE - 1 :].tolist() or [len(joined)]
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(begins, ends)), U64, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 100_000):  # bounded memory on very long texts
        part = hashes[i : i + 100_000]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (of the text) and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in in_parts(batches, "raw", 8_000_000):
            got = np.array([fingerprint(x.as_py()) for x in batch.column("raw")], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(got)], ["doc_id", "key", "fp"])

    return small_batches(docs).select("doc_id", F.coalesce(row_key(text), F.lit(0)).alias("key"), text_bytes(text).alias("raw")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, fp long")


def _masks() -> list[tuple[int, list[int]]]:
    """Of each mask the masked bits, and the bits that variants flip."""
    return [(((1 << BLOCK) - 1) << b, [i for i in range(BITS) if not b <= i < b + BLOCK]) for b in range(0, BITS, BLOCK)]


def emit_variants(fps: DataFrame, buckets: int) -> DataFrame:
    """bucket, variants, flips: of each batch the variants that fall in a bucket range, packed:
    a fingerprint with at most one flipped bit (8 bytes) and mask * 64 + flipped bit + 1 (1)."""

    def gathered(batches):
        """Fingerprints of many batches, so that rows stay large however many buckets there are."""
        parts, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                parts.append(batch.column("fp").to_numpy()[at : at + AT_ONCE].view(U64))
                n += len(parts[-1])
                if n >= AT_ONCE:
                    yield np.concatenate(parts)
                    parts, n = [], 0
        if parts:
            yield np.concatenate(parts)

    def run(batches):
        for part in gathered(batches):
            for m, (mask, bits) in enumerate(_masks()):
                flips = np.array([0, *(1 << i for i in bits)], U64)
                variants = (part[:, None] ^ flips).ravel()
                marks = np.tile(np.array([m * 64, *(m * 64 + bits.index(i) + 1 for i in bits)], np.uint8), len(part))
                home = _bucket(variants, mask, m, buckets)
                order = np.argsort(home, kind="stable")
                home, variants, marks = home[order], variants[order], marks[order]
                cut = np.append(np.flatnonzero(np.append(True, home[1:] != home[:-1])), len(home)) if len(home) else np.zeros(1, int)
                pairs = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home[cut[:-1]].astype(np.int32)), binary([variants[a:b].tobytes() for a, b in pairs]), binary([marks[a:b].tobytes() for a, b in pairs])],
                    ["bucket", "variants", "flips"],
                )

    return fps.mapInArrow(run, "bucket int, variants binary, flips binary")


def _bucket(variants: np.ndarray, mask: int, m: int, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (variants & ~U64(mask)) * U64(0x9E3779B97F4A7C15) + U64(m * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        return ((z ^ (z >> U64(32))) % U64(buckets)).astype(np.int64)


def bucket_links(variants: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of fingerprints) that join what the buckets hold."""
    out_a, out_b = [], []
    masks = _masks()
    which = marks >> 6
    for m, (mask, bits) in enumerate(masks):
        own = which == m
        v, flip = variants[own], (marks[own] & 63).astype(np.int64)
        flipped = np.array([0, *(1 << i for i in bits)], U64)
        fp = v ^ flipped[flip]
        z, block = v & ~U64(mask), ((v & U64(mask)) >> U64(m * BLOCK)).astype(np.int64)
        order = np.lexsort((block, z))
        z, block, fp, flip = z[order], block[order], fp[order], flip[order]
        same_z = z[1:] == z[:-1]
        chain = same_z & (block[1:] == block[:-1])
        out_a.append(fp[1:][chain])
        out_b.append(fp[:-1][chain])
        # Buckets with more than one block value: the first member of each value stands for it.
        heads = np.flatnonzero(np.append(True, ~chain)) if len(z) else np.zeros(0, int)
        hz, hb, hf = z[heads], block[heads], fp[heads]
        several = _in_company(hz)
        if several.any():
            hz, hb, hf = hz[several], hb[several], hf[several]
            _near(hz, hb, hf, [1 << i for i in range(BLOCK)], out_a, out_b)
            plain = (flip == 0) & np.isin(z, hz)
            cz, cb, cf = z[plain], block[plain], fp[plain]
            more = _in_company(cz)
            three = [(1 << i) | (1 << j) | (1 << k) for i, j, k in combinations(range(BLOCK), 3)]
            _near(cz[more], cb[more], cf[more], three, out_a, out_b)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    close = np.bitwise_count(a ^ b) <= 3
    pairs = np.unique(np.stack([np.maximum(a, b)[close], np.minimum(a, b)[close]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _in_company(z: np.ndarray) -> np.ndarray:
    """Of sorted values, which occur more than once."""
    out = np.zeros(len(z), bool)
    same = z[1:] == z[:-1]
    out[1:] = same
    out[:-1] |= same
    return out


def _near(z, block, fp, changes, out_a, out_b) -> None:
    """Join members of one z whose block values differ by one of `changes`."""
    if not len(z):
        return
    _, group = np.unique(z, return_inverse=True)
    key = group.astype(np.int64) << BLOCK | block
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    for c in changes:
        want = key ^ c
        up = want > key
        at = np.minimum(np.searchsorted(key, want[up]), len(key) - 1)
        hit = key[at] == want[up]
        out_a.append(fp[up][hit])
        out_b.append(fp[at[hit]])


def links(fps: DataFrame, per_task: int = 4_000_000) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp, distinct) that join all components."""
    variants = fps.count() * 4 * (BITS - BLOCK + 1)
    buckets = max(partitions(fps), -(-variants // per_task))

    def meet(batches):
        v, f = [], []
        for batch in batches:
            v += [x.as_py() for x in batch.column("variants")]
            f += [x.as_py() for x in batch.column("flips")]
        if v:
            a, b = bucket_links(np.frombuffer(b"".join(v), U64), np.frombuffer(b"".join(f), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt(emit_variants(fps.repartition(partitions(fps), "fp"), buckets), "bucket", buckets, meet, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (of the text), fp, label (the component's least fp) and component_id: the
    smallest doc_id that links reach, which several components may have."""
    prints = written(fingerprints(docs, text))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(distinct.select("fp")))
    of_fp = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    of_fp = written(of_fp)
    ids = of_fp.groupBy("label").agg(F.min("least").alias("component_id"))
    # A component may hold most fingerprints, and a fingerprint most documents.
    of_fp = looked_up(of_fp, ids, "label", F.col("fp")).select("fp", "label", "component_id")
    return looked_up(prints, of_fp, "fp", F.concat_ws(" ", "doc_id", "key")).select("doc_id", "key", "fp", "label", "component_id")


def near_duplicate_digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of a whole table."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the near-copies: of each component the row with its smallest id stays (of
    several with that id one)."""
    found = near_duplicates(docs, text).where("doc_id <=> component_id")
    best = found.groupBy("label", "doc_id").agg(F.min("key").alias("__tidelog_key")).select(F.coalesce("doc_id", F.lit(LOWEST)).alias("__tidelog_doc"), "__tidelog_key")
    names = docs.columns
    keyed = docs.withColumn("__tidelog_doc", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("__tidelog_key", F.coalesce(row_key(text), F.lit(0)))
    kept = keyed.join(best, ["__tidelog_doc", "__tidelog_key"], "left_semi")
    twins = kept.withColumn("__tidelog_n", F.row_number().over(Window.partitionBy("__tidelog_doc", "__tidelog_key").orderBy(F.lit(1))))
    return twins.where("__tidelog_n = 1").select(*[f"`{c}`" for c in names])
