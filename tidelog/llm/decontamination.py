"""Benchmark decontamination by templates.

Words become template words: numbers, names (capitalised, not at a sentence's start) and units
(after a number) turn into typed placeholders; the rest is lower-cased without punctuation at
its edges.  Items and documents are cut into windows of `width` template words, which meet in a
hash join.  A document holds an item if it has at least `share` of the item's distinct windows
along diagonals on which the slots are consistent: one value in the item always stands for one
value in the document, and the reverse.  So a copy with other numbers or names is caught too, and
told apart (`reworded`).

How the join is kept small: documents are scanned once, and their words and windows are looked up in
bitmaps of the items' words and windows, of 16 MB each at most, which are broadcast.  What passes is written, a
row a document.  To hold `share` of an item's windows a document must hold one of the rarest
of them, as many as may be missing and one more; documents and items meet by these windows alone,
frequent ones dealt to several tasks.  The pairs that meet are verified, in time that grows with
the document's hits: a hit is laid on the diagonal of its window's first place in the item.

Windows of placeholders alone say nothing and are left out.  An item shorter than `width` is
one window.  Items without any window are never found.  Nulls count as empty texts.  Every row
of the benchmark is an item of its own, also where ids repeat or are null; so is every document.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import U64, Strings, Words, WordTable, held, in_parts, row_key, small_batches, text_bytes, window_hashes, word_hash, written

WIDTH, SHARE = 5, 0.8
#: Bits of the bitmap for each window of an item, and of all, at least and at most.
SIEVE_BITS, LEAST_BITS, MOST_BITS = 256, 1 << 20, 1 << 27
SALTS, BROADCAST_ROWS = 16, 1_000_000
EDGES = re.compile(r"^\W+|\W+$")
NUMERIC = re.compile(r"^[+\-]?[$€£]?\d[\d.,:/]*(%|[a-z]{1,2})?$", re.I)
#: Fixed words that name units of measure.
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees".split())
TEXT, NUMBER, NAME, UNIT = range(4)
FIELDS = np.dtype([("word", U64), ("kind", np.uint8)])
#: Bytes that make a word odd: capitals, digits, not ASCII; those that are not stripped at its edges; and
#: second bytes of the small letters in UTF-8 from U+00DF to U+00FF, whose first is LATIN.
BYTES, LATIN = np.arange(256, dtype=np.uint8), 0xC3
ODD = (BYTES >= 128) | (BYTES >= 65) & (BYTES <= 90) | (BYTES >= 48) & (BYTES <= 57)
INNER = ODD | (BYTES >= 97) & (BYTES <= 122) | (BYTES == 95)
SMALL = (BYTES >= 0x9F) & (BYTES <= 0xBF) & (BYTES != 0xB7)
UNIT_HASHES = Strings(np.sort(np.array([word_hash(u.encode()) for u in UNITS], U64)))
SLOTS = np.array([0, 0xA5A5A5A5A5A5A5A5, 0x5B5B5B5B5B5B5B5B, 0x3C3C3C3C3C3C3C3C], U64)
#: Places and hashes of a document's windows that pass the bitmap; places and words of their slots.
HIT = np.dtype([("at", "<i4"), ("hash", "<u8")])


def _describe(raw: bytes):
    """The hash of a word's core, and its kind by itself."""
    text = raw.decode("utf-8", "replace")
    own = text.strip(".,;:!?\"'()[]")
    plain = own.isalpha()
    if not plain:
        own = EDGES.sub("", text)
    low = own.lower()
    if not plain and NUMERIC.match(own):
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    else:
        kind = NAME if own[:1].isupper() and own[1:].islower() else TEXT
    return word_hash(low.encode("utf-8", "replace")), kind


def _ends(raw: bytes) -> bool:
    """Whether a word ends a sentence."""
    return raw.decode("utf-8", "replace").rstrip("\"'”’)]")[-1:] in (".", "!", "?", ":")


def _words() -> WordTable:
    return held("template words", lambda: WordTable(_describe, FIELDS))


def template(words: Words, known: np.ndarray | None = None, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: template words, the plain words' hashes, which are slots, and which are described.

    Words of small Latin letters and ASCII punctuation are described by array operations, others one by one.
    With a bitmap of `known` words the latter are left out where no window of `width` words can be an
    item's, as a word of the former kind in it is of no item."""
    n = len(words.cut) - 1
    if not n:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool), np.zeros(0, bool)
    heads, data = words.cut[:-1], words.bytes
    odd, letter = ODD[data], (data[:-1] == LATIN) & SMALL[data[1:]]
    odd[:-1] &= ~letter
    odd[1:] &= ~letter
    simple = ~np.logical_or.reduceat(odd, heads)
    place = np.arange(len(data))
    begin = np.minimum.reduceat(np.where(INNER[data], place, len(data)), heads)
    end = np.maximum.reduceat(np.where(INNER[data], place, -1), heads) + 1
    none = end == 0  # punctuation alone
    begin[none] = end[none] = 0
    plain = words.hashes_of(begin, end)
    kind = np.where(simple & UNIT_HASHES.hold(plain), UNIT, TEXT).astype(np.uint8)
    of = np.repeat(np.arange(len(words.lengths)), words.lengths)
    begins = np.append(True, of[1:] != of[:-1])
    live = np.ones(n, bool)
    if known is not None:
        dead = simple & (kind == TEXT) & ~_marked(known, plain)
        live = _covered(_whole(dead, of, width), n, width)
        live[:-1] |= live[1:] & ~begins[1:]  # the word before tells units and sentences' starts
    other = np.flatnonzero(~simple & live)
    rows = _words().look([words.slice(i, 1) for i in other.tolist()])
    plain[other], kind[other] = rows["word"], rows["kind"]
    for i in np.flatnonzero(kind == NAME).tolist():
        if begins[i] or _ends(words.slice(i - 1, 1)):
            kind[i] = TEXT
    after = ~begins & np.append(False, kind[:-1] == NUMBER)
    kind[(kind == UNIT) & ~after] = TEXT
    return np.where(kind == TEXT, plain, SLOTS[kind]), plain, kind != TEXT, simple | live


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = (hashes & U64(len(bitmap) * 8 - 1)).astype(np.int64)
    return ((bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1).astype(bool)


def _whole(bad: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
    """Where windows begin that have no bad word and lie in one text."""
    if len(bad) < width:
        return np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(bad)])
    return np.flatnonzero((before[width:] == before[:-width]) & (of[: len(of) - width + 1] == of[width - 1 :]))


def _covered(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words the windows at some places cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return np.cumsum(change[:-1]) > 0


def windows(tokens: np.ndarray, slots: np.ndarray, described: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of a width, zero where all words are slots, one is not described, or not all
    are of one text."""
    if len(tokens) < width:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        hashes = window_hashes(tokens, width)[0] ^ U64(width * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    useful = np.zeros(len(hashes), bool)
    useful[_whole(~described, of, width)] = True
    before = np.concatenate([[0], np.cumsum(slots)])
    hashes[~useful | (before[width:] - before[:-width] == width)] = 0
    return hashes


def item_table(benchmark: DataFrame, width: int, share: float) -> DataFrame:
    """A row for each item with a window: item (a number), item_id, width, need (windows to be found), total,
    hashes (distinct, ascending as unsigned), firsts (their first places), plain, slots, and words (the
    distinct hashes of plain)."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    names = ["item_id", "width", "need", "total", "hashes", "firsts", "plain", "slots", "words"]

    def run(batches):
        for batch in in_parts(batches, "raw", 8_000_000):
            rows, which = [], []
            for i, raw in enumerate(batch.column("raw")):
                words = Words([raw.as_py()])
                w = min(width, int(words.lengths[0]))
                if w:
                    tokens, plain, slots, described = template(words)
                    hashes, first = np.unique(windows(tokens, slots, described, np.zeros(len(plain), np.int64), w), return_index=True)
                    hashes, first = hashes[hashes != 0], first[hashes != 0]
                    if len(hashes):
                        rows.append((w, math.ceil(share * len(hashes)), len(hashes), hashes.view(np.int64), first.astype("<i4").tobytes(), plain.tobytes(), slots.tobytes(), np.unique(plain).view(np.int64)))
                        which.append(i)
            _words().trim()
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(which)), *cols], names)

    source = small_batches(benchmark).select("item_id", text_bytes("text").alias("raw"))
    items = source.mapInArrow(run, f"item_id {kind}, width int, need int, total int, hashes array<long>, firsts binary, plain binary, slots binary, words array<long>")
    return written(items.withColumn("item", F.monotonically_increasing_id()))


def sieve(items: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the hashes in an array column; its size is a power of two between the bounds above."""
    n = items.agg(F.sum(F.size(column))).first()[0] or 0
    bits = 1 << max(LEAST_BITS.bit_length() - 1, min(MOST_BITS.bit_length() - 1, (n * SIEVE_BITS).bit_length()))

    def pack(key, pdf):  # at most 65,536 rows
        part = np.zeros(1 << 16, bool)
        part[pdf["low"].to_numpy()] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(part, bitorder="little").tobytes()]})

    at = items.select(F.explode(column).alias("h")).select(F.col("h").bitwiseAND(bits - 1).alias("at")).distinct()
    parts = at.select(F.shiftright("at", 16).alias("part"), F.col("at").bitwiseAND(0xFFFF).alias("low")).groupBy("part").applyInPandas(pack, "part long, bits binary")
    out = np.zeros(bits >> 3, np.uint8)
    for r in parts.collect():  # bits / 65,536 rows of 8 KB at most
        out[r.part << 13 : (r.part + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return out


def hits_of(raws: list[bytes], widths: list[int], bitmap: np.ndarray, known: np.ndarray | None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the text, its windows that pass the bitmap, their slots) of the texts that have any."""
    words = Words(raws)
    tokens, plain, slots, described = template(words, known, min(widths, default=1))
    of = np.repeat(np.arange(len(raws)), words.lengths)
    begin = np.concatenate([[0], np.cumsum(words.lengths)])
    places, hashes, cover = [], [], np.zeros(len(tokens), bool)
    for w in widths:
        h = windows(tokens, slots, described, of, w)
        at = np.flatnonzero((h != 0) & _marked(bitmap, h))
        places.append(at)
        hashes.append(h[at])
        cover |= _covered(at, len(tokens), w)
    if not any(map(len, places)):
        return []
    at, h = np.concatenate(places), np.concatenate(hashes)
    if len(widths) > 1:
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
    slot = np.flatnonzero(cover & slots)
    out = []
    for i in np.unique(of[at]).tolist():
        a, b = np.searchsorted(at, (begin[i], begin[i + 1]))
        hits = np.empty(b - a, HIT)
        hits["at"], hits["hash"] = at[a:b] - begin[i], h[a:b]
        a, b = np.searchsorted(slot, (begin[i], begin[i + 1]))
        own = np.empty(b - a, HIT)
        own["at"], own["hash"] = slot[a:b] - begin[i], plain[slot[a:b]]
        out.append((i, hits, own))
    return out


def found(hits: np.ndarray, values: np.ndarray, width: int, need: int, hashes: np.ndarray, firsts: np.ndarray, plain: np.ndarray, slots: np.ndarray) -> tuple[int, bool] | None:
    """(distinct windows found on consistent diagonals, reworded) if a document's hits hold an item;
    `values` are its slots' words.  It is reworded if a diagonal that the count needs has other values."""
    k = np.searchsorted(hashes, hits["hash"])
    own = hashes[np.minimum(k, len(hashes) - 1)] == hits["hash"]
    k, q = k[own], hits["at"][own].astype(np.int64)
    if len(np.unique(k)) < need:
        return None
    p = firsts[k].astype(np.int64)
    shift = q - p
    # Slots along each diagonal: its number, word of the item, word of the document.
    far = len(plain) + 1
    cells = np.unique(np.repeat((shift + far) * far, width) + (p[:, None] + np.arange(width)).ravel())
    diagonal, at = cells // far - far, cells % far
    diagonal, at = diagonal[slots[at]], at[slots[at]]
    place = np.searchsorted(values["at"], diagonal + at)
    theirs = values["hash"][np.minimum(place, len(values) - 1)] if len(values) else np.zeros(len(at), U64)
    ours = plain[at]
    bad: set[int] = set()
    for one, two in ((ours, theirs), (theirs, ours)):  # a word that stands for two
        order = np.lexsort((two, one, diagonal))
        d, x, y = diagonal[order], one[order], two[order]
        bad.update(d[1:][(d[1:] == d[:-1]) & (x[1:] == x[:-1]) & (y[1:] != y[:-1])].tolist())
    other = set(diagonal[ours != theirs].tolist())
    order = np.lexsort((k, shift))
    shift, k = shift[order], k[order]
    cut = np.append(np.flatnonzero(np.append(True, shift[1:] != shift[:-1])), len(shift))
    fine = [(a - b, int(shift[a]), a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) if int(shift[a]) not in bad]
    seen, changed = np.zeros(len(hashes), bool), False
    for _, s, a, b in sorted(fine):  # those with most hits first
        if not seen[k[a:b]].all():
            seen[k[a:b]] = True
            changed |= s in other
    n = int(seen.sum())
    return (n, changed) if n >= need else None


def _found(docs: DataFrame, benchmark: DataFrame, text: str, width: int, share: float) -> DataFrame:
    """doc_id, key (of the text), item_id, n_windows, n_found, reworded."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = item_table(benchmark, width, share)
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # `width` rows at most
    # MOST_BITS each at most
    bitmap, known = spark.sparkContext.broadcast(sieve(items, "hashes")), spark.sparkContext.broadcast(sieve(items, "words"))

    def scan(batches):
        for batch in in_parts(batches, "raw", 2_000_000):
            got = hits_of([raw.as_py() for raw in batch.column("raw")], widths, bitmap.value, known.value)
            _words().trim()
            if got:
                which = pa.array([i for i, _, _ in got])
                distinct = [np.unique(h["hash"]).view(np.int64) for _, h, _ in got]
                cols = [pa.array(distinct, pa.list_(pa.int64())), pa.array([h.tobytes() for _, h, _ in got], pa.binary()), pa.array([v.tobytes() for _, _, v in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *cols], ["doc_id", "key", "windows", "hits", "values"])

    source = small_batches(docs).select("doc_id", F.coalesce(row_key(text), F.lit(0)).alias("key"), text_bytes(text).alias("raw"))
    passed = source.mapInArrow(scan, f"doc_id {kind}, key long, windows array<long>, hits binary, values binary") if widths else spark.createDataFrame([], f"doc_id {kind}, key long, windows array<long>, hits binary, values binary")
    passed = written(passed.withColumn("row", F.monotonically_increasing_id()))
    # The rarest windows of each item: as many as may be missing, and one.
    each = items.select("item", "need", "total", F.explode("hashes").alias("hash"))
    often = each.groupBy("hash").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "hash"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    probes = each.join(often, "hash").withColumn("rank", rank).where("rank <= total - need + 1").select("hash", "item", salts)
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    pairs = passed.select("row", salt, F.explode("windows").alias("hash")).join(probes, ["hash", "salt"]).select("row", "item").distinct()
    whole = items.select("item", "item_id", "width", "need", "total", F.col("hashes"), "firsts", "plain", "slots", salts)
    paired = pairs.join(passed.drop("windows"), "row").withColumn("salt", salt).join(whole, ["item", "salt"])
    names = ["doc_id", "key", "item_id", "n_windows", "n_found", "reworded"]

    def verify(batches):
        for batch in in_parts(batches, "hits", 8_000_000):
            rows, which = [], []
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                get = lambda n: col[n][i].as_py()  # noqa: B023, E731
                hashes = np.asarray(col["hashes"][i].values, np.int64).view(U64)
                got = found(np.frombuffer(get("hits"), HIT), np.frombuffer(get("values"), HIT), get("width"), get("need"), hashes, np.frombuffer(get("firsts"), "<i4"), np.frombuffer(get("plain"), U64), np.frombuffer(get("slots"), bool))
                if got:
                    rows.append((get("total"), *got))
                    which.append(i)
            if rows:
                at = pa.array(which)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([col["doc_id"].take(at), col["key"].take(at), col["item_id"].take(at), *cols], names)

    of_item = benchmark.schema["item_id"].dataType.simpleString()
    return paired.select("doc_id", "key", "hits", "values", "item_id", "width", "need", "total", "hashes", "firsts", "plain", "slots").mapInArrow(verify, f"doc_id {kind}, key long, item_id {of_item}, n_windows long, n_found long, reworded boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_windows, n_found, reworded: a row for each item that a document holds."""
    return _found(docs, benchmark, text, width, share).drop("key")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs' rows that hold no item.  The list of those that do is broadcast if it has at most
    `broadcast_rows` rows (of 16 bytes), and meets the documents in a shuffle beyond."""
    held_by = _found(docs, benchmark, text, width, share).select(F.col("doc_id").alias("__tidelog_doc"), F.col("key").alias("__tidelog_key")).distinct()
    held_by = written(held_by)
    names = docs.columns
    keyed = docs.withColumn("__tidelog_k", F.coalesce(row_key(text), F.lit(0)))
    if held_by.count() <= broadcast_rows:
        held_by = F.broadcast(held_by)
    kept = keyed.join(held_by, F.col("doc_id").eqNullSafe(F.col("__tidelog_doc")) & (F.col("__tidelog_k") == F.col("__tidelog_key")), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in names])
