"""Removal of long passages that an earlier document holds.

The suffixes of all documents, one a word, form a suffix tree, of which the internal nodes that
lie `width` words below the root and that suffixes of several documents pass are the maximal
repeats.  The tree is cut below its root by prefixes of variable length, so that each part fits
in memory:

* A suffix's prefix reaches from its first word through a string of `gram` words: the one with
  the least hash in its first `width` words.  Suffixes with equal first `width` words have equal
  prefixes, wherever they are; a prefix ends where its string ends, so prefixes of neighbours
  mostly end in one string, and such suffixes travel together, as one stretch of text.
* Strings are counted first.  A prefix does not end in a string that many suffixes hold: it is
  lengthened to the least of the other strings, and where there is no other, to `width` words.
* Prefixes that end in one string go to one group; groups are sized by the number of suffixes.

In its group, a string that one document alone holds is the root of leaves and is left at once.
Of the others the subtrees are built, by bundles of strings of bounded size: suffixes are sorted by
their words up to depth `width`, and a node is a run of suffixes that agree so far.  Deeper nodes
remove nothing more.  Words are compared as they are; hashes only deal suffixes out.

A batch sends a node with its smallest document only; all others of the batch are settled on
the spot, and so are those of nodes which all batches hold, if their task has sent a smaller document.
Counts decide on the way alone, never on the result.

A null or empty text has no words.  Rows with one id do not remove each other's words; a row
without an id neither removes nor loses any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import U64, Strings, Words, binary, dealt, in_parts, partitions, row_key, scan_schema, small_batches, text_bytes, window_hashes, written

WIDTH, GRAM = 50, 8
SEND_BYTES = 16 << 20
#: Suffixes that a group holds, about; words of the texts whose subtrees are built at once, about;
#: nodes sent by a task that it remembers.
GROUP_WINDOWS, BUNDLE_WORDS, REMEMBERED = 2_000_000, 1_000_000, 20_000
#: Words between two counts of a task; the least share of these, as 1 / RARE, that is counted; places
#: that a string may always have; the share of a group's suffixes that it may have, as 1 / PART.
COUNT_WORDS, RARE, FEW, PART = 2_000_000, 1 << 18, 100, 20
NONE = U64(0xFFFFFFFFFFFFFFFF)


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def starts_of(lengths: np.ndarray, width: int) -> np.ndarray:
    """Of texts that lie one after another the places where a window of each may begin."""
    end = np.cumsum(lengths)
    free = np.ones(int(end[-1]) if len(end) else 0, bool)
    for e, n in zip(end[lengths > 0].tolist(), lengths[lengths > 0].tolist()):
        free[e - min(n, width - 1) : e] = False
    return np.flatnonzero(free)


def prefixes(values: np.ndarray, starts: np.ndarray, width: int, gram: int, hot: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of word hashes at `starts`: the node's hash, the hash that the prefix ends in, and
    whether the prefix is the whole window."""
    if len(values) < width:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)
    grams, nodes = window_hashes(values, gram, width)
    grams[hot.hold(grams)] = NONE
    nodes, least = nodes[starts], least_of_windows(grams, width - gram + 1)[starts]
    whole = least == NONE
    return nodes, np.where(whole, nodes, least), whole


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def heads_of(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def first_passes(nodes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each suffix the first of those with the smallest document that pass the same node."""
    n = len(nodes)
    order = np.argsort(nodes)
    heads = heads_of(nodes[order])
    rank = np.unique(doc, return_inverse=True)[1]
    least = np.minimum.reduceat(rank[order] * n + order, heads) % n if n else order
    out = np.empty(n, np.int64)
    out[order] = np.repeat(least, np.diff(np.append(heads, n)))
    return out


def agree(words, at: np.ndarray, other: np.ndarray, width: int) -> bool:
    """Whether the `width` words from each `at` are those from `other`; words.slice gives them."""
    far = np.flatnonzero(at != other)
    a, b = at[far], other[far]
    cuts = np.append(np.flatnonzero(np.append(True, (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1))), len(a)) if len(a) else np.zeros(1, int)
    sizes = (np.diff(cuts) + width - 1).tolist()
    return all(words.slice(x, n) == words.slice(y, n) for x, y, n in zip(a[cuts[:-1]].tolist(), b[cuts[:-1]].tolist(), sizes))


def sorted_places(words: np.ndarray, width: int) -> np.ndarray:
    """The place of every suffix among the sorted suffixes, as far as `width` words tell (suffixes that
    agree share it).  The array must hold `width` more values than there are suffixes."""
    rank, depth = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while depth < width:
        step = min(depth, width - depth)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank, depth = np.unique(pair, return_inverse=True)[1].astype(np.int64), depth + step
    return rank


def subtree_passes(texts: list[bytes], sizes: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Of all suffixes (`sizes` of each text, in order) the smallest document that passes their node;
    `least` is the smallest document that holds each text."""
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t.split(b" ")), np.int64)
    lengths = sizes + width - 1
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = sorted_places(np.concatenate([words, np.zeros(width, np.int64)]), width)
    text = np.repeat(np.arange(len(texts)), sizes)
    inner = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    node = place[begin[text] + inner]
    order = np.argsort(node, kind="stable")
    heads = heads_of(node[order])
    smallest = np.minimum.reduceat(least[text][order], heads)
    out = np.empty(len(node), np.int64)
    out[order] = np.repeat(smallest, np.diff(np.append(heads, len(node))))
    return out


def string_counts(source: DataFrame, width: int, gram: int, group_bytes: int) -> DataFrame:
    """string, n: how often a string of `gram` words occurs, too low by at most 1 / RARE of all words or by
    one a count; the null string has the number of all suffixes of `width` words at least."""

    def run(batches):
        strings, total, held_now = [], 0, 0

        def counted():
            if strings:
                values = np.sort(np.concatenate(strings))
                heads = heads_of(values)
                n = np.diff(np.append(heads, len(values)))
                often = (n > 1) & (n * RARE >= len(values))
                yield pa.RecordBatch.from_arrays([pa.array(values[heads][often].view(np.int64)), pa.array(n[often])], ["string", "n"])

        for batch in in_parts(batches, "raw", group_bytes):
            words = Words([raw.as_py() for raw in batch.column("raw")])
            strings.append(window_hashes(words.hashes, gram)[0][starts_of(words.lengths, gram)])
            held_now += len(strings[-1])
            total += len(starts_of(words.lengths, width))
            if held_now >= COUNT_WORDS:
                yield from counted()
                strings, held_now = [], 0
        yield from counted()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["string", "n"])

    return source.select("raw").mapInArrow(run, "string long, n long").groupBy("string").agg(F.sum("n").alias("n"))


def plan_groups(source: DataFrame, width: int, gram: int, group_bytes: int, few: int = FEW) -> tuple[int, np.ndarray]:
    """The number of groups, and in order the strings that no prefix ends in.

    A string is one if it occurs more often than 1 / PART of a group's suffixes, or than 2 / RARE of all words
    where groups are more than that allows: so there are fewer than RARE of them, 2 MB."""
    counts = written(string_counts(source, width, gram, group_bytes))
    total = (counts.where("string is null").first() or [None, 0])[1]
    groups = max(partitions(source) * 4, -(-total // GROUP_WINDOWS))
    most = max(few, total // min(groups * PART, RARE // 2))
    hot = counts.where(F.col("string").isNotNull() & (2 * F.col("n") > most)).select("string").collect()
    return groups, np.sort(np.array([r.string for r in hot], np.int64).view(U64))


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def by_column(rows: np.ndarray) -> bytes:
    """A table of the type below, column after column, which compresses better."""
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in STRETCH.names)


def by_row(data: bytes) -> np.ndarray:
    n, at = len(data) // STRETCH.itemsize, 0
    out = np.empty(n, STRETCH)
    for c in STRETCH.names:
        out[c] = np.frombuffer(data, STRETCH[c], n, at)
        at += n * STRETCH[c].itemsize
    return out


#: A stretch of suffixes whose prefixes end in one string: document, key, string, first suffix, number
#: of suffixes, bytes of its text.
STRETCH = np.dtype([("doc", "<i8"), ("key", "<i8"), ("string", "<u8"), ("first", "<i4"), ("size", "<i4"), ("bytes", "<i4")])


def repeated_passages(docs: DataFrame, text: str = "text", width: int = WIDTH, gram: int = GRAM, group_bytes: int = 3_000_000) -> DataFrame:
    """doc_id, key (of the text), spans: word spans (begin and end, packed as 64-bit integers)
    that windows cover which a smaller document holds.  A row may have several such rows."""
    gram = min(gram, width)
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(row_key(text), F.lit(0)).alias("key"), text_bytes(text).alias("raw")).where("doc_id is not null")
    groups, frequent = plan_groups(source, width, gram, group_bytes)
    schema = "home int, doc_id long, key long, spans binary, stretches binary, texts binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3]

    def spans_of(starts, ends):  # of runs of windows
        return np.stack([starts, ends + width - 1], 1).astype("<i8").tobytes()

    def scan(rows, hot: Strings, sent_before: dict):
        """One batch of documents: what is settled here, and for each group the stretches to send."""
        words = Words([raw for _, _, raw in rows])
        place = starts_of(words.lengths, width)  # of each window among all words
        nodes, ends, whole = prefixes(words.hashes, place, width, gram, hot)
        ids = np.array([r[0] for r in rows], np.int64)
        word_at = np.concatenate([[0], np.cumsum(words.lengths)])
        row = np.searchsorted(word_at, place, "right") - 1
        offset = np.searchsorted(place, word_at)
        first = first_passes(nodes, ids[row])
        if not agree(words, place, place[first], width):  # two different windows with one hash
            number: dict[bytes, int] = {}
            numbers = [number.setdefault(w, len(number)) for w in words.text.split()]
            first = first_passes(sorted_places(np.array(numbers + [0] * width), width)[place], ids[row])
        later = ids[row] > ids[row[first]]
        del first, nodes

        def text_of(at: int, size: int) -> bytes:
            return words.slice(at, size + width - 1)

        # Nodes that are dealt by themselves may be in every batch: a task sends the smallest documents alone.
        for at in np.flatnonzero(whole & ~later).tolist():
            doc = int(ids[row[at]])
            window = text_of(int(place[at]), 1)
            before = sent_before.get(window)
            if before is not None and before < doc:
                later[at] = True
            elif before is None or doc < before:
                if len(sent_before) >= REMEMBERED:
                    sent_before.clear()
                sent_before[window] = doc
        settled = []
        for i in np.unique(row[later]).tolist():
            a, b = runs_of(later[offset[i] : offset[i + 1]])
            settled.append((i % groups, int(ids[i]), int(rows[i][1]), spans_of(a, b), None, None))
        sent = np.flatnonzero(~later)
        if not len(sent):
            return settled, []
        new = np.append(True, (sent[1:] != sent[:-1] + 1) | (row[sent[1:]] != row[sent[:-1]]) | (ends[sent[1:]] != ends[sent[:-1]]))
        begin = np.flatnonzero(new)
        stretch = np.zeros(len(begin), STRETCH)
        who, head = row[sent[begin]], place[sent[begin]]
        stretch["doc"], stretch["key"] = ids[who], np.array([r[1] for r in rows], np.int64)[who]
        stretch["string"], stretch["first"], stretch["size"] = ends[sent[begin]], head - word_at[who], np.diff(np.append(begin, len(sent)))
        home = (stretch["string"] % U64(groups)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        texts = [text_of(a, n) for a, n in zip(head[order].tolist(), stretch["size"][order].tolist())]
        stretch, home = stretch[order], home[order]
        stretch["bytes"] = list(map(len, texts))
        heads = np.append(heads_of(home), len(home)).tolist()
        return settled, [(int(home[a]), stretch[a:b], b"".join(texts[a:b])) for a, b in zip(heads[:-1], heads[1:])]

    def emit(batches):
        """What is sent to one group is gathered over many batches, so that rows stay large however
        many groups there are."""
        waiting: dict[int, list[tuple]] = {}
        sent_before: dict[bytes, int] = {}
        hot, size = Strings(frequent), 0

        def flushed():
            homes = list(waiting)
            for i in range(0, len(homes), 256):
                rows = [(home, None, None, None, packed(by_column(np.concatenate([p[1] for p in waiting[home]]))), packed(b"".join(p[2] for p in waiting[home]))) for home in homes[i : i + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in in_parts(batches, "raw", group_bytes):
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            if not rows:
                continue
            settled, sent = scan(rows, hot, sent_before)
            if settled:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*settled), types)], names)
            for part in sent:
                waiting.setdefault(part[0], []).append(part)
                size += part[1].nbytes + len(part[2])
            if size >= SEND_BYTES:
                yield from flushed()
                waiting.clear()
                size = 0
        yield from flushed()

    def build(batches):
        """A group's subtrees."""
        blobs, stretches = [], []
        for batch in batches:
            got = [batch.column(i).to_pylist() for i in range(1, 6)]
            settled = [i for i, x in enumerate(got[2]) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([got[0][i] for i in settled], pa.int64()), pa.array([got[1][i] for i in settled], pa.int64()), binary([got[2][i] for i in settled])], ["doc_id", "key", "spans"])
            for s, t in zip(got[3], got[4]):
                if s is not None:
                    stretches.append(by_row(unpacked(s)))
                    blobs.append(t)
        if not stretches:
            return
        # Strings of one document are roots of leaves.
        every = np.concatenate([s[["doc", "string"]] for s in stretches])
        order = np.argsort(every["string"], kind="stable")
        heads = heads_of(every["string"][order])
        doc = every["doc"][order]
        shared = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
        stays = np.empty(len(every), bool)
        stays[order] = np.repeat(shared, np.diff(np.append(heads, len(every))))
        del every, order, doc
        kept, texts, begin = [], [], 0
        for i, s in enumerate(stretches):
            own = np.flatnonzero(stays[begin : begin + len(s)])
            begin += len(s)
            if len(own):
                whole, cut = unpacked(blobs[i]), np.concatenate([[0], np.cumsum(s["bytes"], dtype=np.int64)])
                texts += [whole[a:b] for a, b in zip(cut[own].tolist(), cut[own + 1].tolist())]
                kept.append(s[own])
            blobs[i] = stretches[i] = None
        if not kept:
            return
        kept = np.concatenate(kept)
        order = np.argsort(kept["string"], kind="stable")
        heads = heads_of(kept["string"][order])
        # Bundles of whole strings.
        words = np.add.reduceat((kept["size"][order] + width - 1).astype(np.int64), heads)
        bundle = np.cumsum(words) // BUNDLE_WORDS
        cuts = np.append(heads[heads_of(bundle)], len(order)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield from bundle_spans(kept[order[a:b]], [texts[i] for i in order[a:b].tolist()])

    def bundle_spans(own, texts):
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
        sizes, least = np.zeros(len(number), np.int64), np.full(len(number), np.iinfo(np.int64).max)
        sizes[which] = own["size"]
        np.minimum.at(least, which, own["doc"])
        passes = subtree_passes(list(number), sizes, least, width)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        # Of a text that only its smallest document holds, and that smaller ones pass nowhere, nothing goes.
        first_of = np.minimum.reduceat(passes, begin[:-1])
        hit = np.flatnonzero(first_of[which] < own["doc"])
        hit = hit[np.lexsort((own["first"][hit], own["key"][hit], own["doc"][hit]))]
        rows: list[tuple[int, int, bytes]] = []
        at = None
        for i in hit.tolist():
            u = which[i]
            a, b = runs_of(passes[begin[u] : begin[u + 1]] < own["doc"][i])
            spans = spans_of(a + own["first"][i], b + own["first"][i])
            if at == (own["doc"][i], own["key"][i]):
                rows[-1][2].append(spans)
            else:
                at = (own["doc"][i], own["key"][i])
                rows.append((int(at[0]), int(at[1]), [spans]))
        for i in range(0, len(rows), 5000):
            part = rows[i : i + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), binary([b"".join(r[2]) for r in part])], ["doc_id", "key", "spans"])

    return dealt(source.mapInArrow(emit, schema), "home", groups, build, "doc_id long, key long, spans binary")


def dedup_passages(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs' columns with `text` as the kept words, joined by one space, then n_words and n_removed (in
    place of columns so named)."""
    docs = docs.drop("n_words", "n_removed")
    spans = repeated_passages(docs, text, width).groupBy("doc_id", "key").agg(F.collect_list("spans").alias("__tidelog_spans")).toDF("__tidelog_doc", "__tidelog_key", "__tidelog_spans")
    keyed = docs.withColumn("__tidelog_k", F.coalesce(row_key(text), F.lit(0)))
    names = docs.columns
    places = [c for c in names if c != text]
    joined = keyed.join(spans, (F.col("doc_id") == F.col("__tidelog_doc")) & (F.col("__tidelog_k") == F.col("__tidelog_key")), "left")
    source = joined.select(*[F.col(f"`{c}`") for c in places], text_bytes(text).alias("__tidelog_text"), "__tidelog_spans")

    def cut(batches):
        for batch in in_parts(batches, "__tidelog_text", 4_000_000):
            kept, n_words, n_removed = [], [], []
            for raw, parts in zip(batch.column("__tidelog_text"), batch.column("__tidelog_spans")):
                words = raw.as_py().split()
                removed = 0
                if parts.is_valid:
                    spans = np.frombuffer(b"".join(parts.as_py()), "<i8").reshape(-1, 2)
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, spans[:, 0], 1)
                    np.add.at(change, spans[:, 1], -1)
                    keep = np.cumsum(change[:-1]) == 0
                    stay = [w for w, k in zip(words, keep.tolist()) if k]
                    removed = len(words) - len(stay)
                else:
                    stay = words
                kept.append(b" ".join(stay).decode("utf-8", "replace"))
                n_words.append(len(words))
                n_removed.append(removed)
            new = {text: pa.array(kept, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            every = [*names, "n_words", "n_removed"]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(places.index(c)) for c in every], every)

    return source.mapInArrow(cut, scan_schema(docs, "n_words long", "n_removed long"))


def passage_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of a whole table."""
    out = dedup_passages(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
