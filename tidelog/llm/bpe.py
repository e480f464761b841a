"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs no regular expression.  Every code point has a class; an apostrophe
and a white space also look one or two characters ahead.  The splitter is a finite automaton
over these symbols, and each symbol is a function from state to state.  Those functions
compose associatively, so their (small) monoid is enumerated once and a prefix scan over
blocks finds the state before every character; state and symbol tell where a piece begins.
Pieces are merged by rank, all new pieces of a batch in step; results are cached by piece, byte
offsets of the tokens are kept.

Nulls and empty texts give no tokens and decode to nothing.  A text of any length is cut at
no place; a long piece is merged with a heap.  Repeated rows each get their row.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import binary, held, in_parts, scan_schema, small_batches, text_bytes

# Classes of code points, and the symbols and states of the automaton.
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
S_L, S_N, S_O, S_AP1, S_AP2, S_SP, S_BL, S_RUN, S_END = range(9)
START, IN_L, IN_N, IN_O, AFTER_SP, IN_RUN, ONE_MORE, TWO_MORE = range(8)
SYMBOLS, STATES, BLOCK = 9, 8, 512


def _step(state: int, symbol: int) -> int:
    if symbol == S_L:
        return {TWO_MORE: ONE_MORE, ONE_MORE: START}.get(state, IN_L)
    if symbol in (S_AP1, S_AP2) and state not in (IN_O, AFTER_SP):
        return ONE_MORE if symbol == S_AP1 else TWO_MORE
    return {S_N: IN_N, S_SP: AFTER_SP, S_BL: START, S_RUN: IN_RUN, S_END: START}.get(symbol, IN_O)


def _begins(state: int, symbol: int) -> bool:
    """Does a piece begin at a character with this symbol, read in this state?"""
    if symbol == S_L:
        return state not in (IN_L, AFTER_SP, ONE_MORE, TWO_MORE)
    if symbol == S_N:
        return state not in (IN_N, AFTER_SP)
    if symbol in (S_O, S_AP1, S_AP2):
        return state not in (IN_O, AFTER_SP)
    return state != IN_RUN if symbol == S_RUN else True


@lru_cache(None)
def _tables():
    """Of each symbol its monoid element, the product table, and step and begin tables."""
    gens = [tuple(_step(s, x) for s in range(STATES)) for x in range(SYMBOLS)]
    elements: dict[tuple, int] = {}
    todo = list(gens)
    while todo:
        f = todo.pop()
        if f not in elements:
            elements[f] = len(elements)
            todo += [tuple(g[s] for s in f) for g in gens]
    listed = list(elements)
    product = np.array([[elements[tuple(g[s] for s in f)] for g in listed] for f in listed], np.int32)
    by_symbol = np.array([elements[g] for g in gens], np.int32)
    right = product[:, by_symbol].ravel().copy()  # element * SYMBOLS + symbol -> element
    step = np.array([_step(s, x) for s in range(STATES) for x in range(SYMBOLS)], np.uint8)
    begins = np.array([_begins(s, x) for s in range(STATES) for x in range(SYMBOLS)], bool)
    return by_symbol, product, right, np.array(listed, np.uint8), step, begins


def find_starts(symbols: np.ndarray) -> np.ndarray:
    """Where pieces begin, for a sequence of symbols read from START."""
    by_symbol, product, right, listed, step, begins = _tables()
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, S_END, np.uint8)
    padded[:n] = symbols
    cols = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    whole = by_symbol[cols[0]]
    for c in cols[1:]:
        whole = right[whole * SYMBOLS + c]
    reach, gap = whole, 1  # inclusive scan over blocks, by doubling
    while gap < rows:
        reach = np.concatenate([reach[:gap], product[reach[:-gap], reach[gap:]]])
        gap *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = listed[reach[:-1], START]
    out = np.empty((BLOCK, rows), bool)
    for j, c in enumerate(cols):
        at = state * np.uint8(SYMBOLS) + c
        out[j] = begins[at]
        state = step[at]
    return np.flatnonzero(out.T.ravel()[:n])


@lru_cache(None)
def class_ranges() -> tuple[tuple[int, int, int], ...]:
    """(first, last, class) of all code points that are a letter, number or white space, as the
    tokeniser library's own engine classifies them."""
    import tiktoken

    own = {bytes([i]): i for i in range(256)}
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    everything = "".join(map(chr, points))
    cls = np.zeros(0x110000, np.uint8)
    for pattern, k in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        ids = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=own, special_tokens={}).encode_ordinary(everything)
        cls[np.frombuffer(bytes(ids).decode().encode("utf-32-le"), np.uint32)] = k
    cls[0x20] = SPACE
    edges = np.flatnonzero(np.diff(cls)) + 1
    return tuple((int(a), int(b) - 1, int(cls[a])) for a, b in zip([0, *edges], [*edges, len(cls)]) if cls[a])


@lru_cache(1)
def _class_table(ranges) -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for a, b, k in ranges:
        out[a : b + 1] = k
    return out


def symbols_of(points: np.ndarray, ends: np.ndarray, ranges) -> np.ndarray:
    """The automaton's symbols; `ends` are the places that separate texts."""
    cls = _class_table(ranges)[points]
    cls[ends] = 9
    to_symbol = np.full(10, S_END, np.uint8)
    to_symbol[[OTHER, LETTER, NUMBER, SPACE, BLANK]] = S_O, S_L, S_N, S_RUN, S_RUN
    out = to_symbol[cls]
    blank = out == S_RUN
    after = np.append(~blank[1:] & (cls[1:] != 9), False)
    out[blank & after & (cls == SPACE)] = S_SP
    out[blank & after & (cls == BLANK)] = S_BL
    at = np.flatnonzero(points == 0x27)
    at = at[cls[at] != 9]
    if len(at):
        padded = np.append(np.where(cls == 9, 0, points), [0, 0])
        one, two = padded[at + 1], padded[at + 2]
        is_ = lambda x, chars: np.isin(x, [ord(c) for c in chars])
        out[at[is_(one, "stmd")]] = S_AP1
        out[at[(is_(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]] = S_AP2
    return out


class Merger(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers.  A cache of bounded size."""

    LIMIT, LONG, AT_ONCE = 400_000, 64, 20_000

    def __init__(self, vocabulary: list[bytes]):
        super().__init__()
        self.ranks = {t: i for i, t in enumerate(vocabulary)}
        self.none = len(vocabulary)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # Pairs of tokens that make a token, as one number each, and the token.
        look = self.ranks.get
        pairs = {(a << 32) | b: r for t, r in self.ranks.items() for i in range(1, len(t)) if (a := look(t[:i])) is not None and (b := look(t[i:])) is not None}
        self.pairs = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
        self.made = np.fromiter((pairs[k] for k in self.pairs.tolist()), np.int64, len(pairs))

    def learn(self, pieces: list[str]) -> None:
        """Merge new pieces and keep them, but for long ones."""
        raws = [(p, r) for p in pieces if len(r := p.encode("utf-8", "replace")) <= self.LONG]
        for at in range(0, len(raws), self.AT_ONCE):
            part = raws[at : at + self.AT_ONCE]
            own = [x for x in part if x[1] not in self.ranks]
            self.update((p, self.ranks[r].to_bytes(4, "little")) for p, r in part if r in self.ranks)
            if own:
                self.update(zip((p for p, _ in own), self._merge_all([r for _, r in own])))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that two tokens make, or `none`."""
        if not len(self.pairs):
            return np.full(len(left), self.none)
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], self.none)

    def _merge_all(self, raws: list[bytes]) -> list[bytes]:
        """In each step every piece makes its merge of the lowest rank, the leftmost of several."""
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        piece, token = np.repeat(np.arange(len(raws)), sizes), self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        rank = np.full(len(token), self.none)  # of a token with the next one
        inside = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inside] = self._rank(token[inside], token[inside + 1])
        done_piece, done_token = [], []
        while len(token):
            heads = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), heads)
            at = best & 0xFFFFFFFF
            more = (best >> 32) < self.none
            stays = np.repeat(more, np.diff(np.append(heads, len(token))))
            done_piece.append(piece[~stays])
            done_token.append(token[~stays])
            at = at[more]
            token[at] = rank[at]
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            piece, token, rank, at = piece[stays], token[stays], rank[stays], place[at]
            rank[at] = self.none
            right = at[at + 1 < len(token)]
            right = right[piece[right + 1] == piece[right]]
            rank[right] = self._rank(token[right], token[right + 1])
            left = at[at > 0]
            left = left[piece[left - 1] == piece[left]] - 1
            rank[left] = self._rank(token[left], token[left + 1])
        piece, token = np.concatenate(done_piece), np.concatenate(done_token)
        order = np.argsort(piece, kind="stable")
        data = token[order].astype("<u4").tobytes()
        cut = np.append(0, np.cumsum(np.bincount(piece, minlength=len(raws))) * 4).tolist()
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.merge(piece.encode("utf-8", "replace")), "<u4").tobytes()
        if len(piece) <= self.LONG:
            self[piece] = out
        return out

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()

    def merge(self, raw: bytes) -> list[int]:
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        if len(raw) > self.LONG:
            return self._merge_long(raw)
        none = len(ranks)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [ranks.get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same merges, the lowest rank and then the leftmost first, from a heap."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n))
        alive = [True] * n
        heap = [(ranks[raw[i : i + 2]], i, i + 2) for i in range(n - 1) if raw[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != e:
                continue  # one of the two parts has changed
            alive[j], end[i] = False, e
            before[e] = i
            if e < n and (r := ranks.get(raw[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
            if (h := before[i]) >= 0 and (r := ranks.get(raw[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of base64 token and rank a line."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    out = [b""] * len(rows)
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


def encode_texts(texts: list[str], merger: Merger, ranges) -> list[bytes]:
    """Of each text its ids, little-endian unsigned 32-bit."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = (np.cumsum(lengths + 1) - 1)[:-1]
    starts = find_starts(symbols_of(points, ends, ranges))
    cuts = starts.tolist()
    pieces = list(map(joined.__getitem__, map(slice, cuts, [*cuts[1:], len(joined)])))
    merger.learn(list(set(pieces).difference(merger)))
    merged = list(map(merger.__getitem__, pieces))
    at = np.searchsorted(starts, ends).tolist()
    return [b"".join(merged[a:b]) for a, b in zip([0, *(x + 1 for x in at)], [*at, len(merged)])]


def encode(df: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """df's columns without `text`, and `ids` and `ends`: token ids, and the byte offset at which
    each token ends in the text, both binary, little-endian unsigned 32-bit integers.  Columns of df with these names go."""
    vocabulary, ranges = load_ranks(ranks_path), class_ranges()
    df = small_batches(df.drop("ids", "ends"))
    kept = df.drop(text)
    names = [*kept.columns, "ids", "ends"]
    source = df.select(*[F.col(f"`{c}`") for c in kept.columns], text_bytes(text).alias("__tidelog_text"))

    def run(batches):
        merger = held(("pieces", hash(tuple(vocabulary))), lambda: Merger(vocabulary))
        sizes = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        for batch in in_parts(batches, "__tidelog_text", 1_000_000):
            if not batch.num_rows:
                continue
            ids = encode_texts([x.as_py().decode("utf-8", "replace") for x in batch.column("__tidelog_text")], merger, ranges)
            merger.trim()
            ends = [np.cumsum(sizes[np.frombuffer(x, "<u4")]).astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], binary(ids), binary(ends)], names)

    return source.mapInArrow(run, scan_schema(kept, "ids binary", "ends binary"))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """df's columns and `decoded`, the bytes that the ids stand for."""
    df = small_batches(df.drop("decoded"))
    vocabulary = load_ranks(ranks_path)
    columns = df.columns

    def run(batches):
        look = vocabulary.__getitem__
        for batch in in_parts(batches, ids, 4_000_000):
            out = [b"".join(map(look, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, binary(out)], [*columns, "decoded"])

    return df.mapInArrow(run, scan_schema(df, "decoded binary"))


def token_digests(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a whole table, through encode and decode."""
    out = decode(encode(docs.select("doc_id", text), ranks_path, text), ranks_path)
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
