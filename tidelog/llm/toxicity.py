"""Toxicity by a learned lexicon, matched with Levenshtein automata, and by context.

The lexicon is learned from a sample of at most `limit` labelled documents: words that occur
in toxic documents far more often than in others, near-copies counted once.  Its terms form a
trie.  The product of the trie and the Levenshtein automata of its terms is made deterministic
as words are read, so a word costs one look-up a character and most words die early.  How many
edits a term allows follows from its length; a term whose misspellings the sample shows in
harmless documents allows none.

Every match is then weighed by its context window: inside quotation marks, or near a word of
reporting, it is a quotation and counts little; other matches nearby raise it.  A logistic
curve, fitted to the sample, turns a document's sum into a score.

A null or empty text scores like a text without matches.  Without labelled rows of both
classes the lexicon is empty and all scores are equal.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import held, in_parts, small_batches, text_bytes
from tidelog.llm.labelled import held_out, training_rows

LIMIT, WINDOW, THRESHOLD = 6000, 6, 0.7
QUOTED, NEAR, EDIT = 0.25, 0.25, 0.9
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
OPENING, CLOSING = "\"'“‘«„‹", "\"'”’»“›"
#: Fixed words that announce a quotation.
REPORTING = frozenset("said says wrote quote quoted quotes called calls word words term terms reported allegedly dit dice sagte".split())


def core(word: str) -> str:
    return EDGES.sub("", word).lower()


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The trie of the terms, intersected with their Levenshtein automata."""

    def __init__(self, terms: dict[str, int]):
        """terms: the edits that each allows."""
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]  # edits that some term below allows
        self.edits = terms
        for term, edits in terms.items():
            node = 0
            self.most[0] = max(self.most[0], edits)
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = nxt
                self.most[node] = max(self.most[node], edits)
            self.term[node] = term
        self.reset()

    def reset(self) -> None:
        self.states: list[dict[int, int]] = []
        self.ids: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0} if self.edits else {})

    def _state(self, edits: dict[int, int]) -> int:
        """The state of these trie nodes with the fewest edits that reach each."""
        todo = list(edits)
        while todo:  # characters of a term may be left out
            node = todo.pop()
            e = edits[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < edits.get(child, 9):
                    edits[child] = e
                    todo.append(child)
        if not edits:
            return -1
        key = tuple(sorted(edits.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(edits)
            self.moves.append({})
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.states[state].items():
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < out.get(child, 9):
                    out[child] = cost
            if e + 1 <= self.most[node] and e + 1 < out.get(node, 9):
                out[node] = e + 1
        found = self.moves[state][c] = self._state(out)
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits (of several the first by name)."""
        state = self.start
        for c in word:
            if state < 0:
                return None
            state = nxt if (nxt := self.moves[state].get(c)) is not None else self._move(state, c)
        if state < 0:
            return None
        hits = [(e, self.term[n]) for n, e in self.states[state].items() if self.term[n] is not None and e <= self.edits[self.term[n]]]
        e, term = min(hits, default=(0, None))
        return (term, e) if term else None


def _families(rows) -> tuple[dict[str, int], tuple[np.ndarray, np.ndarray], list[int]]:
    """Numbers of the words, in how many families of each class a word occurs, and how many there are.

    A family is the documents whose lowest word hash is one: near-copies share most words, and so,
    mostly, that one.  Documents are held as arrays of word numbers."""
    number: dict[str, int] = {}
    families: dict[tuple[int, int], list[np.ndarray]] = {}
    for words, y in rows:
        own = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        lowest = min(map(crc32, map(str.encode, words)), default=0)
        families.setdefault((lowest, y), []).append(own)
    counts = (np.zeros(len(number), np.int64), np.zeros(len(number), np.int64))
    total = [0, 0]
    for (_, y), parts in families.items():
        total[y] += 1
        counts[y][np.unique(np.concatenate(parts))] += 1
    return number, counts, total


def learn_terms(rows, min_docs: int = 4, share: float = 0.004, purity: float = 0.9) -> dict[str, tuple[int, float]]:
    """Terms, the edits they allow and their weights (log odds), from (distinct words, toxic) of
    documents."""
    number, counts, total = _families(rows)
    if not all(total):
        return {}
    least = max(min_docs, share * total[1])
    good = []
    for w, i in number.items():
        n0, n1 = int(counts[0][i]), int(counts[1][i])
        if len(w) >= 4 and n1 >= least and (n1 / total[1]) / (n1 / total[1] + (n0 + 0.5) / total[0]) >= purity:
            good.append(w)
    terms = {w: allowed_edits(w) for w in sorted(good)}
    auto = Automaton(terms)
    near = (Counter(), Counter())
    for w, i in number.items():
        if w not in terms and (hit := auto.match(w)):
            for y in (0, 1):
                near[y][hit[0]] += int(counts[y][i])
    for w in terms:
        if near[0][w] and near[1][w] / total[1] < 3 * near[0][w] / total[0]:
            terms[w] = 0
    odds = lambda w: float(np.log((counts[1][number[w]] + 0.5) / total[1]) - np.log((counts[0][number[w]] + 0.5) / total[0]))
    return {w: (e, odds(w)) for w, e in terms.items()}


class Matcher(dict):
    """word -> its match (or None), whether it opens or closes a quotation, or reports one."""

    def __init__(self, terms: dict[str, tuple[int, float]]):
        super().__init__()
        self.automaton = Automaton({t: e for t, (e, _) in terms.items()})
        self.odds = {t: w for t, (_, w) in terms.items()}

    def __missing__(self, word: bytes):
        if len(self) > 300_000:
            self.clear()
        if len(self.automaton.states) > 20_000:
            self.automaton.reset()
        w = word.decode("utf-8", "replace")
        c = core(w)
        flags = (w[0] in OPENING) | (w.rstrip(".,;:!?")[-1:] in CLOSING) << 1 | (c in REPORTING) << 2 if w else 0
        hit = self.automaton.match(c)
        out = (hit, flags) if hit or flags else None
        if len(word) <= 64:
            self[word] = out
        return out

    def weigh(self, raw: bytes) -> tuple[float, float]:
        """The sum and the largest of the matches of a document, weighed by context windows."""
        words = raw.split()
        marked = [(i, x) for i, x in enumerate(map(self.__getitem__, words)) if x]
        hits = [(i, x[0]) for i, x in marked if x[0]]
        if not hits:
            return 0.0, 0.0
        opens = [i for i, x in marked if x[1] & 1]
        closes = [i for i, x in marked if x[1] & 2]
        reports = [i for i, x in marked if x[1] & 4]
        places = np.array([i for i, _ in hits])
        near = np.searchsorted(places, places + WINDOW, "right") - np.searchsorted(places, places - WINDOW) - 1

        def within(at: list[int], a: int, b: int) -> bool:
            k = np.searchsorted(at, a)
            return k < len(at) and at[k] <= b

        total = most = 0.0
        for (i, (term, edits)), n in zip(hits, near.tolist()):
            quoted = within(opens, i - 2 * WINDOW, i) and within(closes, i, i + 2 * WINDOW) or within(reports, i - 3, i - 1)
            own = self.odds[term] * EDIT**edits * (QUOTED if quoted else 1.0)
            most = max(most, own)
            total += own * (1 + NEAR * min(n, 4))
        return total, most


def _design(sums: list[tuple[float, float]]) -> np.ndarray:
    both = np.array(sums, float).reshape(-1, 2)
    return np.stack([np.log1p(both[:, 0]), both[:, 1], np.ones(len(both))], 1)


def probability(sums: list[tuple[float, float]], curve: tuple) -> np.ndarray:
    return 1 / (1 + np.exp(-_design(sums) @ np.array(curve)))


def fit_curve(sums: list[tuple[float, float]], y: np.ndarray, steps: int = 100) -> tuple[float, ...]:
    """A logistic curve over the sum and the largest match, by Newton's method; neither slope
    may fall."""
    if len(y) == 0 or y.min() == y.max():
        return 0.0, 0.0, 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
    design, free = _design(sums), np.array([True, True, True])
    while True:
        w = np.zeros(3)
        x, ridge = design[:, free], np.array([0.05, 0.05, 1e-6])[free]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-design @ w))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w[free])
            w[free] -= step
            if np.abs(step).max() < 1e-9:
                break
        falls = free & (w < 0) & [True, True, False]
        if not falls.any():
            return tuple(w.tolist())
        free = free & ~falls


def fit(rows: list[tuple[bytes, int]]) -> tuple[dict[str, tuple[int, float]], tuple[float, ...]]:
    """Terms and curve."""
    kept = list(dict(rows).items())
    words = (({c for w in set(raw.decode("utf-8", "replace").split()) if (c := core(w))}, y) for raw, y in kept)
    terms = learn_terms(words)
    matcher = Matcher(terms)
    return terms, fit_curve([matcher.weigh(raw) for raw, _ in kept], np.array([y for _, y in kept], float))


def _scored(docs: DataFrame, model, text: str, columns: list, names: list[str], schema: str, keep_if=None, result: str = "score") -> DataFrame:
    terms, curve = model
    key = hash((tuple(sorted(terms.items())), curve))

    def run(batches):
        matcher = held(("matcher", key), lambda: Matcher(terms))
        for batch in in_parts(batches, "__tidelog_text", 8_000_000):
            score = probability([matcher.weigh(r.as_py()) for r in batch.column("__tidelog_text")], curve)
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*names, result])
            yield out.filter(pa.array(score < keep_if)) if keep_if is not None else out

    return small_batches(docs).select(*columns, text_bytes(text).alias("__tidelog_text")).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on)."""
    model = fit(training_rows(docs, labels, "toxic", limit, text))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = _scored(docs, model, text, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")], ["doc_id", "held_out"], f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs' rows whose score is below THRESHOLD."""
    model = fit(training_rows(docs, labels, "toxic", limit, text))
    names = docs.columns
    columns = [F.col(f"`{c}`") for c in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return _scored(docs, model, text, columns, names, f"{schema}, __tidelog_score double", THRESHOLD, "__tidelog_score").select(*columns)
