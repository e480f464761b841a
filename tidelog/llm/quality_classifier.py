"""A supervised subword-embedding classifier of document quality.

A word's features are itself, its character n-grams of 3 to 5 bytes with word boundaries, and
one for a word that repeats the word before it, all hashed to a fixed number of rows.  A
document is the average of the vectors of its features, and a softmax layer gives the class.
Vectors and layer are trained by stochastic gradient descent in numpy on a sample of at most
`limit` labelled documents, whole texts each.  As average and layer are linear, scoring needs
one number a row: a document's score is the sigmoid of its features' mean.

A null or empty text scores what the bias alone gives.  With no labelled rows, or rows of one
class, every score is that class's share (0.5 without rows).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BASE, U64, held, in_parts, mix, small_batches, text_bytes
from tidelog.llm.labelled import held_out, training_rows

BUCKETS, DIM, LIMIT = 1 << 17, 10, 2500
SIZES = (3, 4, 5)
#: The feature of a word that repeats the word before it.
SAME = 0


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the features of all words, and the place in the list of the word that each is of."""
    joined = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(U64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(joined))  # characters to the word's end
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.append(U64(1), np.full(int(lengths.max(initial=1)) - 1, BASE, U64)))
        terms = joined * power[np.arange(len(joined)) - starts[owner]]
        hashes = [mix(np.add.reduceat(terms, starts)) if len(words) else np.zeros(0, U64)]
        owners = [np.arange(len(words))]
        gram = joined
        for k in range(2, max(SIZES) + 1):
            gram = gram[:-1] * U64(BASE) + joined[k - 1 :] if len(gram) > 1 else np.zeros(0, U64)
            if k in SIZES:
                inside = left[: len(gram)] >= k
                hashes.append(mix(gram[inside] + U64(k)))
                owners.append(owner[: len(gram)][inside])
        rows = (np.concatenate(hashes) % U64(BUCKETS - 1)).astype(np.int64) + 1
    return rows, np.concatenate(owners)


class Train:
    def __init__(self, epochs: int = 5, rate: float = 0.5, seed: int = 7):
        self.epochs, self.rate, self.seed = epochs, rate, seed

    def fit(self, rows: list[tuple[bytes, int]]) -> tuple[np.ndarray, float]:
        """Log odds of label 1 of each feature row, and the bias."""
        weights = np.zeros(BUCKETS)
        ones = sum(y for _, y in rows)
        if not rows or ones in (0, len(rows)):
            return weights, 0.0 if not rows else (30.0 if ones else -30.0)
        docs = []
        for raw, y in dict(rows).items():  # one of each text
            words = raw.split()
            if words:
                counted = Counter(words)
                rows_, owner = features(list(counted))
                n = np.bincount(rows_, np.fromiter(counted.values(), np.int64, len(counted))[owner], BUCKETS)
                n[SAME] = sum(map(bytes.__eq__, words, words[1:]))
                own = np.flatnonzero(n).astype(np.int32)
                docs.append((own, (n[own] / n.sum()).astype(np.float32), y))
        rng = np.random.default_rng(self.seed)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
        layer, bias = np.zeros((2, DIM)), np.log([1 - ones / len(rows), ones / len(rows)])
        steps, at = self.epochs * len(docs), 0
        for _ in range(self.epochs):
            for i in rng.permutation(len(docs)):
                own, share, y = docs[i]
                rate = self.rate * (1 - at / steps)
                at += 1
                hidden = share @ vectors[own]
                z = layer @ hidden + bias
                p = np.exp(z - z.max())
                error = p / p.sum()
                error[y] -= 1
                back = error @ layer
                layer -= rate * np.outer(error, hidden)
                bias -= rate * 0.1 * error
                vectors[own] -= rate * len(own) * 0.02 * share[:, None] * back
        return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


class Scorer(dict):
    """word -> (sum of its features' weights, their number) as one complex number; a cache."""

    LIMIT, LONG, AT_ONCE = 800_000, 64, 100_000

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), self.AT_ONCE):
            part = words[i : i + self.AT_ONCE]
            rows, owner = features(part)
            sums, n = np.bincount(owner, self.weights[rows], len(part)), np.bincount(owner, minlength=len(part))
            self.update(zip(part, (sums + 1j * n).tolist()))

    def score(self, raws: list[bytes], bias: float) -> list[float]:
        split = [raw.split() for raw in raws]
        new = [w for w in set().union(*split) if w not in self]
        self.learn(new)
        out = []
        for words in split:
            total = sum(map(self.__getitem__, words))
            total += sum(map(bytes.__eq__, words, words[1:])) * complex(self.weights[SAME], 1)
            z = bias + (total.real / total.imag if words else 0.0)
            out.append(float(1 / (1 + np.exp(-z))))
        if len(self) > self.LIMIT:
            self.clear()
        for w in new:
            if len(w) > self.LONG:
                self.pop(w, None)
        return out


def score(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted."""
    weights, bias = Train().fit(training_rows(docs, labels, "quality", limit, text))

    model = hash((weights.tobytes(), bias))

    def run(batches):
        scorer = held(("scorer", model), lambda: Scorer(weights))
        for batch in in_parts(batches, "raw", 4_000_000):
            got = scorer.score(batch.column("raw").to_pylist(), bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = small_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_bytes(text).alias("raw")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
