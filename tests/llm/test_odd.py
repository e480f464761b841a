"""Every operator on one odd table: texts of megabytes, ids that repeat or are null, nulls, empty texts, ties,
further columns with clashing names; and scores of the learned operators against plain loops."""

import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_ops import SCHEMA, WORD, brute_components, brute_leaks, brute_lines, brute_passages, sha

from tidelog.llm import bpe, decontamination, line_dedup, quality_classifier, quality_rules, queries, secret_scan, simhash, substring_dedup, toxicity
from tidelog.llm.common import BASE

LONG = 180_000


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): one text of over a megabyte, thrice, once with one word changed."""
    r = random.Random(41)
    vocabulary = ["".join(r.choice("abcdefgéü") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    words = [r.choice(vocabulary) for _ in range(LONG)]
    for k in range(500, LONG, 900):
        words[k] += "\n"
    long = " ".join(words)
    words[LONG // 2] = "changed"
    line = "a line of forty characters or more that some documents share"
    texts = [long, long, " ".join(words), None, "", " ", "\n", f"{line}\nx", f"{line}\ny", f"{line}\n{line}\nz", f"{line} ", f"\t{line}", "one two", "one two", "idiot " * 3]
    ids = [7, 7, None, None, 3, 3, 4, None, 10, 11, 12, 13, 14, 14, 15]
    return list(zip(ids, texts))


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "one" if n % 2 else None, 0) for n, (i, t) in enumerate(rows)], SCHEMA)
    for c in ("key", "raw", "fp", "n_lines", "__text", "score", "ids", "home", "label", "begin"):
        df = df.withColumn(c, F.lit(c))
    return df.cache()


def ordered(found):
    return sorted(map(tuple, found), key=repr)  # rows, also with nulls


def test_bpe(table, rows):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    voc = bpe.load_ranks(queries.byte_bpe_path())
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(voc)}, special_tokens={})
    want = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t or "")))
    got = bpe.token_digests(table, queries.byte_bpe_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert ordered(got) == ordered(want)


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_line_dedup(table, rows, limit):
    low = -(1 << 63)  # a row without an id counts as the smallest document
    want = brute_lines([(low if i is None else i, t) for i, t in rows])
    got = [(low if i is None else i, *x) for i, *x in line_dedup.line_digests(table, broadcast_limit=limit).collect()]
    assert sorted(got) == want


def test_quality_rules(table, rows):
    want = []
    for i, t in rows:
        t = t or ""
        words = WORD.findall(t)
        grams = list(zip(*(words[k:] for k in range(5))))
        often = Counter(grams)
        again = {j for k, g in enumerate(grams) if often[g] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(words) < 10 or 100 * len(again) > 20 * len(words)))
    got = quality_rules.verdicts(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert ordered(got) == ordered(want)


def test_simhash(table, rows):
    fps = []
    for _, t in rows:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        fps.append(sum(1 << b for b in range(64) if len(grams) and 2 * int(bits[:, b].sum()) > len(grams)))
    label = brute_components(fps, list(range(len(fps))))
    least = [min((i for (i, _), x in zip(rows, label) if x == own and i is not None), default=None) for own in label]
    got = simhash.near_duplicate_digests(table).collect()
    assert ordered(got) == ordered((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, least))
    assert simhash.one_each(table).count() == len(set(label))


def test_decontamination(spark, table, rows):
    words = rows[0][1].split()
    items = [(1, " ".join(words[100:130])), (1, " ".join(words[90_000:90_060])), (None, " ".join(words[-40:])), (5, "nothing of this is there at all"), (6, None), (7, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hashes", F.lit("clash"))
    want = brute_leaks([(i, t) for i, t in enumerate(t for _, t in rows)], list(enumerate(t for _, t in items)))
    got = decontamination.leaks(table, bench).select("doc_id", "item_id", "n_windows", "n_found").collect()
    assert ordered(got) == ordered((rows[i][0], items[j][0], n, f) for i, j, n, f in want) and len(want) >= 9
    kept = decontamination.without_leaks(table, bench)
    assert kept.columns == table.columns
    leaking = {i for i, *_ in want}
    assert ordered((x.doc_id, x.text) for x in kept.collect()) == ordered(x for i, x in enumerate(rows) if i not in leaking)


def test_secrets(table, rows):
    forest = secret_scan.train(trees=3)
    want = [(i, a, b) for i, t in rows for a, b in secret_scan.candidates(t or "") if forest.vote(secret_scan.features(t, a, b)) >= 0.5]
    assert ordered(secret_scan.scan(table, forest=forest).select("doc_id", "begin", "end").collect()) == ordered(want)


def test_passages(table, rows):
    known = [(i, t) for i, t in rows if i is not None]
    want = brute_passages(known, 50) + [(None, len(WORD.findall(t or "")), 0, " ".join(WORD.findall(t or ""))) for i, t in rows if i is None]
    got = substring_dedup.dedup_passages(table.select("doc_id", "text", "key", "home")).select("doc_id", "n_words", "n_removed", "text").collect()
    assert ordered(got) == ordered(want)


def brute_quality(raw, weights, bias):
    """The sigmoid of the mean weight of a text's features, one feature at a time."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    place = lambda h: mixed(h) % (quality_classifier.BUCKETS - 1) + 1
    own, before = [], None
    for w in raw.split():
        if w == before:
            own.append(quality_classifier.SAME)
        before = w
        marked = b"<" + w + b">"
        own.append(place(sum(c * pow(BASE, n, 1 << 64) for n, c in enumerate(marked)) & mask))
        for k in quality_classifier.SIZES:
            for a in range(len(marked) - k + 1):
                h = 0
                for c in marked[a : a + k]:
                    h = (h * BASE + c) & mask
                own.append(place((h + k) & mask))
    z = bias + (sum(weights[x] for x in own) / len(own) if own else 0.0)
    return 1 / (1 + math.exp(-z))


def test_quality_scores(spark, table, rows):
    y = spark.createDataFrame([(i, n % 2, 0) for n, i in enumerate([7, 3, 4, 10, 11, 12, 13, 14, 15, 7, None])], "doc_id long, quality int, toxic int")
    fold = lambda i: i is not None and crc32(str(i).encode()) % 3 == 1
    weights, bias = quality_classifier.Train().fit(quality_classifier.training_rows(table, y, "quality", 2500))
    memo = {t: brute_quality((t or "").encode(), weights, bias) for t in {t for _, t in rows} if len(t or "") < 10_000}
    got = quality_classifier.score(table, y).collect()
    assert len(got) == len(rows) and all(r.held_out == fold(r.doc_id) and r.predicted == (r.score >= 0.5) for r in got)
    short = [(i, round(memo[t], 9)) for i, t in rows if t in memo]
    assert Counter(short) <= Counter((r.doc_id, round(r.score, 9)) for r in got) and len(short) >= 12


def brute_weigh(raw, terms):
    """The sum and the largest match: every word against every term, every window by its definition."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, z in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != z))
        return row[-1]

    words = raw.decode().split()
    cores = [toxicity.core(w) for w in words]
    hits = {}
    for i, c in enumerate(cores):
        near = sorted((distance(c, t), t) for t, (e, _) in terms.items() if distance(c, t) <= e)
        if near:
            hits[i] = near[0]
    opens = [w[0] in toxicity.OPENING for w in words]
    closes = [w.rstrip(".,;:!?")[-1:] in tuple(toxicity.CLOSING) for w in words]
    reports = [c in toxicity.REPORTING for c in cores]
    total = most = 0.0
    for i, (e, t) in hits.items():
        w = toxicity.WINDOW
        quoted = any(opens[max(0, i - 2 * w) : i + 1]) and any(closes[i : i + 2 * w + 1]) or any(reports[max(0, i - 3) : i])
        own = terms[t][1] * toxicity.EDIT**e * (toxicity.QUOTED if quoted else 1.0)
        most = max(most, own)
        total += own * (1 + toxicity.NEAR * min(4, sum(abs(j - i) <= w for j in hits) - 1))
    return total, most


def test_toxicity_scores():
    r = random.Random(43)
    terms = {"blockhead": (2, 6.0), "nitwit": (1, 5.0), "dunce": (0, 4.5), "buffoon": (1, 3.0)}
    matcher = toxicity.Matcher(terms)
    plain = ["the", "a", "“the", "said", "ok.”", "it's", "Block-head", "word", "'x'", "(he)", "wrote", "«so»", "and"]
    for _ in range(400):
        words = []
        for _ in range(r.randint(0, 40)):
            w = r.choice(plain) if r.random() < 0.7 else list(r.choice(list(terms)))
            if isinstance(w, list):
                for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                    w[r.randrange(len(w))] = r.choice(["", "x", "e", "oo"])
                w = r.choice(["", "“", "'"]) + "".join(w) + r.choice(["", ",", "!”", "'"])
            words.append(w or "z")
        raw = " ".join(words).encode()
        got, want = matcher.weigh(raw), brute_weigh(raw, terms)
        assert got == pytest.approx(want)


def test_toxic_rows_go_whatever_their_ids(spark, table, rows):
    y = spark.createDataFrame([(i, 0, int(i == 15)) for i in (7, 3, 4, 10, 11, 12, 13, 14, 15)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(table, y).collect()
    assert len(scored) == len(rows) and toxicity.without_toxic(table, y).count() == sum(1 - r.predicted for r in scored)


def test_only_one_machine_may_lack_a_shared_folder():
    from types import SimpleNamespace

    from tidelog.llm.common import shared_dir

    class Conf(dict):
        set = dict.__setitem__

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(SimpleNamespace(conf=Conf({"spark.master": master})))
        named = SimpleNamespace(conf=Conf({"spark.master": master, "spark.checkpoint.dir": "hdfs://x/y/"}))
        assert shared_dir(named).startswith("hdfs://x/y/tidelog-")
    for master in ("local", "local[4]", "local[*]"):
        alone = SimpleNamespace(conf=Conf({"spark.master": master}))
        assert shared_dir(alone).startswith("file:///") and "spark.checkpoint.dir" in alone.conf
