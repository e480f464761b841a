"""Operators of the training-data pipeline against brute force on small tables."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import bpe, common, components, decontamination, line_dedup, quality_classifier, quality_rules, queries, secret_scan, simhash, substring_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "x" * 30_000, "é" * 50, "\u3000\x1c\x85 y", "one two three"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{n % 3}" if n % 5 else None, len(t or "")) for n, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus():
    """Texts with shared lines and passages, copies, near copies, repeated ids and odd cases."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéüS'!.#") for _ in range(r.randint(1, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(14) + " padding to be long enough for a key" for _ in range(4)]
    passage = line(70)
    texts = []
    for i in range(60):
        parts = [line(r.randint(1, 30)) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(r.randrange(len(parts) + 1), r.choice(["", " ", "\t"]) + r.choice(shared).upper() + "\x0b")
        if i % 4 == 0:
            parts.insert(r.randrange(len(parts) + 1), passage)
        if i % 9 == 0:
            parts.append(parts[0])
        texts.append("\n".join(parts))
    for i in range(10):
        words = texts[8].split(" ")
        for _ in range(i // 2):
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return [*texts, *ODD]


# 1


@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    voc = bpe.load_ranks(queries.byte_bpe_path())
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(voc)}, special_tokens={})


def test_bpe_is_the_library_s(tokenizer):
    r = random.Random(2)
    alphabet = "abstmdrvel'' ' \n\t  12٣é漢字́!?.  \x1c\x85 "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += ["", "a" * 3000, "!" * 500 + "'s", "it's we've they'll I'd 'twas '' 's", "".join(r.choice("abcdefgh") for _ in range(900))]
    got = bpe.encode_texts(texts, bpe.Merger(bpe.load_ranks(queries.byte_bpe_path())), bpe.class_ranges())
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode_ordinary(t) for t in texts]


def test_merges_in_step_are_those_one_by_one():
    r = random.Random(7)
    merger = bpe.Merger(bpe.load_ranks(queries.byte_bpe_path()))
    pieces = {"".join(r.choice("abeintrs éñ한😀'!1 ") for _ in range(r.randint(1, 30))) for _ in range(3000)} | {"a" * n for n in range(1, 70)} | {"the", " of", "\n", "ababab" * 9}
    merger.learn(list(pieces))
    assert all(len(p.encode()) > merger.LONG or p in merger for p in pieces)
    for p in pieces:
        assert np.frombuffer(merger[p], "<u4").tolist() == merger.merge(p.encode()), p


def test_bpe_query(spark, corpus, tokenizer):
    df = frame(spark, corpus).withColumn("ids", F.lit("clash")).withColumn("__text", F.lit(1))
    rows = bpe.token_digests(df, queries.byte_bpe_path()).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        ids = tokenizer.encode_ordinary(corpus[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(corpus[r.doc_id] or ""))
    one = bpe.encode(df.select("doc_id", "text").where("doc_id = 3"), queries.byte_bpe_path()).first()
    ends = np.frombuffer(one.ends, "<u4")
    assert ends[-1] == len(corpus[3].encode())
    assert bpe.token_digests(df.limit(0), queries.byte_bpe_path()).count() == 0


# 2


def brute_lines(rows, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    held = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), [])) >= min_docs and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_lines(spark, corpus, limit):
    ids = list(range(len(corpus)))
    ids[6] = ids[3]  # two documents with one id
    rows = list(zip(ids, corpus))
    df = frame(spark, corpus, ids).withColumn("n_lines", F.lit("clash"))
    got = line_dedup.line_digests(df, broadcast_limit=limit).collect()
    assert sorted(map(tuple, got)) == brute_lines(rows)
    assert sum(x.n_dropped for x in got) > 10
    assert line_dedup.line_digests(df.limit(0), broadcast_limit=limit).count() == 0


def test_lines_without_ids(spark):
    text = "a line that is long enough to be a key of its own"
    got = line_dedup.line_digests(frame(spark, [text] * 6, [None, None, 1, 2, 3, None])).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_dropped) for r in got) == [(-1, 1), (-1, 1), (-1, 1), (1, 1), (2, 1), (3, 0)]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    ph = line_dedup.PerfectHash.build(values)
    assert sorted(ph.index(values).tolist()) == list(range(len(values)))
    lo = np.array([7, 7, 9], np.int64)
    shard = line_dedup.Shard(line_dedup.pack_shard(np.array([1, 2, 3], np.int64), lo, np.array([9, 9, 2], np.int64), np.array([5, 6, 7], np.int64)))
    ask = lambda hi, low, doc: shard.dropped(np.array([hi], np.uint64), np.array([low], np.uint64), np.array([doc], np.int64), 5)[0]
    assert ask(1, 7, 4) and ask(2, 7, 4) and not ask(1, 7, 5) and not ask(2, 7, 6) and not ask(3, 9, 1) and not ask(1, 8, 1) and not ask(3, 7, 1)


# 3


def test_quality_counts(spark, corpus):
    texts = [*corpus, "a b c d e " * 12, "# $ x\n# $ x\n\n\n", "w " * 11]
    df = frame(spark, texts).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in quality_rules.verdicts(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        words = WORD.findall(t)
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        again = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(again) > 20 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality_rules.verdicts(df.limit(0)).count() == 0


def test_host_verdicts_shrink(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 10 else "few", "en", "big", 0) for i in range(100)] + [(200 + i, "few" if i < 38 else good, "en", "bad", 0) for i in range(40)] + [(300, "few", "en", "tiny", 0), (301, good, "en", None, 0)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].kept and not got[0].kept and got[301].kept
    assert not got[239].kept and not got[239].base_failed
    assert 0.1 < got[300].host_rate < 1


def test_own_failures_weigh_with_the_host_s(spark):
    """A document that fails a rule goes, but for a host that hardly ever fails; a bad host goes whole."""
    good = " ".join(f"word{i}" for i in range(40))
    noisy, lines = good.replace(" ", " ### "), "\n".join(["same here"] * 2 + [f"line number {i}" for i in range(3)] + ["same here"] * 2)
    rows = []
    for host, n, bad in (("clean", 900, 1), ("usual", 300, 36), ("bad", 300, 240)):
        rows += [(noisy if i < bad else good, host) for i in range(n)]
    rows += [(lines, "usual"), (lines, "clean"), (noisy + "\n" + lines, "clean")]
    df = spark.createDataFrame([(i, t, "en", h, 0) for i, (t, h) in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert got[0].kept and got[0].n_failed == 1 and got[1].kept
    assert not got[900].kept and got[900 + 36].kept
    assert not any(got[i].kept for i in range(1200, 1500)) and not any(got[i].base_failed for i in range(1200, 1500))
    assert (got[1500].n_dup_lines, got[1500].n_lines, got[1500].kept, got[1501].kept, got[1502].kept) == (3, 7, False, True, False)


def test_prior_takes_noise_for_noise(spark):
    """Small hosts of one true rate are pooled; hosts that differ are not."""
    r = random.Random(3)
    of = lambda rows: quality_rules.beta_prior(spark.createDataFrame(rows, "n long, failed long"))
    alike = of([(20, sum(r.random() < 0.2 for _ in range(20))) for _ in range(2000)])
    apart = of([(200, 10 if i % 2 else 150) for i in range(50)])
    assert sum(alike) > 200 and abs(alike[0] / sum(alike) - 0.2) < 0.02
    assert sum(apart) < 5 and abs(apart[0] / sum(apart) - 0.4) < 0.01
    assert of([(7, 0)]) == of([(9, 0)]) and of([]) == (0.5, 0.5) and sum(of([(1, 1), (1, 0)])) >= 1


# 4


def brute_simhash(texts, ids):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps = []
    for t in texts:
        words = WORD.findall((t or "").translate(lower))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return fps, brute_components(fps, ids)


def brute_components(fps, ids):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3 and label[j] > label[i]:
                    label[j] = label[i]
    return [min(ids[j] for j in range(len(fps)) if label[j] == label[i]) for i in range(len(fps))]


def test_simhash(spark, corpus):
    texts = [t for t in corpus if t is None or len(t) < 5000]
    texts[5] = texts[4]
    ids = [1000 - i for i in range(len(texts))]
    ids[7] = ids[6]
    fps, comp = brute_simhash(texts, ids)
    df = frame(spark, texts, ids).withColumn("key", F.lit("clash"))
    got = simhash.near_duplicate_digests(df).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, comp))
    assert simhash.near_duplicate_digests(df.limit(0)).count() == 0
    one = simhash.one_each(df.drop("key")).select("doc_id").collect()
    members = {}  # of each component; two may share their smallest id
    for label, i in zip(brute_components(fps, list(range(len(fps)))), ids):
        members.setdefault(label, []).append(i)
    assert sorted(r.doc_id for r in one) == sorted(map(min, members.values()))


def test_one_each_of_components_with_one_smallest_id(spark):
    """Components whose smallest ids are equal, or all null, each keep a row."""
    r = random.Random(9)
    a, b, c, d, e = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(5)]
    rows = [(7, a), (7, b), (8, a), (None, c), (None, c), (None, d), (None, e), (9, e), (None, None)]
    got = simhash.one_each(frame(spark, [t for _, t in rows], [i for i, _ in rows])).select("doc_id", "text").collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(map(tuple, got), key=key) == sorted([(7, a), (7, b), (None, c), (None, d), (9, e), (None, None)], key=key)


@pytest.mark.parametrize("seed", range(4))
def test_balls_meet_exactly(spark, seed):
    """Families of fingerprints around centres: links join what brute force joins."""
    r = random.Random(seed)
    fps = set()
    for _ in range(6):
        c = r.getrandbits(64)
        block = r.randrange(4) * 16
        for _ in range(25):
            bits = r.sample(range(64), r.randint(0, 5)) if r.random() < 0.6 else r.sample(range(block, block + 16), r.randint(0, 5))
            f = c
            for b in bits:
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    want = brute_components(fps, list(range(len(fps))))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = simhash.links(df).collect()
    assert all(((x.a ^ x.b) & (2**64 - 1)).bit_count() <= 3 for x in found)
    at = {f - (1 << 64) if f >> 63 else f: i for i, f in enumerate(fps)}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for x in found:
            a, b = at[x.a], at[x.b]
            m = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = m
    assert label == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components.components(links.limit(0)).count() == 0


# 5


def test_urls(spark):
    rules = url_filter.RULES
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "https://a.example.com/en/1?q#f", "https://a.example.com/de/1", "http://x.net/es/1", "http://x.net/fr", "http://net/fr/", "https://com/", "https://com", "http://xcom/", "https://cheapwords.org/a/b#c?d", "https://u:p@h.org:80?x", "x://a.org/b://c/d"]
    rows = [(i, u, "<p>cheap words and <b>more words</b> words</p><script>var q</script>") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.verdicts(df).collect()}
    for i, u in enumerate(urls):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(t), t, k) for k, t in rules for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, default=(0, None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1])
        assert got[i].verdict == best[2] if best[1] else got[i].verdict in ("allow", "block")
    assert url_filter.verdicts(df.limit(0)).count() == 0


def test_viterbi_is_the_best_split():
    counts, total = {"cheap": 50, "words": 40, "cheapw": 1, "ords": 1, "a": 5}, 97
    assert url_filter.viterbi("cheapwords", counts, total) == ["cheap", "words"]
    assert url_filter.viterbi("", counts, total) == []
    assert "".join(url_filter.viterbi("zzzcheapqq", counts, total)) == "zzzcheapqq"


def test_bayes_learns_from_rules(spark):
    rows = [(i, f"https://winbets{i % 3}.net/es/promo", "win bets") for i in range(30)] + [(100 + i, f"https://goodnews{i % 3}.com/story", "good news") for i in range(30)] + [(900, "https://bestwinbets.org/promo", ""), (901, "https://thegoodnews.org/story", "")]
    got = {r.page_id: r.verdict for r in url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[900] == "block" and got[901] == "allow"


def brute_urls(rows, rules=url_filter.RULES):
    """(page_id, verdict, log odds) by dictionaries, without hashing of tokens."""
    counts = {}
    for _, _, html in rows:
        plain = re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ", html or "")
        for w in re.findall(r"[a-z]{2,20}", plain.lower()):
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values()) or 1
    stated = {x for _, t in rules for x in re.split(r"[^a-z0-9]+", t) if x}
    pages = []
    for page_id, url, _ in rows:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest).group().lower()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fits = [(len(t), k) for k, t in rules for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        tokens = []
        for mark, text in (("", host), ("/", path.lower())):
            for name in re.split(r"[^a-z0-9]+", re.sub("[0-9]+", "0", text)):
                if name and name not in stated:
                    tokens += [mark + x for x in url_filter.viterbi(name, counts, total)]
        pages.append((page_id, max(fits)[1] if fits else None, tokens))
    seen, n = {"allow": {}, "block": {}}, {"allow": 0, "block": 0}
    for page_id, rule, tokens in pages:
        if rule and not (page_id is not None and crc32(str(page_id).encode()) % 3 == 1):
            n[rule] += 1
            for t in tokens:
                seen[rule][t] = seen[rule].get(t, 0) + 1
    size = {k: sum(v.values()) + url_filter.BUCKETS for k, v in seen.items()}
    odds = lambda t: np.log((seen["block"].get(t, 0) + 1) / size["block"]) - np.log((seen["allow"].get(t, 0) + 1) / size["allow"])
    bias = np.log((n["block"] + 1) / (n["allow"] + 1)) if sum(n.values()) else -1.0
    scores = [bias + sum(map(odds, tokens)) for *_, tokens in pages]
    return [(p, rule or ("block" if x > 0 else "allow"), round(float(x), 6)) for (p, rule, _), x in zip(pages, scores)]


def test_verdicts_are_brute_force_s(spark):
    """One host holds most rows; ids repeat or are null; one url and one page are very long."""
    r = random.Random(31)
    words = ["win", "bets", "cheap", "pills", "good", "news", "daily", "casino", "story", "promo"]
    rows = []
    for i in range(300):
        ending = r.choice([".com/de/", ".example.com/en/", ".net/es/", ".net/en/", ".org/"])
        name = "bestwinbets" if i % 3 == 0 else "".join(r.sample(words[4:] if ".com/d" in ending else words[:6] if "com/en" in ending or "/es" in ending else r.choice([words[:5], words[5:]]), 2)) + r.choice(["", "7", "-x"])
        rows.append((None if i % 50 == 9 else i // 2, f"https://{r.choice(['', 'www.'])}{name}{ending}{''.join(r.sample(words, 2))}/{i}.html?q", f"<p>{' '.join(r.choices(words, k=6))}</p>"))
    rows += [(900, None, None), (901, "http://x.org/" + "goodnews" * 400 + "/a" * 2000, "good news " * 50_000), (902, "", "")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((x.page_id, x.verdict, round(x.score, 6)) for x in got), key=key) == sorted(brute_urls(rows), key=key)
    assert {x.verdict for x in got if x.rule is None} == {"allow", "block"}


# 6 and 8


def labelled(spark, positive, negative, n=240):
    r = random.Random(6)
    texts = [(positive if i % 3 == 0 else negative)(r) for i in range(n)]
    docs = frame(spark, texts + ODD, list(range(n)) + [n + i for i in range(len(ODD))])
    y = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(n)] + [(3, 1, 1), (None, 1, 1), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, y


def accuracy(rows, n=240):
    own = [r for r in rows if r.doc_id < n and r.held_out]
    assert len(own) > 30
    return sum(r.predicted == int(r.doc_id % 3 == 0) for r in own) / len(own)


def test_samples_are_bounded(spark):
    from tidelog.llm.labelled import training_rows

    docs = frame(spark, ["x" * 100] * 30 + ["y" * 50], [*range(30), 3])
    y = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    free = [i for i in range(30) if crc32(str(i).encode()) % 3 != 1]
    assert len(training_rows(docs, y, "quality", 1000)) == len(free)
    assert len(training_rows(docs, y, "quality", 7)) == 7
    assert len(training_rows(docs, y, "quality", 1000, most_bytes=450)) == 5 and len(training_rows(docs, y, "quality", 1000, most_bytes=1)) == 1
    assert training_rows(docs, y.limit(0), "quality", 9) == []


def plain(r):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(60))


def test_quality_classifier(spark):
    docs, y = labelled(spark, plain, lambda r: plain(r).replace(" ", "!! ").upper())
    rows = quality_classifier.score(docs.withColumn("score", F.lit("clash")), y).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert accuracy(rows) > 0.95
    assert {r.score for r in quality_classifier.score(docs, y.limit(0)).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), y).count() == 0


def rude(r):
    words = plain(r).split()
    for _ in range(4):
        words[r.randrange(len(words))] = r.choice(["blockhead", "nitwit", "dunce", "buffoon"]) + r.choice(["", ",", "!"])
    return " ".join(words)


def test_toxicity(spark):
    docs, y = labelled(spark, rude, plain)
    rows = toxicity.score(docs.withColumn("__raw", F.lit("clash")).withColumn("score", F.lit(1)), y).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert accuracy(rows) > 0.95
    kept = {r.doc_id for r in toxicity.without_toxic(docs, y).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}
    assert len({r.score for r in toxicity.score(docs, y.limit(0)).collect()}) == 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, z in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != z))
    return row[-1]


def test_automaton_is_edit_distance():
    r = random.Random(8)
    terms = {"".join(r.choice("abc") for _ in range(r.randint(3, 10))): r.randrange(3) for _ in range(25)}
    auto = toxicity.Automaton(terms)
    for _ in range(3000):
        w = "".join(r.choice("abcd") for _ in range(r.randint(0, 11)))
        near = sorted((edit_distance(w, t), t) for t, e in terms.items() if edit_distance(w, t) <= e)
        got = auto.match(w)
        assert (got is None) == (not near)
        if near:
            assert got == (near[0][1], near[0][0])


def test_quotations_count_less():
    m = toxicity.Matcher({"blockhead": (2, 6.0)})
    abuse, quoted, near = m.weigh(b"you are a blockhead ok"), m.weigh("he used the “word blockhead here” once".encode()), m.weigh(b"you blokhead you")
    assert abuse[0] > near[0] > quoted[0] > 0
    assert m.weigh(b"") == (0.0, 0.0)


# 7


class Items:
    """The operator's scan and verification of single texts, without Spark."""

    def __init__(self, rows, width):
        self.items, self.seen = [], []
        for item_id, raw in rows:
            words = common.Words([raw])
            w = min(width, int(words.lengths[0]))
            if w:
                tokens, plain, slots, described = decontamination.template(words)
                hashes, first = np.unique(decontamination.windows(tokens, slots, described, np.zeros(len(plain), np.int64), w), return_index=True)
                self.items.append((item_id, w, hashes[hashes != 0], first[hashes != 0].astype("<i4"), plain, slots))

    def found(self, raw, share):
        bits = np.full(1 << 10, 255, np.uint8)
        got = decontamination.hits_of([raw], sorted({i[1] for i in self.items}), bits, None)
        out = []
        for item_id, w, hashes, first, plain, slots in self.items if got else []:
            if len(hashes) and (x := decontamination.found(got[0][1], got[0][2], w, int(np.ceil(share * len(hashes))), hashes, first, plain, slots)):
                out.append((item_id, len(hashes), *x))
        return out


def test_templates_and_slots():
    item = "A train leaves with 120 passengers from the station near Boston and travels 45 km in 2 hours before it stops again"
    items = Items([(1, item.encode()), (2, b"tiny item"), (3, b"")], 5)
    found = lambda t: items.found(t.encode(), 0.8)
    assert [x[0] for x in found("so. " + item + " yes")] == [1] and not found(item)[0][3]
    changed = item.replace("120", "77").replace("Boston", "Denver").replace("45 km", "9 miles")
    assert [(x[0], x[3]) for x in found(changed)] == [(1, True)]
    assert found(item[: len(item) // 2]) == [] and found("") == [] and found("nothing here") == []
    assert [x[0] for x in found("a tiny item b")] == [2]
    pair = Items([(1, b"take 5 of them and then put 5 more back on top of 7 old ones here")], 5)
    assert pair.found(b"take 8 of them and then put 8 more back on top of 9 old ones here", 0.8)
    assert not pair.found(b"take 8 of them and then put 9 more back on top of 9 old ones here", 0.8)


def test_leaks(spark, corpus):
    r = random.Random(3)
    items = [" ".join("".join(r.choice("mnopqr") for _ in range(6)) for _ in range(r.randint(6, 40))) for _ in range(12)]
    texts = list(corpus)
    for i, it in enumerate(items[:8]):
        texts[i * 3] = (texts[i * 3] or "") + "\n" + it + "\n"
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id long, text string")
    df = frame(spark, texts).withColumn("item_id", F.lit("clash"))
    want = {(i * 3, i) for i in range(8)}
    assert {(x.doc_id, x.item_id) for x in decontamination.leaks(df, bench).collect()} == want
    for limit in (0, 1000):
        kept = decontamination.without_leaks(df, bench, broadcast_rows=limit)
        assert kept.columns == df.columns
        assert {x.doc_id for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.leaks(df, bench.limit(0)).count() == 0 and decontamination.leaks(df.limit(0), bench).count() == 0


def test_items_with_one_id_are_apart(spark):
    """Benchmark rows with one id, or without, and different texts: each is found by its own windows."""
    r = random.Random(13)
    say = lambda n: " ".join("".join(r.choice("mnopqr") for _ in range(6)) for _ in range(n))
    short, long, other, last = say(8), say(40), say(30), say(9)
    rows = [(1, long), (1, short), (2, short + " x"), (2, long + " y"), (None, other), (None, last)]
    docs = frame(spark, ["a " + long + " b", "a " + short + " b", other, last, "nothing here"])
    bench = spark.createDataFrame(rows, "item_id long, text string").coalesce(1)
    got = decontamination.leaks(docs, bench).select("doc_id", "item_id", "n_windows").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(0, 1, 36), (0, 2, 37), (1, 1, 4), (1, 2, 5), (2, None, 26), (3, None, 5)], key=repr)
    assert [x.doc_id for x in decontamination.without_leaks(docs, bench).collect()] == [4]


def brute_template(words):
    """Template words and slots by the definition, a word at a time."""
    out, slots, plain, ends, number = [], [], [], True, False
    for w in words:
        own = re.sub(r"^\W+|\W+$", "", w)
        kind = None
        if re.match(r"^[+\-]?[$€£]?\d[\d.,:/]*(%|[a-z]{1,2})?$", own, re.I):
            kind = "#"
        elif own.lower() in decontamination.UNITS:
            kind = "unit" if number else None
        elif own[:1].isupper() and own[1:].islower() and not ends:
            kind = "name"
        number = kind == "#"
        ends = w.rstrip("\"'”’)]")[-1:] in tuple(".!?:")
        out.append(kind or own.lower())
        slots.append(kind is not None)
        plain.append(own.lower())
    return [(t, s) for t, s in zip(out, slots)], plain


def brute_leaks(docs, items, width=5, share=0.8):
    """Every window of every item on every diagonal of every document."""
    out = []
    for i, text in docs:
        mine, words = brute_template((text or "").split())
        for j, item in items:
            theirs, values = brute_template((item or "").split())
            w = min(width, len(theirs))
            first = {}
            for p in range(len(theirs) - w + 1 if w else 0):
                g = tuple(theirs[p : p + w])
                if not all(s for _, s in g):
                    first.setdefault(g, p)
            lines = {}
            for q in range(len(mine) - w + 1 if w else 0):
                g = tuple(mine[q : q + w])
                if g in first:
                    lines.setdefault(q - first[g], []).append((first[g], g))
            seen = set()
            for shift, parts in lines.items():
                ks = {k for p, _ in parts for k in range(p, p + w) if theirs[k][1]}
                pairs = {(values[k], words[k + shift]) for k in ks}
                if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                    seen |= {g for _, g in parts}
            if first and len(seen) >= share * len(first):
                out.append((i, j, len(first), len(seen)))
    return sorted(out)


def test_leaks_are_brute_force_s(spark):
    """Random items of few words, so that windows repeat and are shared, and copies of them: with other
    numbers and names, consistent or not, and with words lost."""
    r = random.Random(17)
    vocabulary = ["Anna", "Bob", "Carl", "km", "hours", "5", "7", "12", "has", "the", "so", "then.", "and", "of", "x", "(red", "blue,", "what?"]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 6, 12, 30, 60]))) for _ in range(30)]
    items += [items[5], None, "", "5 7 12", "a b " * 15]
    docs = []
    for n in range(120):
        words = r.choice(items[:30]).split()
        if n % 3:
            swap = {w: r.choice(["4", "8", "9"] if w.isdigit() else ["Dora", "Emil"]) for w in {"5", "7", "12", "Anna", "Bob", "Carl"}}
            words = [swap.get(w, w) if n % 3 == 1 or r.random() < 0.7 else w for w in words]
        words = [w for w in words if r.random() > (n % 4) * 0.02]
        before, after = (" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 20))) for _ in range(2))
        docs.append(f"{before}\n{' '.join(words)} {after}")
    docs += [None, "", "a b " * 40, docs[0]]
    want = brute_leaks(list(enumerate(docs)), list(enumerate(items)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.leaks(frame(spark, docs), bench).select("doc_id", "item_id", "n_windows", "n_found").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 100


def test_reparameterised_copies_are_found(spark):
    """Copies with all numbers, names and units replaced one for one, amid other text: all are caught as
    reworded, verbatim ones as such, and texts of the same words in another order are left alone."""
    r = random.Random(29)
    say = lambda n: ["".join(r.choice("mnopqr") for _ in range(5)) for _ in range(n)]
    items, copies, clean = [], [], []
    for _ in range(40):
        words = say(30)
        for k in range(3, 30, 6):
            words[k] = r.choice([str(r.randint(10, 99)), r.choice(["Boston", "Denver", "Paris"])])
        swap = {w: str(r.randint(100, 999)) + str(n) if w.isdigit() else ["Oslo", "Lima", "Rome"][["Boston", "Denver", "Paris"].index(w)] for n, w in enumerate(sorted({w for w in words if w.isdigit() or w.istitle()}))}
        items.append(" ".join(words))
        copies.append(" ".join([*say(20), *(swap.get(w, w) for w in words), *say(20)]))
        clean.append(" ".join(r.sample(words, len(words))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.reworded for x in decontamination.leaks(frame(spark, copies + items + clean), bench).collect()}
    assert got == {(i, i): True for i in range(40)} | {(40 + i, i): False for i in range(40)}


def test_periodic_texts_are_linear():
    """An item of one cycle against long texts of the cycle: time and memory grow with the text."""
    import tracemalloc

    cycle = "the red 5 fox ran over 7 old logs and then slept until noon came "
    items = Items([(1, (cycle * 80).encode())], 5)
    tracemalloc.start()
    got = items.found((cycle * 8000).encode(), 0.8)  # 104,000 words
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[0] for x in got] == [1] and most < 200e6


# 9


def test_secrets(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f'set token = "{key}" now', f"commit {key} fixed it", "call 1234567890123456 today", None, "", "see www.example.com/path/page123.html", f"é api_key={key}"]
    got = {(r.doc_id, r.begin, r.end) for r in secret_scan.scan(frame(spark, texts).withColumn("begin", F.lit("clash"))).collect()}
    assert got == {(0, 13, 53), (6, 10, 50)}
    assert secret_scan.scan(frame(spark, texts).limit(0)).count() == 0


def test_values_after_secret_names():
    forest = secret_scan.train()
    found = lambda t: [t[a:b] for a, b in secret_scan.candidates(t) if forest.vote(secret_scan.features(t, a, b)) >= 0.5]
    assert found('password = "Tr0ubad0r3"') == ["Tr0ubad0r3"]
    assert "pa$$w0rd!2024xyz" in found("passwd=pa$$w0rd!2024xyz")
    assert found("pwd: 'qzkvhtrwplmxn'") == ["qzkvhtrwplmxn"]
    assert found("the key idea gave access to the session room") == []


def test_forest_generalises():
    held = secret_scan.labelled_findings(600, seed=99)
    forest = secret_scan.train()
    right = sum((forest.vote(secret_scan.features(t, a, b, p)) >= 0.5) == bool(y) for t, a, b, y, p in held)
    assert right / len(held) > 0.95


# 10


def brute_passages(rows, width):
    first = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for k in range(len(words) - width + 1):
            g = tuple(words[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        words = WORD.findall(t or "")
        keep = [True] * len(words)
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] < i:
                keep[k : k + width] = [False] * width
        kept = [w for w, x in zip(words, keep) if x]
        out.append((i, len(words), len(words) - len(kept), " ".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("width", [50, 5, 1])
def test_passages(spark, corpus, width):
    texts = [*corpus, "to be " * 200, "x to be " + "to be " * 100]
    ids = [500 - i for i in range(len(texts))]
    ids[6] = ids[3]
    rows = [(i, t) for i, t in zip(ids, texts)]
    df = frame(spark, texts, ids).withColumn("n_removed", F.lit("clash"))
    got = substring_dedup.dedup_passages(df.select("doc_id", "text"), width=width).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == brute_passages(rows, width)
    assert substring_dedup.passage_digests(df.limit(0)).count() == 0


def loads(texts, width, gram, groups, hot):
    """Suffixes of each group."""
    out = np.zeros(groups, np.int64)
    for t in texts:
        words = common.Words([t.encode()]).hashes
        _, ends, _ = substring_dedup.prefixes(words, np.arange(len(words) - width + 1), width, gram, common.Strings(hot))
        out += np.bincount((ends % np.uint64(groups)).astype(np.int64), minlength=groups)
    return out


@pytest.mark.parametrize("n", [16, 20, 24, 49])
def test_hot_strings_are_split(spark, n):
    """One phrase in every document amid different texts: prefixes that end in it are lengthened, so that no
    group has three times the mean, and copies still meet."""
    r = random.Random(21)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    line = say(n)
    texts = [f"{say(45)} {line} {say(45)}" for _ in range(240)]
    texts += texts[:10]
    source = frame(spark, texts).select("doc_id", F.col("text").cast("binary").alias("raw"))
    groups, hot = substring_dedup.plan_groups(source, 50, 8, 4_000_000, few=10)
    assert groups == 16 and n - 7 <= len(hot) <= n + 7
    held = loads(texts, 50, 8, groups, hot)
    assert held.max() < 3 * held.mean()
    got = substring_dedup.dedup_passages(frame(spark, texts).select("doc_id", "text")).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.text) for x in got) == brute_passages(list(enumerate(texts)), 50)


def test_groups_grow_with_the_suffixes(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(100)]
    source = frame(spark, texts).select("doc_id", F.col("text").cast("binary").alias("raw"))
    monkeypatch.setattr(substring_dedup, "GROUP_WINDOWS", 10)
    assert substring_dedup.plan_groups(source, 50, 16, 4_000_000)[0] == 110
    assert substring_dedup.plan_groups(source.limit(0), 50, 16, 4_000_000)[0] == 16


def test_several_groups_in_a_task(spark, corpus, monkeypatch):
    """Fewer tasks than groups: a task takes its groups one after another, with the same results."""
    monkeypatch.setattr(common, "MOST_TASKS", 3)
    rows = list(enumerate(corpus))
    got = substring_dedup.dedup_passages(frame(spark, corpus).select("doc_id", "text"), width=5).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == brute_passages(rows, 5)
    short = [t for t in corpus if t is None or len(t) < 5000]
    fps, comp = brute_simhash(short, list(range(len(short))))
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert sorted(r.component_id for r in simhash.near_duplicate_digests(frame(spark, short)).collect()) == sorted(comp)
    seen = common.dealt(spark.range(1000).select((F.col("id") % 40).cast("int").alias("g"), "id"), "g", 40, lambda rows: [next(iter(rows))], "g int, id long").select("g").distinct().count()
    assert seen == 40


def test_words_decide_not_hashes(monkeypatch):
    """Nodes, strings and texts whose hashes collide."""
    r = random.Random(5)
    words = np.array([r.randrange(3) for _ in range(600)])
    want = np.unique([words[i : i + 7].tolist() for i in range(594)], axis=0, return_inverse=True)[1].ravel()
    place = substring_dedup.sorted_places(np.append(words, [0] * 7), 7)[:594]
    assert (np.unique(place, return_inverse=True)[1] == want).all()
    texts = [b" ".join(b"%d" % w for w in words[i : i + 50].tolist()) for i in range(0, 600, 50)]
    held = common.Words(texts)
    nodes, doc, at = (want % 5).astype(np.uint64), np.arange(594) // 50, np.arange(594)
    assert not substring_dedup.agree(held, at, substring_dedup.first_passes(nodes, doc), 7)
    assert substring_dedup.agree(held, at, substring_dedup.first_passes(want.astype(np.uint64), doc), 7)


def test_words_by_array_operations(corpus):
    texts = [(t or "").encode() for t in corpus] + [b" \t a\x0b\x0cb\r\n", b"x", b"", b"\x00 \xff\x00"]
    held = common.Words(texts)
    split = [t.split() for t in texts]
    assert held.lengths.tolist() == [len(w) for w in split]
    flat = [w for t in split for w in t]
    assert held.text.split(b" ")[:-1] == flat and [held.slice(i, 1) for i in range(len(flat))] == flat
    assert len(np.unique(held.hashes)) == len(set(flat)) == len({(h, w) for h, w in zip(held.hashes.tolist(), flat)})
    assert held.hashes.tolist() == [common.word_hash(w) for w in flat]
    assert len(common.Words([]).hashes) == len(common.Words([b"", b" "]).hashes) == 0


@pytest.mark.parametrize("few", [2, 100])
def test_passages_with_colliding_hashes(spark, corpus, monkeypatch, few):
    """Hashes of six bits: the words decide all the same, with prefixes of either kind."""
    original, hashes = substring_dedup.prefixes, common.window_hashes

    def prefixes(*args):  # goes to the workers by value
        substring_dedup.window_hashes = lambda words, *widths: [h % np.uint64(61) for h in hashes(words, *widths)]
        try:
            return original(*args)
        finally:
            substring_dedup.window_hashes = hashes

    monkeypatch.setattr(substring_dedup, "prefixes", prefixes)
    monkeypatch.setattr(substring_dedup, "FEW", few)
    texts = [t for t in corpus if len(t or "") < 3000][:30]
    texts += ["to be " * 60, "x to be " + "to be " * 40]
    df = frame(spark, texts, [99 - i for i in range(len(texts))]).select("doc_id", "text")
    got = substring_dedup.dedup_passages(df, width=12).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == brute_passages([(99 - i, t) for i, t in enumerate(texts)], 12)


def test_passages_without_ids(spark):
    t = " ".join(map(str, range(60)))
    got = substring_dedup.passage_digests(frame(spark, [t, t, t, t], [None, 2, 2, 1])).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in got) == [(-1, 0), (1, 0), (2, 60), (2, 60)]


def test_clashing_names_and_other_columns(spark, corpus):
    """Operators that return whole rows, on a table whose other columns have the names they add."""
    taken = ("n_lines", "n_dropped", "n_words", "n_removed", "ids", "ends", "score", "raw", "key", "fp", "id")
    df = frame(spark, corpus[:20])
    for c in taken:
        df = df.withColumn(c, F.lit(c))
    lines = line_dedup.dedup_lines(df, min_docs=2)
    assert lines.columns == [c for c in df.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    passages = substring_dedup.dedup_passages(df)
    encoded = bpe.encode(df, queries.byte_bpe_path())
    y = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of the kind is in any of these texts")], "item_id long, text string")
    clean = decontamination.without_leaks(toxicity.without_toxic(df, y), bench)
    assert clean.columns == df.columns
    single = simhash.one_each(df)
    assert single.columns == df.columns
    for out in (lines, passages, encoded, clean, single):
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in taken if c in out.columns and out.schema[c].dataType.simpleString() == "string")
