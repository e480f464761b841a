"""The pipeline against its stages done by hand on a small corpus."""

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_ops import SCHEMA, Items, brute_simhash  # noqa: E402

from tidelog.llm import toxicity  # noqa: E402
from tidelog.llm.labelled import training_rows  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    shared = "this line is in many documents and it is long enough"
    items = [say(25) for _ in range(5)]
    rows = []
    for i in range(160):
        parts = [say(40) for _ in range(3)]
        if i % 4 == 0:
            words = parts[0].split()
            for k in range(4):
                words[k * 7] = ("nitwit", "buffoon", "blockhead", "dunce")[k]
            parts[0] = " ".join(words)
        if i % 7 == 1:
            parts.insert(1, shared.title())
        if i % 31 == 3:
            parts.append(items[i % 5])
        rows.append((i, "\n".join(parts), "en", "s", 1))
    rows += [(200 + i, rows[9][1], "en", "s", 1) for i in range(5)] + [(300, None, "en", "s", None), (301, "", None, None, 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), {r[0]: r[1] or "" for r in rows}, items, shared


def test_run(spark, folder):
    path, texts, items, shared = folder
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    terms, curve = toxicity.fit(training_rows(docs, labels, "toxic", toxicity.LIMIT))
    matcher = toxicity.Matcher(terms)
    kept = {i: t for i, t in texts.items() if toxicity.probability([matcher.weigh(t.encode())], curve)[0] < toxicity.THRESHOLD}
    assert {i for i in range(160) if i % 4 == 0}.isdisjoint(kept) and len(kept) > 100
    last = max(i for i, t in kept.items() if shared.title() in t.split("\n"))
    kept = {i: t if i == last else "\n".join(x for x in t.split("\n") if x != shared.title()) for i, t in kept.items()}
    many = {}
    for i, t in kept.items():
        for x in set(t.split("\n")):
            many.setdefault(x, []).append(i)
    kept = {i: "\n".join(x for x in t.split("\n") if not (len(x) >= 40 and len(many[x]) >= 5 and max(many[x]) != i)) for i, t in kept.items()}
    ids = sorted(kept)
    _, comp = brute_simhash([kept[i] for i in ids], ids)
    kept = {i: kept[i] for i, c in zip(ids, comp) if i == c}
    found = Items([(n, x.encode()) for n, x in enumerate(items)], 5)
    kept = {i: t for i, t in kept.items() if not found.found(t.encode(), 0.8)}
    rows = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.doc_id for r in rows) == sorted(kept)
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    from tidelog.llm import bpe

    voc = bpe.load_ranks(corpus_pipeline.byte_bpe_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(voc)}, special_tokens={})
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: enc.encode_ordinary(t) for i, t in kept.items()}


def test_stages_keep_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0


def test_ids_that_repeat_and_further_columns(spark, tmp_path):
    """Rows are documents: all different texts survive whatever their ids; other columns go."""
    r = random.Random(14)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts = [say(60) for _ in range(24)] + ["", "x"]
    rows = [(None if n % 9 == 8 else n // 2, t, "en", "s", len(t)) for n, t in enumerate(texts)]
    rows += [(50, texts[0], "en", "s", 1), (0, texts[0], "en", "s", 1), (None, texts[8], "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("ids", "fp", "key", "__tidelog_text"):
        df = df.withColumn(c, df.doc_id)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    from tidelog.llm import bpe

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "ids", "ends", "n_tokens"]
    voc = bpe.load_ranks(corpus_pipeline.byte_bpe_path())
    decoded = [b"".join(voc[i] for i in np.frombuffer(x.ids, "<u4")).decode() for x in out.collect()]
    assert sorted(decoded) == sorted(texts)
