"""The store's assertions on small logs, and random logs against a dictionary."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.operators import commands, replicas, segments, state

OPS = "seq long, op string, key string, value string"


def log(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], OPS)


def model(rows):
    out = {}
    for op, k, v in rows:
        if op == "PUT" and v:
            out[k] = v
        else:
            out.pop(k, None)
    return out


def kv(df):
    return {r.key: r.value for r in df.collect()}


def test_overwrite_delete_and_empty_value(spark):
    rows = [("PUT", "a", "1"), ("PUT", "b", "2"), ("PUT", "a", "3"), ("DEL", "b", None), ("PUT", "c", "x"), ("PUT", "c", "")]
    df = log(spark, rows)
    assert kv(state.current_state(df)) == {"a": "3"}
    asked = spark.createDataFrame([(k,) for k in "abcz"], "key string")
    assert {r.key: r.status for r in state.lookup_status(df, asked).collect()} == {"a": 0, "b": -2, "c": -2, "z": -1}
    assert state.tombstone_counts(df).first().asDict() == {"n_all": 3, "n_live": 1, "n_tombstones": 2}


@pytest.mark.parametrize(
    "start, end, want",
    [("b", "d", "bcd"), (None, "b", "ab"), ("d", None, "de"), ("", "", "abcde"), ("d", "b", ""), ("c", "c", "c"), ("bb", "cc", "c")],
)
def test_bounds_are_closed(spark, start, end, want):
    df = log(spark, [("PUT", k, k) for k in "edcba"])
    assert [r.key for r in state.scan(df, start, end).collect()] == list(want)


def test_scan_after_deletes_and_puts_across_the_boundary(spark):
    rows = [("PUT", f"key_{i:08d}", f"v{i}") for i in range(500)] + [("DEL", f"key_{i:08d}", None) for i in range(100)] + [("PUT", f"key_{i:08d}", "again") for i in range(50, 55)]
    got = [r.key for r in state.scan(log(spark, rows)).collect()]
    assert got == [f"key_{i:08d}" for i in [*range(50, 55), *range(100, 500)]]


@pytest.mark.parametrize("count, size", [(None, 10), (0, 10), (-5, 10), (7, 7), (5000, 1000)])
def test_page_size(count, size):
    assert state.page_size(count) == size


def test_pages_cover_all_keys_once(spark):
    df = log(spark, [("PUT", f"k{i:03d}", "v") for i in range(57)])
    cursor, got = 0, []
    while True:
        rows = state.scan_page(df, cursor, 20).collect()
        got += [r.key for r in rows]
        cursor = rows[0].next_cursor
        if cursor == 0:
            break
    assert got == [f"k{i:03d}" for i in range(57)]
    assert [r.key for r in state.scan_page(df, -3, 2).collect()] == ["k000", "k001"]
    assert state.scan_page(df, 100, 2).count() == 0


def test_commands(spark):
    df = log(spark, [("PUT", "a", "1"), ("PUT", "b", "2"), ("DEL", "b", None)])
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "key string")
    assert commands.exists_count(df, asked).first().n == 2
    assert commands.del_count(spark.createDataFrame([("a",), ("q",), ("",)], "key string")).first().n == 2
    assert {r.key: r.reply for r in commands.get_replies(df, asked.distinct()).collect()} == {"a": "$1\r\n1\r\n", "b": "$-1\r\n", "z": "$-1\r\n"}


@pytest.mark.parametrize("pattern, want", [("*", ["a.c", "abc", "abcd", "b[c"]), ("a?c", ["a.c", "abc"]), ("a.c", ["a.c"]), ("b[c", ["b[c"]), ("*c*", ["a.c", "abc", "abcd", "b[c"]), ("a*d", ["abcd"])])
def test_glob(spark, pattern, want):
    df = log(spark, [("PUT", k, "v") for k in ("abc", "a.c", "abcd", "b[c")])
    assert [r.key for r in commands.keys(df, pattern).collect()] == want


def test_flush_all(spark):
    df = log(spark, [("PUT", k, "v") for k in "abc"])
    assert state.current_state(state.flush_all(df)).count() == 0
    assert state.current_state(state.flush_all(df.limit(0))).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["PUT", "DEL"]), st.sampled_from("abcdef"), st.sampled_from(["", "1", "2"])), min_size=1, max_size=60), st.integers(0, 60))
def test_random_logs(spark, rows, cut):
    df = log(spark, rows)
    assert kv(state.current_state(df)) == model(rows)
    assert kv(replicas.snapshot(df, cut - 1)) == model(rows[:cut])
    seg = df.withColumn("file_id", (F.col("seq") / 7).cast("long")).withColumn("level", (2 - F.least(F.col("file_id"), F.lit(2))).cast("int"))
    assert kv(segments.merge(seg)) == model(rows)
    assert kv(segments.merge(segments.compact_level(seg, 0))) == model(rows)
    assert kv(segments.merge(segments.compact_all(seg))) == model(rows)


def test_diff_and_backup(spark, tmp_path):
    a = log(spark, [("PUT", "a", "1"), ("PUT", "b", "2"), ("PUT", "c", "3")])
    b = log(spark, [("PUT", "b", "2"), ("PUT", "c", "4"), ("PUT", "d", "5")])
    got = {r.key: r.status for r in replicas.diff(state.current_state(a), state.current_state(b)).collect()}
    assert got == {"a": "only_ref", "c": "value_diff", "d": "only_this"}
    replicas.backup(a, str(tmp_path / "b"))
    assert replicas.diff(state.current_state(a), state.current_state(spark.read.parquet(str(tmp_path / "b")))).count() == 0


def test_flush_batches_restart_at_the_limit(spark, small_batches):
    r = random.Random(3)
    rows = [(i, i % 3 % 2, "k", "x" * r.choice([0, 5, 30, 63, 64, 200])) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, part long, key string, value string")
    got = {x.seq: x.batch for x in segments.flush_batches(df, 64).collect()}
    for part in (0, 1):
        batch = used = 0
        for i, p, k, v in rows:
            if p == part:
                assert got[i] == batch
                used += len(k) + len(v)
                if used >= 64:
                    batch, used = batch + 1, 0


def test_prefix_lengths(spark):
    df = spark.createDataFrame([(1, k) for k in ("apple", "apples", "apt", "bar", "éa", "éb")], "file_id long, key string")
    assert {r.key: r.shared for r in segments.prefix_lengths(df).collect()} == {"apple": 0, "apples": 5, "apt": 2, "bar": 0, "éa": 0, "éb": 2}


def test_pages_end_at_a_short_page_alone():
    from tidelog.plans import catalogue

    total = 10_500_250  # keys 0, 1, ...

    def page_after(last):
        first = 0 if last is None else last + 1
        n = min(1000, total - first)
        return None, n, first + n - 1

    pages = list(catalogue.pages_until_short(page_after, 1000))
    assert len(pages) == 10_501 and sum(n for _, _, n, _ in pages) == total
    assert pages[-1][3] == total - 1


def test_stored_logs_and_pages(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.choice(["PUT", "PUT", "DEL"]), f"k{r.randrange(400):03d}", r.choice("abc")) for _ in range(900)]
    df = log(spark, [*rows, ("PUT", "", "x")])
    path = str(tmp_path / "log")
    for part in range(3):
        state.append(df.where(F.col("seq") % 3 == part), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 900 and kv(state.current_state(stored)) == model(rows)
    live = sorted(model(rows))
    pages = state.numbered_pages(state.write_sorted(stored, str(tmp_path / "sorted")), 7).collect()
    assert sorted((x.page, x.pos, x.key) for x in pages) == [(i // 7, i, k) for i, k in enumerate(live)]
    assert state.numbered_pages(state.write_sorted(df.limit(0), str(tmp_path / "none")), 7).count() == 0


def test_scheduler_merges_when_due(spark):
    rows = [(f, 0 if f > 1 else 1, f * 10 + i, "PUT", f"k{i}", str(f)) for f in (1, 2, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "file_id long, level int, seq long, op string, key string, value string")
    assert {(x.file_id, x.level) for x in segments.poll(df).collect()} == {(-6, 6)} and kv(segments.merge(segments.poll(df))) == {f"k{i}": "3" for i in range(4)}
    one = df.where("file_id < 3")
    assert sorted(map(tuple, segments.poll(one).collect())) == sorted(map(tuple, one.collect()))


def test_saved_states_and_footers(spark, tmp_path):
    df = log(spark, [("PUT", f"k{i:03d}", "v") for i in range(300)])
    names = spark.createDataFrame([("Save",), ("BGSAVE",), ("get",)], "name string")
    assert [x.reply for x in commands.save(df, str(tmp_path / "saved"), names).collect()] == ["+OK\r\n", "+OK\r\n", None]
    assert spark.read.parquet(str(tmp_path / "saved")).count() == 300
    segments.write_segments(state.latest(df), str(tmp_path / "seg"))
    files = sorted((x.smallest, x.largest, x.n_rows) for x in segments.read_footers(spark, str(tmp_path / "seg")).where("n_rows > 0").collect())
    assert sum(n for *_, n in files) == 300 and all(a[1] < b[0] for a, b in zip(files, files[1:]))
    got = commands.retries(spark.createDataFrame([(5, 1000)], "seq long, start_us long"), 3).orderBy("attempt").collect()
    assert [(x.at_us, x.node) for x in got] == [(1000, 2), (101_000, 0), (301_000, 1)]


def test_clients_look_for_the_leader_again(spark, small_batches):
    r = random.Random(19)
    rows = [(i, i % 3, r.randrange(0, 60_000_000)) for i in range(300)] + [(900, 7, 5), (901, 7, 5_000_005), (902, 7, 5)]
    want = []
    for c in {x[1] for x in rows}:
        known = None
        for t, i in sorted((t, i) for i, k, t in rows if k == c):
            if known is None or t - known >= 5_000_000:
                known = t
                want.append((c, i))
    got = commands.leader_probes(spark.createDataFrame(rows, "seq long, client_id int, start_us long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert commands.leader_probes(got.select("client_id", "seq", F.lit(0).cast("long").alias("start_us")).limit(0)).count() == 0
