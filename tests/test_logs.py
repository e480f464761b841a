"""Replicated logs, histories, files, hashes, filters and streams against plain Python."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tidelog.functions import bloom, cache, codecs
from tidelog.operators import history, replication, shard, state
from tidelog.sources import protocol, text, wal
from tidelog.streaming import apply


def test_commit_needs_a_quorum_and_the_current_term(spark):
    log = spark.createDataFrame([(1 + (i > 5), i) for i in range(1, 11)], "term long, idx long")
    peers = lambda *m: spark.createDataFrame(list(enumerate(m)), "node int, match_index long")
    assert replication.commit_index(log, peers(10, 8, 3)).first()[0] == 8
    assert replication.commit_index(log, peers(10, 5, 5)).first()[0] == 0  # only an old term's entries
    assert replication.commit_index(log, peers(10, 9, 7, 2, 2)).first()[0] == 7
    assert replication.commit_index(log, peers(10, 9, 7, 2)).first()[0] == 7


def test_truncate_follows_arrival(spark):
    r = random.Random(5)
    rows, logs = [], {0: [], 1: []}
    for arrival in range(300):
        node = r.randrange(2)
        own = logs[node]
        term = 1 + arrival // 60
        idx = r.randint(max(1, len(own) - 3), len(own) + 1)
        rows.append((arrival, node, term, idx))
        if idx <= len(own) and own[idx - 1] != term:
            del own[idx - 1 :]
        if idx == len(own) + 1:
            own.append(term)
    got = replication.truncate(spark.createDataFrame(rows, "arrival long, node int, term long, idx long")).collect()
    for node, own in logs.items():
        assert sorted((x.idx, x.term) for x in got if x.node == node) == [(i + 1, t) for i, t in enumerate(own)]


def brute(rows):
    """Reads that neither the last write before nor an overlapping write explains."""
    bad = set()
    for r in rows:
        if r["op"] != "get" or not r["success"]:
            continue
        writes = [w for w in rows if w["op"] == "put" and w["success"] and w["key"] == r["key"]]
        before = [w for w in writes if w["end_us"] <= r["start_us"]]
        beside = [w for w in writes if w["start_us"] <= r["end_us"] and w["end_us"] >= r["start_us"]]
        last = max(before, key=lambda w: (w["end_us"], w["seq"]), default=None)
        if not (last and last["value"] == r["result"]) and all(w["value"] != r["result"] for w in beside):
            bad.add(r["seq"])
    return bad


def test_register_check_fires_and_is_exact(spark):
    r = random.Random(9)
    rows = []
    for seq in range(400):
        start = r.randint(0, 20_000_000_000)
        op = r.choice(["put", "get"])
        rows.append({"op": op, "key": r.choice("ab"), "value": r.choice("xyz") if op == "put" else None, "start_us": start, "end_us": start + r.choice([0, 1000, 200_000_000]), "success": r.random() < 0.9, "result": r.choice("xyz") if op == "get" else None, "client_id": 0, "seq": seq})
    df = spark.createDataFrame(rows, "op string, key string, value string, start_us long, end_us long, success boolean, result string, client_id long, seq long")
    want = brute(rows)
    assert want and {x.seq for x in history.register_violations(df).collect()} == want
    assert history.register_violations(df.limit(0)).count() == 0


def test_overlaps_of_operations_of_all_lengths(spark):
    """From none to years: the pairs are those of a plain loop, and a long operation has few rows."""
    r = random.Random(12)
    year = 365 * 86_400_000_000
    make = lambda n: [(i, r.choice("ab"), s, s + r.choice([0, 1, 59_999_999, 60_000_000, 4_000_000_000, 10**12, year, 3 * year]), "v") for i in range(n) for s in [r.randrange(0, 4 * year)]]
    probes, writes = make(120), make(150)
    schema = "seq long, key string, start_us long, end_us long, value string"
    got = history.overlapping(spark.createDataFrame(probes, schema), spark.createDataFrame(writes, schema))
    want = sorted((p[0], w[0]) for p in probes for w in writes if p[1] == w[1] and w[2] <= p[3] and w[3] >= p[2])
    assert sorted(map(tuple, got.select("seq", "write_seq").collect())) == want and len(want) > 1000
    none = spark.createDataFrame([], schema)
    assert history.overlapping(none, none).count() == 0


def test_rows_before_in_stretches(spark):
    from tidelog.operators import ordered

    r = random.Random(13)
    rows = [(r.choice("ab"), i, r.choice([None, 1, 2]), r.random() < 0.3) for i in r.sample(range(5000), 300)]
    df = spark.createDataFrame(rows, "k string, i long, v long, f boolean")
    want = []
    for k in "ab":
        own = sorted((i, v, f) for kk, i, v, f in rows if kk == k)
        want += [(k, i, own[n - 1][1] if n else None, own[n - 1][0] if n else None, sum(x[2] for x in own[: n + 1])) for n, (i, *_) in enumerate(own)]
    for size in (1, 40, 1000, 10_000):
        part = F.expr(f"i div {size}")
        got = ordered.running_count(ordered.with_previous(df, "k", ["i"], part, pv="v", pi="i"), "k", ["i"], part, "f", "n")
        assert sorted(map(tuple, got.select("k", "i", "pv", "pi", "n").collect())) == sorted(want)


def test_wal_stops_at_damage(spark):
    records = [("PUT", b"k%d" % i, b"v" * i) for i in range(5)] + [("DEL", b"k1", None)]
    raw = [wal.encode_record(*r) for r in records]
    whole = b"".join(raw)
    assert list(wal.decode_records(whole)) == [(o, k, v or None) for o, k, v in records]
    for cut in (1, 3, len(raw[-1]) - 1):
        assert len(list(wal.decode_records(whole[:-cut]))) == 5
    hurt = bytearray(whole)
    hurt[len(raw[0]) + len(raw[1]) + 12] ^= 1
    assert len(list(wal.decode_records(bytes(hurt)))) == 2
    files = spark.createDataFrame([(1, bytes(hurt)), (2, whole), (3, b"")], "file_seq long, content binary")
    assert [(x.file_seq, x["count"]) for x in wal.replay(files).groupBy("file_seq").count().orderBy("file_seq").collect()] == [(1, 2), (2, 6)]


def test_wal_directory(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"wal_{i}.log").write_bytes(wal.encode_record("PUT", b"k", b"%d" % i))
    assert {(x.file_seq, x.value) for x in wal.read(spark, str(tmp_path)).collect()} == {(1, "1"), (2, "2")}


def test_frames():
    assert protocol.parse_frame(b"*2\r\n$3\r\nGET\r\n$2\r\n\xc3\xa9\r\n") == ["GET", "é"]
    assert protocol.parse_frame(b"*1\r\n$-1\r\n") == [None]
    for broken in (b"", b"*1\r\n$5\r\nabc\r\n", b"+OK\r\n", b"*300\r\n", b"?1\r\n"):
        assert protocol.parse_frame(broken) is None


def test_hashes(spark):
    keys = ["", "a", "key_1", "é", "x" * 50]

    def signed(b):
        return b - 256 if b > 127 else b

    def model(k):
        a, h = 0x811C9DC5, 0
        for b in k.encode():
            a = ((a ^ (signed(b) & 0xFFFFFFFF)) * 0x01000193) & 0xFFFFFFFF
            h = (h * 33 + signed(b)) & 0xFFFFFFFF
        return a, h

    a, b = codecs.key_hashes([k.encode() for k in keys])
    assert [(int(x), int(y)) for x, y in zip(a, b)] == [model(k) for k in keys]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert {r.key: r.h for r in df.select("key", shard.key_hash(F.col("key")).alias("h")).collect()} == {k: int(hashlib.md5(k.encode()).hexdigest(), 16) & 0x7FFFFFFF for k in keys}
    assert df.select(F.crc32(F.lit("123456789").cast("binary"))).first()[0] == 0xCBF43926 == zlib.crc32(b"123456789")


def test_hashes_of_keys_of_all_lengths():
    """Few very long keys among many short ones: memory is that of the keys."""
    import time
    import tracemalloc

    r = random.Random(2)
    keys = [bytes(r.randrange(256) for _ in range(r.randint(0, 40))) for _ in range(500)] + [b"", bytes(range(256)) * 8000]
    tracemalloc.start()
    began = time.perf_counter()
    a, b = codecs.key_hashes(keys)
    assert tracemalloc.get_traced_memory()[1] < 100e6 and time.perf_counter() - began < 30
    tracemalloc.stop()
    for k, x, y in zip(keys[::50] + keys[-2:], a[::50].tolist() + a[-2:].tolist(), b[::50].tolist() + b[-2:].tolist()):
        h, t = 0x811C9DC5, 0
        for c in k:
            c = c - 256 if c > 127 else c
            h, t = ((h ^ (c & 0xFFFFFFFF)) * 0x01000193) & 0xFFFFFFFF, (t * 33 + c) & 0xFFFFFFFF
        assert (x, y) == (h, t)
    assert len(codecs.key_hashes([])[0]) == 0


def test_filters_are_sized_by_their_keys(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    assert bloom.sized(keys) == bloom.params(3000, 0.01) and bloom.sized(keys.limit(0)) == bloom.params(1, 0.01)


def test_least_recently_used(spark, small_batches):
    from collections import OrderedDict

    r = random.Random(4)
    rows = [(i, i % 2, f"k{r.randrange(12)}") for i in range(400)]
    want = {}
    for part in (0, 1):
        held, hits = OrderedDict(), 0
        for _, p, k in rows:
            if p == part:
                hits += k in held
                held.pop(k, None)
                held[k] = 1
                if len(held) > 5:
                    held.popitem(last=False)
        want[part] = (hits, 200 - hits)
    df = spark.createDataFrame(rows, "seq long, part long, key string").orderBy(F.rand(1))
    assert {x.part: (x.hits, x.misses) for x in cache.lru_hits(df, 5).collect()} == want


def test_blocks_and_snapshot_files(spark):
    from tidelog.sources import snapshot

    blocks = [b"", b"a", b"abc" * 5000, bytes(range(256)) * 900]
    df = spark.createDataFrame([(i, c, b) for i, b in enumerate(blocks) for c in (0, 1, 2)], "id long, codec int, content binary")
    packed = df.withColumn("packed", codecs.compress(F.col("codec"), F.col("content"))).withColumn("size", F.octet_length("content").cast("long"))
    rows = packed.withColumn("back", codecs.decompress(F.col("codec"), F.col("packed"), F.col("size"))).withColumn("most", codecs.compress_bound(F.col("codec"), F.col("size"))).collect()
    assert all(x.back == x.content and len(x.packed) <= x.most for x in rows)
    assert all(len(x.packed) < 0.2 * x.size for x in rows if x.id == 2 and x.codec)
    raw = snapshot.pack_files(7, 3, [("catalog", b"x"), ("é", b""), ("seg", blocks[3])])
    assert list(snapshot.unpack_files(raw)) == [(7, 3, "catalog", b"x"), (7, 3, "é", b""), (7, 3, "seg", blocks[3])]
    assert raw[:16] == bytes([7, 0, 0, 0, 0, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0]) and raw[-4:] == bytes(4)
    for cut in (0, 10, 17, 30, len(raw) - 10):
        assert len(list(snapshot.unpack_files(raw[:cut]))) == (0 if cut < 34 else 2)
    files = spark.createDataFrame([(n, f"f{i}", b) for n in (0, 1) for i, b in enumerate(blocks)], "node int, name string, content binary")
    back = snapshot.unpack(snapshot.pack(files, 9, 2)).collect()
    assert sorted((x.node, x.name, bytes(x.content)) for x in back) == sorted((x.node, x.name, bytes(x.content)) for x in files.collect())
    assert {(x.last_included_index, x.last_included_term) for x in back} == {(9, 2)}


def test_state_tables_merge_their_deltas(spark, tmp_path):
    """Bases and deltas give the same rows however often they are merged, and old ones go."""
    r = random.Random(8)
    rows = [(i, r.choice(["PUT", "PUT", "DEL"]), f"k{r.randrange(9)}", str(i)) for i in range(140)]
    log = spark.createDataFrame(rows, "seq long, op string, key string, value string")
    for part in range(7):
        log.where(F.col("seq") % 7 == (part * 3) % 7).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, state.latest(log).collect()))
    for every in (1, 2, 3, 100):
        path = str(tmp_path / f"t{every}")
        apply.maintain_table(apply.read_log(spark, str(tmp_path / "in"), 1), path, str(tmp_path / f"c{every}"), every).awaitTermination()
        assert sorted(map(tuple, apply.read_table(spark, path).collect())) == want
        assert apply.read_table(spark, path, before=0) is None
        left = sorted(x.name for x in (tmp_path / f"t{every}").iterdir() if "=" in x.name)
        assert left == {1: ["base=5", "base=6"], 2: ["base=3", "base=5", "delta=4", "delta=6"], 3: ["base=2", "base=5", "delta=3", "delta=4", "delta=6"], 100: [f"delta={i}" for i in range(7)]}[every]


def test_ring_routes_like_bisection(spark):
    import bisect

    h = lambda s: int(hashlib.md5(s.encode()).hexdigest(), 16) & 0x7FFFFFFF
    ring = {h(f"node_{n}_vnode_{v}"): n for n in range(3) for v in range(20)}
    points = sorted(ring)
    keys = [f"user:{i}" for i in range(300)]
    got = {r.key: r.node for r in shard.route(spark.createDataFrame([(k,) for k in keys], "key string"), shard.ring(spark, 3, 20)).collect()}
    assert got == {k: ring[points[bisect.bisect_left(points, h(k)) % len(points)]] for k in keys}


def test_varints(spark):
    numbers = [0, 1, 127, 128, 16383, 16384, 2**35 - 1, 2**35, 2**62]
    for n in numbers:
        raw = codecs.encode_varint(n)
        assert codecs.decode_varint(raw) == (n, len(raw))
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert {r.n: r.k for r in df.select("n", codecs.varint_length(F.col("n")).alias("k")).collect()} == {n: len(codecs.encode_varint(n)) for n in numbers}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    raw = bytes(bloom.build(keys, *bloom.params(2000, 0.01)).first()[0])
    assert bloom.serialize(*bloom.deserialize(raw)) == raw
    asked = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") < 2000).alias("there"))
    rows = asked.withColumn("may", bloom.may_contain(raw, F.col("key"))).groupBy("there", "may").count().collect()
    counts = {(r.there, r.may): r["count"] for r in rows}
    assert (True, False) not in counts
    assert counts.get((False, True), 0) < 0.05 * 4000


def test_reports(spark):
    # Fixed lines of the benchmark's report format.
    lines = ["Write 5000 entries, cost 0.123 sec, 40650 ops/sec", "Read 1000 random keys, hit 999, miss 1, cost 0.001 sec", "Scan all keys: 5000 entries found", "Data integrity check: 0 errors found", "noise"]
    got = text.parse_benchmark(spark.createDataFrame([(x,) for x in lines], "line string")).first().asDict()
    assert got == {"write_ops_per_sec": 40650.0, "write_time_sec": 0.123, "read_hits": 999, "read_misses": 1, "read_time_sec": 0.001, "scan_count": 5000, "verify_errors": 0}
    sample = spark.createDataFrame([("# HELP a b",), ("a 1",), ("b x",), ("c 2.5",), ("",)], "line string")
    assert {(r.name, r.value) for r in text.parse_metrics(sample).collect()} == {("a", 1.0), ("c", 2.5)}


def test_streams_equal_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.choice(["PUT", "PUT", "DEL"]), f"k{r.randrange(9)}", str(i)) for i in range(120)]
    log = spark.createDataFrame(rows, "seq long, op string, key string, value string")
    for part in (2, 0, 1):
        log.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(x.key, x.value) for x in state.current_state(log).collect()}
    stream = lambda: apply.read_log(spark, str(tmp_path / "in"), 1)
    apply.stream_state(stream(), "live_keys", str(tmp_path / "c1")).awaitTermination()
    assert {(x.key, x.value) for x in spark.table("live_keys").collect()} == want
    apply.maintain_table(stream(), str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination()
    assert {(x.key, x.value) for x in state.current_state(apply.read_table(spark, str(tmp_path / "t"))).collect()} == want
    q = apply.stream_changes(stream()).writeStream.outputMode("update").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(x.key, x.value) for x in state.current_state(spark.table("changes")).collect()} == want


def test_propose_appends_in_order(spark):
    log = spark.createDataFrame([(1, 1, "PUT", "a", "1"), (1, 2, "PUT", "b", "2")], "term long, idx long, op string, key string, value string")
    new = spark.createDataFrame([(5, "DEL", "a", None), (3, "PUT", "c", "9")], "order long, op string, key string, value string")
    got = [(r.term, r.idx, r.key) for r in replication.propose(log, new, 2).orderBy("idx").collect()]
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 3, "c"), (2, 4, "a")]
    assert [r.idx for r in replication.propose(log.limit(0), new, 1).orderBy("idx").collect()] == [1, 2]


def test_log_is_up_to_date(spark):
    df = spark.createDataFrame([(3, 1, True), (2, 9, True), (2, 8, False), (1, 99, False)], "term long, idx long, want boolean")
    ok = replication.up_to_date(F.col("term"), F.col("idx"), F.lit(2).cast("long"), F.lit(9).cast("long"))
    assert all(r.ok == r.want for r in df.select("want", ok.alias("ok")).collect())


def test_catalog_of_files(spark):
    from tidelog.operators import segments

    files = spark.createDataFrame([(1, 0, 10, "a", "k"), (2, 1, 20, "é,x", "z")], "file_id long, level int, file_size long, smallest string, largest string")
    back = text.parse_manifest(text.manifest_lines(files).union(spark.createDataFrame([("version=3",), ("file=broken",)], "line string")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, files.collect()))
    gone = segments.remove_files(files, files.where("file_id = 1"))
    assert [r.file_id for r in gone.collect()] == [2] and segments.list_files(files).count() == 2
    assert segments.add_files(gone, files.where("file_id = 1")).count() == 2
    assert segments.next_file_id(files).first()[0] == 3 and segments.next_file_id(files.limit(0)).first()[0] == 1
    assert [r.file_id for r in segments.prune(files, "b").collect()] == [1]


def test_cas_and_increments(spark, small_batches):
    rows = [("put", "v0"), ("cas", "v0->w"), ("cas", "v0->x"), ("inc", None), ("inc", None), ("cas", "bad")]
    df = spark.createDataFrame([(i, "k", op, v, i, True) for i, (op, v) in enumerate(rows)], "seq long, key string, op string, value string, end_us long, success boolean")
    got = [(r.applied, r.value) for r in history.apply_register_ops(df).orderBy("seq").collect()]
    assert got == [(True, "v0"), (True, "w"), (False, "w"), (True, "1"), (True, "2"), (False, "2")]
