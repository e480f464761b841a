"""The entry points, and the catalogue's queries against DuckDB on small tables."""

import contextlib
from pathlib import Path

import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata/sf0.001")
SAMPLE = ["kv_state", "kv_state_large", "scan_page", "lookup_status", "flushdb", "compact_level", "register_violations", "log_truncate", "commit_index", "replica_diff", "shard_route", "prom_parse", "wal_replay_prefix", "manifest_text", "flush_batches", "cas_apply", "lru_hits", "row_crc32", "bloom_build", "bloom_probe", "scan_numbered_pages", "log_append", "segment_write", "segment_footer", "snapshot_pack", "codec_roundtrip", "compact_scheduled", "cmd_retries", "stream_changes", "stream_windows", "health_json", "raft_propose"]


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, str(DATA))
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and [r.key for r in rows] == sorted(r.key for r in rows)


def test_only_the_queries_of_what_cannot_be_imported_go(monkeypatch):
    """A missing package of the training-data operators leaves all other queries."""
    import sys

    gone = {k for k in __spark_entry__.queries() if k == "pipeline" or (k.startswith("op") and k[2].isdigit())}
    for name in [n for n in sys.modules if n.startswith("tidelog.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.warns(UserWarning) if gone else contextlib.nullcontext():
        left = __spark_entry__.queries()
    assert len(left) > 125 and not gone & set(left)


def test_only_one_machine_may_lack_a_shared_folder():
    from types import SimpleNamespace

    from tidelog.plans.catalogue import scratch

    class Conf(dict):
        set = dict.__setitem__

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch(SimpleNamespace(conf=Conf({"spark.master": master})))
    assert scratch(SimpleNamespace(conf=Conf({"spark.master": "local[2]"}))).startswith("file:///")
    assert scratch(SimpleNamespace(conf=Conf({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x"}))).startswith("hdfs://x/tidelog-")
