"""All queries over the driver tables, each with the SQL that gives the same rows in DuckDB.

Where a query writes and reads files or streams, its SQL states the rows that must come back.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import bloom, cache, codecs
from tidelog.operators import commands, history, metrics, replicas, replication, segments, shard, state
from tidelog.plans import fixtures as fx
from tidelog.plans.fixtures import sql
from tidelog.sources import protocol, snapshot, text, wal

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, *views: str):
    """Register a function (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, *views)
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share.  Only a session of one machine may leave spark.checkpoint.dir
    unset: then a local folder is taken."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidelog-{uuid.uuid4().hex}"


LIVE = "op='PUT' and value<>''"

# --- state and point access


@query("select seq, op, key, value from ops", "ops")
def op_log(spark, d):
    return fx.ops(spark, d)


@query("select key, value, seq from state_a", "state_a")
def kv_state(spark, d):
    return state.scan(fx.ops(spark, d))


@query(f"select key, value, seq from {fx.LAST.format('ops_l')} where rn=1 and {LIVE}", "ops_l")
def kv_state_large(spark, d):
    return state.current_state(fx.ops_large(spark, d))


@query(f", al as (select * from ops union all select seq+1+(select max(seq) from ops), 'PUT', concat('new:',key), value from ops where value is not null) select key,value,seq from {fx.LAST.format('al')} where rn=1 and {LIVE}", "ops")
def apply_puts(spark, d):
    """A batch as long as the log itself, under new keys."""
    log = fx.ops(spark, d)
    end = fx.share_of_log(spark, d, 10)
    rows = log.select((F.col("seq") + end + 1).alias("seq"), F.concat(F.lit("new:"), "key").alias("key"), "value")
    return state.current_state(state.apply_puts(log, rows))


@query(f", al as (select * from ops union all select row_number() over (order by key)+(select max(seq) from ops), 'DEL', key, null from (select distinct key from asked)) select key,value,seq from {fx.LAST.format('al')} where rn=1 and {LIVE}", "ops", "asked")
def apply_deletes(spark, d):
    """All keys that clients ask for are deleted, whether or not they exist."""
    log = fx.ops(spark, d)
    end = fx.share_of_log(spark, d, 10)
    rows = fx.asked(spark, d).distinct().select((F.xxhash64("key").bitwiseAND((1 << 40) - 1) + end + 1).alias("seq"), "key")
    return state.current_state(state.apply_deletes(log, rows))


@query("select key, value, seq from state_a", "state_a")
def log_append(spark, d):
    """A stored log that grows by two appends."""
    path, log, middle = scratch(spark), fx.ops(spark, d), fx.share_of_log(spark, d, 5)
    state.append(log.where(F.col("seq") <= middle), path)
    state.append(log.where(F.col("seq") > middle), path)
    return state.current_state(spark.read.schema(log.schema).parquet(path))


@query("select l.key, case when a.key is null then value end as value, a.key is not null as hidden, count(*) over () as entries from last l left join (select distinct key from asked) a using (key)", "last", "asked")
def memtable_hide(spark, d):
    """Entries that are removed by a flag: they answer nothing and still count."""
    rows = state.hide(state.latest(fx.ops(spark, d)), fx.asked(spark, d))
    entries = rows.agg(F.count("*").alias("entries"))
    return rows.select("key", F.when(~F.col("hidden"), F.col("value")).alias("value"), "hidden").join(F.broadcast(entries))


@query("select key,value,seq from state_a where key='user:00000017'", "state_a")
def get_point(spark, d):
    return state.get(fx.ops(spark, d), "user:00000017")


@query("select a.key, s.value, s.seq from asked a left join state_a s using (key)", "state_a", "asked")
def get_multi(spark, d):
    return state.get_many(fx.ops(spark, d), fx.asked(spark, d))


@query("select key,op,value,seq from last", "last")
def upsert_lww(spark, d):
    return state.latest(fx.ops(spark, d))


@query(f"select a.key, case when l.key is null then -1 when {LIVE} then 0 else -2 end as status from asked a left join last l using (key)", "last", "asked")
def lookup_status(spark, d):
    return state.lookup_status(fx.ops(spark, d), fx.asked(spark, d))


@query("select count(*) as entries, cast(sum(strlen(key)+coalesce(strlen(value),0)) as bigint) as bytes from last", "last")
def memtable_stats(spark, d):
    return state.memory_stats(fx.ops(spark, d))


@query(f"select count(*) as n_all, count(*) filter (where {LIVE}) as n_live, count(*) filter (where not coalesce({LIVE}, false)) as n_tombstones from last", "last")
def tombstone_count(spark, d):
    return state.tombstone_counts(fx.ops(spark, d))


@query("select key,value,seq from state_a where key between 'user:00000010' and 'user:00000050'", "state_a")
def scan_range(spark, d):
    return state.scan(fx.ops(spark, d), "user:00000010", "user:00000050")


@query("select key,value,seq from state_a", "state_a")
def scan_full(spark, d):
    return state.scan(fx.ops(spark, d))


@query("select key,value,seq from state_a where key>='user:00000030' order by key limit 100", "state_a")
def scan_limit(spark, d):
    return state.scan_limit(fx.ops(spark, d), "user:00000030", None)


@query("select pos, key, value, case when n>45 then cast(45 as bigint) else 0 end as next_cursor from (select row_number() over (order by key) as pos, count(*) over () as n, key, value from state_a) where pos between 21 and 45", "state_a")
def scan_page(spark, d):
    return state.scan_page(fx.ops(spark, d), 20, 25)


def pages_until_short(page_after, size: int):
    """(last key before a page, the page, its rows, its last key) of all pages; page_after(last) gives
    a page, its rows and its last key.  The page with fewer than `size` rows is the last."""
    last, n = None, size
    while n >= size:
        page, n, key = page_after(last)
        yield last, page, n, key
        last = key


@query("select key,value,seq from state_a", "state_a")
def scan_all_pages(spark, d):
    """A client's walk: pages after the last key, until one is short, over a state that is written once
    in key order, so a page reads the files that its bounds admit."""
    rows = state.write_sorted(fx.ops(spark, d), scratch(spark)).select("key", "value", "seq")

    def page_after(last):
        page = (rows if last is None else rows.where(F.col("key") > last)).orderBy("key").limit(1000)
        return page, *page.agg(F.count("*"), F.max("key")).first()

    pages = []
    for last, page, n, key in pages_until_short(page_after, 1000):
        pages.append(state.between(rows, None, key).where(F.lit(True) if last is None else F.col("key") > last) if n else page)
    return metrics.union_all(pages)


@query("select (row_number() over (order by key)-1)//25 as page, row_number() over (order by key)-1 as pos, key, value, seq from state_a", "state_a")
def scan_numbered_pages(spark, d):
    """All pages of a walk in one plan."""
    return state.numbered_pages(state.write_sorted(fx.ops(spark, d), scratch(spark)), 25)


# --- commands


@query("select a.key, case when s.value is null then '$-1'||chr(13)||chr(10) else '$'||strlen(s.value)||chr(13)||chr(10)||s.value||chr(13)||chr(10) end as reply from asked a left join state_a s using (key)", "state_a", "asked")
def cmd_set_get(spark, d):
    return commands.get_replies(fx.ops(spark, d), fx.asked(spark, d))


@query("select count(*) as n from asked where key<>''", "asked")
def cmd_del_count(spark, d):
    return commands.del_count(fx.asked(spark, d))


@query("select count(*) as n from (select key from asked union all select key from asked) a join state_a s using (key)", "state_a", "asked")
def exists_count(spark, d):
    keys = fx.asked(spark, d)
    return commands.exists_count(fx.ops(spark, d), keys.union(keys))


@query("select key from state_a where key glob 'user:0000?0*1'", "state_a")
def keys_glob(spark, d):
    return commands.keys(fx.ops(spark, d), "user:0000?0*1")


@query("select count(*) as n from state_a", "state_a")
def dbsize(spark, d):
    return commands.dbsize(fx.ops(spark, d))


@query("select count(*) as n_all, cast(0 as bigint) as n_live, count(*) as n_tombstones from last", "last")
def flushdb(spark, d):
    return state.tombstone_counts(state.flush_all(fx.ops(spark, d)))


STATIC_ROWS = "select * from (values ('PING'),('Quit'),('command'),('INFO'),('GET')) t(name)"


@query("select name, case lower(name) when 'ping' then '+PONG'||chr(13)||chr(10) when 'quit' then '+OK'||chr(13)||chr(10) when 'command' then '+OK'||chr(13)||chr(10) when 'info' then '$'||strlen(i)||chr(13)||chr(10)||i||chr(13)||chr(10) end as reply from (" + STATIC_ROWS + "), (select replace('" + commands.INFO.replace("\r\n", "~") + "', '~', chr(13)||chr(10)) as i)")
def cmd_static(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("PING", "Quit", "command", "INFO", "GET")], "name string")
    return rows.select("name", commands.static_reply(F.col("name")).alias("reply"))


@query(f"select event_id as id, name, name in {commands.COMMANDS} as known, case when name not in {commands.COMMANDS} then '-ERR unknown command '''||name||''''||chr(13)||chr(10) end as reply from (select event_id, case event_type when 'view' then 'get' when 'click' then 'set' when 'purchase' then 'ping' else event_type end as name from events)")
def cmd_dispatch(spark, d):
    kind = F.col("event_type")
    name = F.when(kind == "view", "GET").when(kind == "click", "Set").when(kind == "purchase", "PING").otherwise(F.upper(kind))
    return commands.dispatch(fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.array(name, F.lit("x")).alias("argv")))


@query("select name, '+OK'||chr(13)||chr(10) as reply, (select count(*) from last) as saved from (values ('SAVE'),('BGSAVE')) t(name)", "last")
def cmd_save(spark, d):
    path = scratch(spark)
    replies = commands.save(fx.ops(spark, d), path, spark.createDataFrame([("SAVE",), ("BGSAVE",)], "name string"))
    return replies.join(F.broadcast(spark.read.parquet(path).agg(F.count("*").alias("saved"))))


@query("select seq, a::integer as attempt, start_us + (power(2,a)::bigint-1)*100000 as at_us, (seq+a)%3 as node from hist, range(3) t(a) where not success", "hist")
def cmd_retries(spark, d):
    """Attempts of the operations that failed."""
    return commands.retries(fx.history(spark, d).where("not success"), 3)


@query()
def client_probes(spark, d):
    """When each client looks for the leader again: what it knows holds for an hour here."""
    return commands.leader_probes(fx.history(spark, d), 3_600_000_000)


ORACLES["client_probes"] = f"with recursive hist as ({fx.SQL['hist']}), a as (select client_id, seq, start_us, row_number() over (partition by client_id order by start_us, seq) as i from hist), jumps as (select a.*, b.i as j from a asof left join (select client_id, start_us, min(i) as i from a group by 1, 2) b on a.client_id=b.client_id and a.start_us+3600000000<=b.start_us), f as (select client_id, seq, j from jumps where i=1 union all select n.client_id, n.seq, n.j from f join jumps n on n.client_id=f.client_id and n.i=f.j) select client_id, seq from f"


#: What the fixture's quorum holds, and is taken as committed whatever its term; commit_index itself asks for the term.
COMMIT = "(select max(idx)*95//100 from rlog)"
TERM = "(select max(term) from rlog)"


def _commit(spark, d) -> int:
    """The index that a quorum of the peers holds."""
    return (fx.share_of_log(spark, d, 10) + 1) * 95 // 100


def _term(spark, d) -> int:
    return fx.raft_log(spark, d).agg(F.max("term")).first()[0] or 0


STATS = "select (select cast(sum(strlen(key)+coalesce(strlen(value),0)) as bigint) from seg where file_id=(select max(file_id) from seg)) as memtable_size, (select count(*) from manifest) as sstable_count, (select count(*) filter (where op='PUT') - count(*) filter (where op='DEL') from ops) as total_keys, 1 as wal_enabled"


def _stats(spark, d) -> DataFrame:
    seg = fx.segments(spark, d)
    newest = seg.join(F.broadcast(seg.agg(F.max("file_id").alias("m"))), F.col("file_id") == F.col("m"))
    return metrics.engine_stats(fx.ops(spark, d), segments.manifest(seg), newest)


@query(STATS, "manifest")
def engine_stats(spark, d):
    return _stats(spark, d)


@query("select '# Health'||chr(13)||chr(10)||'status:ok'||chr(13)||chr(10)||'memtable_size:'||memtable_size||chr(13)||chr(10)||'sstable_count:'||sstable_count||chr(13)||chr(10)||'total_keys:'||total_keys||chr(13)||chr(10)||'wal_enabled:'||wal_enabled||chr(13)||chr(10) as body from (" + STATS + ")", "manifest")
def health_stats(spark, d):
    return commands.health_text(_stats(spark, d))


@query("select '{\"status\":\"ok\",\"role\":\"leader\",\"raft_term\":'||" + TERM + "||',\"raft_commit_index\":'||" + COMMIT + "||',\"raft_applied_index\":'||" + COMMIT + "||',\"last_snapshot_index\":'||(select max(idx)*6//10 from rlog)||',\"memtable_size\":'||memtable_size||',\"sstable_count\":'||sstable_count||',\"total_keys\":'||total_keys||',\"wal_enabled\":'||wal_enabled||'}' as body from (" + STATS + ")", "manifest", "peers")
def health_json(spark, d):
    """The leader's health: all that it has committed is applied; a snapshot holds six tenths of the log."""
    commit, term = _commit(spark, d), _term(spark, d)
    snapshot_at = (fx.share_of_log(spark, d, 10) + 1) * 6 // 10
    named = _stats(spark, d).withColumns({"role": F.lit("leader"), "raft_term": F.lit(term), "raft_commit_index": F.lit(commit), "raft_applied_index": F.lit(commit), "last_snapshot_index": F.lit(snapshot_at)})
    return text.health_json(named)


@query(
    """recursive hist as ({hist}), sized as (select seq, key, op, value, row_number() over (partition by key order by end_us, seq) as i from hist where success and op in ('put','cas','inc')),
    f as (select key, cast(0 as bigint) as i, cast(null as bigint) as seq, true as applied, cast(null as varchar) as value from sized where i=1 union all
      select s.key, s.i, s.seq, case when s.op<>'cas' then true else coalesce(strpos(s.value,'->')>0 and coalesce(f.value,'')=left(s.value, strpos(s.value,'->')-1), false) end,
        case when s.op='put' then s.value when s.op='inc' then cast(case when regexp_full_match(coalesce(f.value,''),'[0-9]+') then cast(f.value as bigint) else 0 end + 1 as varchar)
             when coalesce(strpos(s.value,'->')>0 and coalesce(f.value,'')=left(s.value, strpos(s.value,'->')-1), false) then substr(s.value, strpos(s.value,'->')+2) else f.value end
      from f join sized s on s.key=f.key and s.i=f.i+1)
    select seq, key, applied, value from f where i>0""".replace("recursive", "with recursive", 1).replace("{hist}", fx.SQL["hist"])
)
def cas_apply(spark, d):
    return history.apply_register_ops(fx.history(spark, d))


@query("select * from hist where success", "hist")
def history_ok(spark, d):
    return history.successful(fx.history(spark, d))


# --- logs, files and formats


def _wal_rows(spark, d) -> DataFrame:
    return fx.ops(spark, d).withColumn("file_seq", F.floor(F.col("seq") / 1000))


@query("select file_seq, pos, op, key, nullif(value,'') as value from (select cast(floor(seq/1000) as bigint) as file_seq, seq%1000 as pos, op, key, value from ops) where not (file_seq=3 and pos>=500) and not (file_seq=7 and pos>=999)", "ops")
def wal_replay_prefix(spark, d):
    """Files are written, one loses a byte in a record, another its last byte, and all are replayed."""
    rows = _wal_rows(spark, d)
    before = rows.where("file_seq = 3 and seq % 1000 < 500").agg(F.coalesce(F.sum(wal.record_bytes()), F.lit(0)).alias("at"))
    files = wal.encode(rows).join(F.broadcast(before))
    hurt = F.expr("concat(substring(content, 1, cast(at + 10 as int)), X'00', substring(content, cast(at + 12 as int)))")
    torn = F.expr("substring(content, 1, octet_length(content) - 1)")
    damaged = F.when(F.col("file_seq") == 3, hurt).when(F.col("file_seq") == 7, torn).otherwise(F.col("content"))
    return wal.replay(files.select("file_seq", damaged.alias("content")))


@query("select cast(floor(seq/1000) as bigint) as file_seq, cast(sum(17+strlen(key)+coalesce(strlen(value),0)) as bigint) as bytes from ops group by 1", "ops")
def wal_size(spark, d):
    return wal.encode(_wal_rows(spark, d)).select("file_seq", F.octet_length("content").cast("long").alias("bytes"))


@query("select cast(floor(seq/1000) as bigint) as file_seq, seq%1000 as pos, op, key, nullif(value,'') as value from ops where seq%1000<100", "ops")
def wal_truncate(spark, d):
    return wal.truncate(wal.replay(wal.encode(_wal_rows(spark, d))), 100)


@query("select key, value, seq from state_a", "state_a")
def wal_roll(spark, d):
    """Numbered files replayed in order give the state of the log."""
    rows = wal.replay(wal.encode(_wal_rows(spark, d))).select((F.col("file_seq") * 1000 + F.col("pos")).alias("seq"), "op", "key", "value")
    return state.current_state(rows, unique_seq=False)  # decoding once costs less than a second pass


@query("select file_id, key, case when i%16=0 or prev is null then 0 else coalesce(list_max(list_filter(range(1, strlen(key)+1), lambda n: left(key, n)=left(prev, n))), 0) end::integer as shared from (select file_id, key, lag(key) over w as prev, row_number() over w - 1 as i from (select distinct file_id, key from seg) window w as (partition by file_id order by key))", "seg")
def prefix_shared_len(spark, d):
    return segments.prefix_lengths(fx.segments(spark, d))


@query("select key,op,value from (select *, row_number() over (partition by key order by seq desc) as rn from seg where file_id=4) where rn=1", "seg")
def segment_scan(spark, d):
    return segments.segment_scan(fx.segments(spark, d), 4)


@query("select file_id, min(key) as smallest, max(key) as largest from seg group by file_id", "seg")
def segment_bounds(spark, d):
    return segments.manifest(fx.segments(spark, d)).select("file_id", "smallest", "largest")


@query("select * from manifest", "manifest")
def manifest_text(spark, d):
    """Catalog rows written as a text file and parsed again."""
    path = scratch(spark)
    text.manifest_lines(segments.manifest(fx.segments(spark, d))).write.text(path)
    return text.read_manifest(spark, path)


@query("select file_id, level, file_size, (select max(file_id)+1 from manifest) as next_file_id from manifest where level=2", "manifest")
def manifest_list(spark, d):
    m = segments.manifest(fx.segments(spark, d))
    return segments.list_files(m, 2).select("file_id", "level", "file_size").join(F.broadcast(segments.next_file_id(m)))


@query("select * from manifest where level<>0 union all select (select max(file_id)+1 from manifest), 1, cast(sum(file_size) as bigint), min(smallest), max(largest) from manifest where level=0", "manifest")
def manifest_edit(spark, d):
    """A catalog after the files of level 0 gave way to one of level 1."""
    m = segments.manifest(fx.segments(spark, d))
    gone = segments.list_files(m, 0)
    merged = gone.agg(F.sum("file_size").alias("file_size"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))
    new = merged.join(F.broadcast(segments.next_file_id(m))).select(F.col("next_file_id").alias("file_id"), F.lit(1).alias("level"), "file_size", "smallest", "largest")
    return segments.add_files(segments.remove_files(m, gone), new)


@query("select name, id, case id when 0 then 'none' when 1 then 'zstd' when 2 then 'lz4' else 'unknown' end as back from (select p_type as name, case p_type when 'none' then 0 when 'lz4' then 2 else 1 end as id from (select distinct p_type from part) union all select * from (values ('none',0),('lz4',2),('zstd',1)) t)")
def codec_name(spark, d):
    names = fx.table(spark, d, "part").select(F.col("p_type").alias("name")).distinct().union(spark.createDataFrame([("none",), ("lz4",), ("zstd",)], "name string"))
    return names.select("name", codecs.codec_id(F.col("name")).alias("id")).withColumn("back", codecs.codec_name(F.col("id")))


@query("select coalesce(a.key,b.key) as key, case when b.key is null then 'only_ref' when a.key is null then 'only_this' else 'value_diff' end as status, a.value as ref_value, b.value as this_value from state_a a full join state_b b on a.key=b.key where a.value is distinct from b.value", "state_a", "state_b")
def backup_restore_diff(spark, d):
    """A replica's backup is written, read and compared with the leader's state; the leader's own backup, in the
    same comparison, adds nothing."""
    own, other = scratch(spark), scratch(spark)
    replicas.backup(fx.ops(spark, d), own)
    replicas.backup(fx.ops(spark, d).where("seq % 7 <> 0"), other)
    leader = fx.state_a(spark, d)
    return metrics.union_all([replicas.diff(leader, state.current_state(spark.read.parquet(p))) for p in (own, other)])


@query("select key,value,seq from state_b", "state_b")
def snapshot_import(spark, d):
    """A store's files are replaced by those of another."""
    path = scratch(spark)
    replicas.backup(fx.ops(spark, d), path)
    replicas.backup(fx.ops(spark, d).where("seq % 7 <> 0"), path)
    return state.current_state(spark.read.parquet(path))


@query("select * from rlog where idx>(select max(seq)*6//10 from ops)", "rlog")
def raft_log_load(spark, d):
    return replication.load_after_snapshot(fx.raft_log(spark, d), fx.share_of_log(spark, d, 6))


@query("select " + COMMIT + " as last_included_index, (select term from rlog where idx=" + COMMIT + ") as last_included_term, count(*) as file_count, cast(sum(file_size) as bigint) as total_size from manifest", "manifest", "peers")
def snapshot_meta(spark, d):
    """The side file of a snapshot, through JSON."""
    files = segments.manifest(fx.segments(spark, d)).agg(F.count("*").alias("file_count"), F.sum("file_size").alias("total_size"))
    at = fx.raft_log(spark, d).where(F.col("idx") == _commit(spark, d)).select(F.col("idx").alias("last_included_index"), F.col("term").alias("last_included_term"))
    path = scratch(spark)
    at.join(F.broadcast(files)).coalesce(1).write.json(path)
    return text.read_snapshot_meta(spark, path)


@query("select seq, 3 as argc, 'SET' as name, key, value from ops where value is not null", "ops")
def resp_parse(spark, d):
    """Rows as command frames, parsed again."""
    log = fx.ops(spark, d).where("value is not null")
    frames = log.select("seq", protocol.encode_command(F.lit("SET"), F.col("key"), F.col("value")).alias("frame"))
    argv = frames.select("seq", protocol.parse_command(F.col("frame")).alias("argv"))
    return argv.select("seq", F.size("argv").alias("argc"), *[F.get("argv", F.lit(i)).alias(n) for i, n in enumerate(("name", "key", "value"))])


@query("select key, '+'||'OK'||chr(13)||chr(10) as ok, ':'||seq||chr(13)||chr(10) as num, '$'||strlen(value)||chr(13)||chr(10)||value||chr(13)||chr(10) as bulk, '-ERR '||key||chr(13)||chr(10) as err from state_a", "state_a")
def resp_reply(spark, d):
    s = fx.state_a(spark, d)
    return s.select("key", commands.simple(F.lit("OK")).alias("ok"), commands.integer(F.col("seq")).alias("num"), commands.bulk(F.col("value")).alias("bulk"), commands.error(F.col("key")).alias("err"))


def _node_metrics(spark, d) -> DataFrame:
    """A row of all exposed metrics for each node."""
    node, op = (F.col("seq") % 3).alias("node"), F.col("op")
    log = fx.ops(spark, d)
    agg = log.groupBy(node).agg(
        F.count_if(op == "PUT").alias("kv_puts_total"), F.count_if(op == "DEL").alias("kv_deletes_total"), F.count_if(F.col("seq") % 5 == 0).alias("kv_gets_total"),
        F.count_if(F.col("seq") % 7 == 0).alias("kv_get_misses_total"), F.count_if(F.col("seq") % 11 == 0).alias("kv_scans_total"), F.count("*").alias("raft_log_count"), F.max("seq").alias("raft_last_applied"),
    )
    commit, term = _commit(spark, d), _term(spark, d)
    fixed = {"kv_uptime_seconds": 3600, "kv_compactions_total": 2, "raft_term": term, "raft_commit_index": commit, "raft_snapshot_index": 0}  # uptime and compactions are those of no run
    leader = F.col("node") == 0
    return agg.withColumns({k: F.lit(v).cast("long") for k, v in fixed.items()} | {"raft_state": F.when(leader, 2).otherwise(0), "raft_is_leader": F.when(leader, 1).otherwise(0)})


NODE_METRICS = "select seq%3 as node, count(*) filter (where op='PUT') as kv_puts_total, count(*) filter (where op='DEL') as kv_deletes_total, count(*) filter (where seq%5=0) as kv_gets_total, count(*) filter (where seq%7=0) as kv_get_misses_total, count(*) filter (where seq%11=0) as kv_scans_total, count(*) as raft_log_count, max(seq) as raft_last_applied, 3600 as kv_uptime_seconds, 2 as kv_compactions_total, " + TERM + " as raft_term, " + COMMIT + " as raft_commit_index, 0 as raft_snapshot_index, case when seq%3=0 then 2 else 0 end as raft_state, case when seq%3=0 then 1 else 0 end as raft_is_leader from ops group by seq%3"
EXPOSED_SQL = " || chr(10) || ".join(f"'# HELP {n} {h}' || chr(10) || '# TYPE {n} {k}' || chr(10) || '{n} ' || {n} || chr(10)" for n, k, h in metrics.EXPOSED)


@query(f"select node, {EXPOSED_SQL} as body from ({NODE_METRICS})", "ops", "peers")
def prom_text(spark, d):
    return metrics.prometheus_text(_node_metrics(spark, d))


@query(f"select node, name, cast(value as double) as value from (unpivot ({NODE_METRICS}) on columns(* exclude (node)) into name name value value)", "ops", "peers")
def prom_parse(spark, d):
    """Metrics as text, parsed again."""
    lines = metrics.prometheus_text(_node_metrics(spark, d)).select("node", F.explode(F.split("body", "\n")).alias("line"))
    return text.parse_metrics(lines, "node")


@query(f"select node, cast(kv_puts_total as double) as kv_puts_total, cast(raft_log_count as double) as raft_log_count from ({NODE_METRICS})", "ops", "peers")
def metrics_pivot(spark, d):
    lines = metrics.prometheus_text(_node_metrics(spark, d)).select("node", F.explode(F.split("body", "\n")).alias("line"))
    return metrics.pivot(text.parse_metrics(lines, "node"), ["kv_puts_total", "raft_log_count"])


@query("select * from sweep where status='OK'", "sweep")
def sweep_ok(spark, d):
    """The sweep through a CSV file."""
    path = scratch(spark)
    fx.sweep(spark, d).write.csv(path, header=True)
    return metrics.sweep_ok(spark.read.csv(path, header=True, schema="memtable_kb int, write_ops double, status string"))


@query("select count(*) as tests, count(*) filter (where n%2=1) as failures, 0 as errors from (select op, count(*) as n from hist group by op)", "hist")
def junit_totals(spark, d):
    """A test report through XML."""
    counted = fx.history(spark, d).groupBy(F.col("op").alias("name")).agg(F.count("*").alias("ops"))
    results = counted.select("name", (F.col("ops") % 2 == 0).alias("ok"), F.col("ops").cast("string").alias("ops"), F.lit("1").alias("failures"))
    path = scratch(spark)
    text.write_junit(results, path)
    schema = "_name string, _classname string, failure struct<_type string, _VALUE string>"
    back = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    return text.junit_totals(back.select(F.col("failure").isNull().alias("ok")))


@query("select n*8.0::double as write_ops_per_sec, 0.125::double as write_time_sec, hit as read_hits, n-hit as read_misses, 0.25::double as read_time_sec, hit as scan_count, cast(0 as bigint) as verify_errors from (select count(*) as n, count(*) filter (where op='PUT') as hit from ops)", "ops")
def bench_parse(spark, d):
    s = fx.ops(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("op") == "PUT").alias("hit"), F.count_if(F.col("op") == "DEL").alias("miss"))
    lines = F.array(
        F.format_string("Write %d entries, cost 0.125 sec, %d ops/sec", "n", F.col("n") * 8), F.format_string("Read %d random keys, hit %d, miss %d, cost 0.25 sec", "n", "hit", "miss"),
        F.format_string("Scan all keys: %d entries found", "hit"), F.lit("Data integrity check: 0 errors found"),
    )
    return text.parse_benchmark(s.select(F.explode(lines).alias("line")))


# --- histories


@query("select * from hist", "hist")
def history_json(spark, d):
    """A history through JSON files."""
    path = scratch(spark)
    text.write_history(fx.history(spark, d), path)
    return text.read_history(spark, path).select("seq", "client_id", "key", "op", "value", "result", "start_us", "end_us", "success")


@query(
    """select r.seq, r.key, r.result, w.value as last_value, w.seq as last_seq from (select * from hist where success and op='get') r left join lateral
    (select value, seq from hist w where success and op='put' and w.key=r.key and w.end_us<=r.start_us order by end_us desc, seq desc limit 1) w on true""",
    "hist",
)
def asof_last_write(spark, d):
    ok = history.successful(fx.history(spark, d))
    reads = ok.where("op = 'get'").select("seq", "key", "start_us", "result")
    return history.asof(reads, ok.where("op = 'put'")).select("seq", "key", "result", "last_value", "last_seq")


@query("select r.seq, w.seq as write_seq from hist r join hist w on r.key=w.key and r.success and w.success and r.op='get' and w.op='put' and w.start_us<=r.end_us and w.end_us>=r.start_us", "hist")
def overlap_writes(spark, d):
    ok = history.successful(fx.history(spark, d))
    reads = ok.where("op = 'get'").select("seq", "key", "start_us", "end_us")
    return history.overlapping(reads, ok.where("op = 'put'").select("seq", "key", "start_us", "end_us", "value"), within=ok).select("seq", "write_seq")


@query(
    """, r as (select r.*, (select max_by(w.value, w.end_us::hugeint*100000000+w.seq) from hist w where w.success and w.op='put' and w.key=r.key and w.end_us<=r.start_us) as last_value from hist r where success and op='get')
    select seq, key, result, last_value from r where (last_value is null or last_value<>result) and not exists
    (select 1 from hist w where w.success and w.op='put' and w.key=r.key and w.value=r.result and w.start_us<=r.end_us and w.end_us>=r.start_us)""",
    "hist",
)
def register_violations(spark, d):
    return history.register_violations(fx.history(spark, d))


@query(
    """, c as (select c.*, split_part(value,'->',1) as expected, (select max_by(w.value, w.end_us::hugeint*100000000+w.seq) from hist w where w.success and w.op='put' and w.key=c.key and w.end_us<=c.start_us) as last_value from hist c where op='cas' and result='true')
    select seq, key, expected, last_value from c where last_value is not null and last_value<>expected""",
    "hist",
)
def cas_violations(spark, d):
    return history.cas_violations(fx.history(spark, d))


INC = ", inc as (select *, try_cast(result as bigint) as v from hist where success and op='inc' and regexp_full_match(result, '[0-9]+'))"


@query(INC + " select seq, key, prev, v from (select *, lag(v) over (partition by key order by end_us, seq) as prev from inc) where v<prev", "hist")
def inc_monotonic(spark, d):
    return history.increment_falls(fx.history(spark, d))


def _numeric_reads(h: DataFrame) -> DataFrame:
    """Reads of counters: the register fixture holds texts, so a number stands in for them."""
    return h.withColumn("result", F.when(F.col("op") == "get", (F.col("seq") % 180).cast("string")).otherwise(F.col("result")))


@query(INC + " select h.seq, h.key, h.seq%180 as v, n from hist h join (select key, count(*) as n from inc group by key) using (key) where success and op='get' and h.seq%180>n", "hist")
def inc_bound_violations(spark, d):
    return history.reads_above_increments(_numeric_reads(fx.history(spark, d)))


@query("select op, n, ok, round(1-ok/n, 6) as error_rate, round(n/greatest(s, 0.001), 6) as ops_per_sec from (select op, count(*) as n, count(*) filter (where success) as ok, (max(end_us)-min(start_us))/1e6 as s from hist group by op)", "hist")
def throughput(spark, d):
    return history.throughput(fx.history(spark, d))


# --- replicas


@query("select coalesce(a.key,b.key) as key, case when b.key is null then 'only_ref' when a.key is null then 'only_this' else 'value_diff' end as status, a.value as ref_value, b.value as this_value from state_a a full join state_b b on a.key=b.key where a.value is distinct from b.value", "state_a", "state_b")
def replica_diff(spark, d):
    return replicas.diff(fx.state_a(spark, d), fx.state_b(spark, d))


@query("select coalesce(a.key,b.key) as key, case when b.key is null then 'only_ref' when a.key is null then 'only_this' else 'value_diff' end as status, a.value as ref_value, b.value as this_value from state_a a full join state_b b on a.key=b.key where a.value is distinct from b.value order by 1 limit 5", "state_a", "state_b")
def diff_top5(spark, d):
    return replicas.first_differences(fx.state_a(spark, d), fx.state_b(spark, d))


@query(", n as (select 0 as node, key, value from state_a union all select 1, key, value from state_b union all select 2, key, value from state_a) select i.i::integer as node_a, j.i::integer as node_b, count(*) filter (where not e) as differing, count(*) filter (where not e)=0 as equal from (select distinct key from n) k, range(3) i(i), range(3) j(i), lateral (select (select value from n where n.key=k.key and node=i.i) is not distinct from (select value from n where n.key=k.key and node=j.i) as e) where i.i<j.i group by 1,2", "state_a", "state_b")
def replica_pairs(spark, d):
    a, b = fx.state_a(spark, d), fx.state_b(spark, d)
    return replicas.pairwise_equal({0: a, 1: b, 2: a})


@query("select case when b.key is null then 'missing' when a.value=b.value then 'match' else 'mismatch' end as outcome, count(*) as n from state_a a left join state_b b on a.key=b.key group by 1", "state_a", "state_b")
def verify_expected(spark, d):
    return replicas.verify(fx.state_a(spark, d), fx.state_b(spark, d))


@query(f", s as (select key,value,seq from {fx.LAST.format('(select * from ops where seq<=(select max(seq)*8//10 from ops))')} where rn=1 and {LIVE}) select coalesce(a.key,b.key) as key, case when b.key is null then 'only_ref' when a.key is null then 'only_this' else 'value_diff' end as status, a.value as ref_value, b.value as this_value from s a full join state_a b on a.key=b.key where a.value is distinct from b.value", "state_a")
def snapshot_vs_live(spark, d):
    log = fx.ops(spark, d)
    return replicas.diff(replicas.snapshot(log, fx.share_of_log(spark, d, 8)), state.current_state(log))


@query(f"select key,value,seq from {fx.LAST.format('(select * from ops where seq<=(select max(seq)*5//10 from ops))')} where rn=1 and {LIVE} and key='user:00000017'", "ops")
def snapshot_get(spark, d):
    return state.get(fx.ops(spark, d).where(F.col("seq") <= fx.share_of_log(spark, d, 5)), "user:00000017")


@query(f"select key,value,seq from {fx.LAST.format('(select * from ops where seq<=(select max(seq)*4//10 from ops))')} where rn=1 and {LIVE} and key between 'user:00000010' and 'user:00000090'", "ops")
def snapshot_scan(spark, d):
    """At half of the log with four tenths flushed: what is in memory only is not seen."""
    upto = [fx.share_of_log(spark, d, n) for n in (5, 4)]
    return state.between(replicas.snapshot(fx.ops(spark, d), upto[0], flushed_upto=upto[1]), "user:00000010", "user:00000090")


@query("select file_id, level, file_size, smallest, largest from manifest where 'user:00000017' between smallest and largest", "manifest")
def segment_prune(spark, d):
    return segments.prune(segments.manifest(fx.segments(spark, d)), "user:00000017")


@query("select count(distinct key) as n from ops where op='PUT'", "ops")
def distinct_keys(spark, d):
    return fx.ops(spark, d).where("op = 'PUT'").agg(F.count_distinct("key").alias("n"))


@query("select 'only_a' as side, key from (select key from state_a except select key from state_b) union all select 'only_b', key from (select key from state_b except select key from state_a)", "state_a", "state_b")
def keys_except(spark, d):
    return replicas.keys_except(fx.state_a(spark, d), fx.state_b(spark, d))


@query("select key, a.value=b.value as same from state_a a join state_b b using (key)", "state_a", "state_b")
def keys_intersect(spark, d):
    return replicas.keys_intersect(fx.state_a(spark, d), fx.state_b(spark, d))


EXPECTED = "(select range as idx, concat('user:',lpad(range::varchar,8,'0')) as key from range(200))"


def _expected(spark) -> DataFrame:
    return spark.range(200).select(F.col("id").alias("idx"), codecs.padded_key("user:", F.col("id")).alias("key"))


@query(f"select count(s.key) as found, count(*)-count(s.key) as missing, min(idx) filter (where s.key is null) as first_missing, round(100*count(s.key)/count(*),6) as percent from {EXPECTED} e left join state_a s using (key)", "state_a")
def recovery_stats(spark, d):
    return replicas.recovery(_expected(spark), fx.state_a(spark, d))


@query(f"select count(*) as n_expected, count(s.key) as n_found, round(100*count(s.key)/count(*),6) as percent, round(100*count(s.key)/count(*),6)>=95 as passed from {EXPECTED} e left join state_a s using (key)", "state_a")
def coverage(spark, d):
    return replicas.coverage(_expected(spark), fx.state_a(spark, d))


# --- segments


@query("select key,value,seq from state_a", "state_a")
def merge_runs(spark, d):
    return segments.merge(fx.segments(spark, d))


@query("select level, files, bytes, case when level=0 then files>=2 else bytes>=10485760*power(10,level-1) end as triggered from (select level, count(*) as files, cast(sum(file_size) as bigint) as bytes from manifest group by level)", "manifest")
def compaction_trigger(spark, d):
    return segments.level_usage(fx.segments(spark, d))


@query("select file_id, level, seq, op, key, value from seg where level not in (0,1) union all select cast(-1 as bigint), 1, seq, op, key, value from (select *, row_number() over (partition by key order by seq desc) as rn from seg where level in (0,1)) where rn=1", "seg")
def compact_level(spark, d):
    return segments.compact_level(fx.segments(spark, d), 0)


@query("select cast(-6 as bigint) as file_id, 6 as level, seq, op, key, value from last", "last")
def compact_all(spark, d):
    return segments.compact_all(fx.segments(spark, d))


DUE = "(select bool_or(case when level=0 then n>=2 else level<7 and bytes>=10485760*power(10,level-1) end) from (select level, count(*) as n, sum(file_size) as bytes from manifest group by level))"


@query(f"select cast(-6 as bigint) as file_id, 6 as level, seq, op, key, value from last where {DUE} union all select file_id, level, seq, op, key, value from seg where not {DUE}", "last", "manifest")
def compact_scheduled(spark, d):
    """What one look of the compaction scheduler leaves behind."""
    return segments.poll(fx.segments(spark, d))


def _closed_store(spark, d) -> str:
    """The folder of a store that was closed: its state in sorted files."""
    path = scratch(spark)
    segments.write_segments(state.latest(fx.ops(spark, d)), path)
    return path


@query("select key, op, value, seq from last where key between 'user:00000010' and 'user:00000050'", "last")
def segment_write(spark, d):
    """A closed store, read again between bounds, which the files' own bounds prune."""
    return state.between(spark.read.schema("key string, op string, value string, seq long").parquet(_closed_store(spark, d)), "user:00000010", "user:00000050")


@query("select count(*) as n_rows, min(key) as smallest, max(key) as largest, true as apart from last", "last")
def segment_footer(spark, d):
    """The footers of a closed store's files: rows and bounds, and that no two files' bounds overlap."""
    files = segments.read_footers(spark, _closed_store(spark, d)).where("n_rows > 0")
    before = Window.orderBy("smallest").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    apart = F.coalesce(F.col("smallest") > F.max("largest").over(before), F.lit(True))
    return files.withColumn("apart", apart).agg(F.sum("n_rows").alias("n_rows"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.bool_and("apart").alias("apart"))


def _blocks(spark, d) -> DataFrame:
    """file_id, level, content: a segment's entries one after another."""
    seg = fx.segments(spark, d)
    entry = F.struct("seq", F.concat("key", F.coalesce("value", F.lit(""))).alias("e"))
    return seg.groupBy("file_id", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), "").cast("binary").alias("content"))


BLOCKS = "(select file_id, level, encode(string_agg(key||coalesce(value,''), '' order by seq)) as content from seg group by file_id, level)"


@query(f"select file_id, codec, octet_length(content) as size, lower(md5(content)) as digest, true as fits from {BLOCKS}, (values (0),(1),(2)) t(codec)", "seg")
def codec_roundtrip(spark, d):
    """Segments packed by each codec, within its bound, and unpacked."""
    size = F.octet_length("content").cast("long")
    blocks = _blocks(spark, d).select("file_id", "content", size.alias("size"), F.explode(F.array(*map(F.lit, sorted(codecs.CODECS.values())))).alias("codec"))
    packed = blocks.withColumn("packed", codecs.compress(F.col("codec"), F.col("content")))
    back = codecs.decompress(F.col("codec"), F.col("packed"), F.col("size"))
    fits = F.octet_length("packed") <= codecs.compress_bound(F.col("codec"), F.col("size"))
    return packed.select("file_id", "codec", "size", F.md5(back).alias("digest"), fits.alias("fits"))


@query(f"select level as node, 'seg_'||lpad(file_id::varchar,6,'0') as name, octet_length(content) as size, lower(md5(content)) as digest, {COMMIT} as last_included_index, {TERM} as last_included_term from {BLOCKS}", "seg", "peers")
def snapshot_pack(spark, d):
    """Each level's files packed to a snapshot file and unpacked."""
    files = _blocks(spark, d).select(F.col("level").alias("node"), F.format_string("seg_%06d", "file_id").alias("name"), "content")
    back = snapshot.unpack(snapshot.pack(files, _commit(spark, d), _term(spark, d)))
    return back.select("node", "name", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("digest"), "last_included_index", "last_included_term")


@query("select file_id, seq, key, prev_key from (select *, lag(key) over (partition by file_id order by seq) as prev_key from seg) where key<prev_key", "seg")
def order_violations(spark, d):
    return segments.order_violations(fx.segments(spark, d))


@query()
def flush_batches(spark, d):
    """Four stores' logs, each with its own flushes."""
    log = fx.ops(spark, d).withColumn("part", F.col("seq") % 4)
    return segments.flush_batches(log, limit=4096)


ORACLES["flush_batches"] = f"with recursive ops as ({fx.SQL['ops']}), sized as (select seq, seq%4 as part, strlen(key)+coalesce(strlen(value),0) as b, row_number() over (partition by seq%4 order by seq) as i from ops), f as (select part, i, seq, cast(0 as bigint) as batch, b as used from sized where i=1 union all select s.part, s.i, s.seq, case when f.used>=4096 then f.batch+1 else f.batch end, case when f.used>=4096 then s.b else f.used+s.b end from f join sized s on s.part=f.part and s.i=f.i+1) select part, seq, batch from f"

# --- replicated logs


@query("select coalesce(max(idx),0) as commit_index from rlog where term=(select max(term) from rlog) and (select count(*) from peers where match_index>=idx)*2>(select count(*) from peers)", "peers")
def commit_index(spark, d):
    return replication.commit_index(fx.raft_log(spark, d), fx.peers(spark, d))


@query(f"select key,value,seq from (select idx as seq, op, key, value, row_number() over (partition by key order by idx desc) as rn from rlog where idx>(select max(seq)*2//10 from ops) and idx<={COMMIT}) where rn=1 and {LIVE}", "peers")
def apply_committed(spark, d):
    return replication.apply_committed(fx.raft_log(spark, d), fx.share_of_log(spark, d, 2), _commit(spark, d))


RECEIVED = "with rec as (select event_id as arrival, user_id%3 as node, 1+event_id//1700 as term, 1+event_id%400 as idx from events)"


@query(RECEIVED + ", cuts as (select node, arrival as cut_at, idx as cut_from from (select *, lag(term) over (partition by node, idx order by arrival) as pt from rec) where pt is not null and pt<>term) select node, idx, term, min(arrival) as arrival from rec r where not exists (select 1 from cuts c where c.node=r.node and c.cut_at>r.arrival and c.cut_from<=r.idx) group by 1,2,3")
def log_truncate(spark, d):
    e = fx.table(spark, d, "events")
    received = e.select(F.col("event_id").alias("arrival"), (F.col("user_id") % 3).alias("node"), F.expr("1 + event_id div 1700").alias("term"), (1 + F.col("event_id") % 400).alias("idx"))
    return replication.truncate(received)


@query("select event_id//500 as term, user_id%3 as candidate, count(*) filter (where event_type<>'error') as votes, count(*) filter (where event_type<>'error')*2>500 as elected from events group by 1,2")
def vote_tally(spark, d):
    e = fx.table(spark, d, "events")
    votes = e.select(F.expr("event_id div 500").alias("term"), (F.col("user_id") % 3).alias("candidate"), (F.col("event_type") != "error").alias("granted"))
    return replication.vote_tally(votes, 500)


@query("select entries, bytes, entries>=10000 or bytes>=20971520 as needed from (select count(*) as entries, cast(sum(25+strlen(key)+coalesce(strlen(value),0)) as bigint) as bytes from rlog)", "rlog")
def needs_snapshot(spark, d):
    return replication.snapshot_need(fx.raft_log(spark, d))


@query("select key,value,seq+1 as seq from state_a", "state_a")
def snapshot_plus_log(spark, d):
    return replication.snapshot_plus_log(fx.raft_log(spark, d), fx.share_of_log(spark, d, 6))


@query("select " + TERM + " as term, n_nationkey+1+(select max(idx) from rlog) as idx, 'PUT' as op, n_name as key, 'v' as value from nation union all select * from rlog", "rlog")
def raft_propose(spark, d):
    entries = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("order"), F.lit("PUT").alias("op"), F.col("n_name").alias("key"), F.lit("v").alias("value"))
    return replication.propose(fx.raft_log(spark, d), entries, _term(spark, d))


@query("select * from rlog where idx>=(select max(seq)*7//10 from ops) order by idx limit 128", "rlog")
def repl_batch(spark, d):
    return replication.replication_batch(fx.raft_log(spark, d), fx.share_of_log(spark, d, 7))


ASKED_LOG = "(select n_nationkey as follower, n_nationkey*397 as prev_idx, case when n_nationkey%4=0 then 9 else 1+(n_nationkey*397-1)//3000 end as prev_term from nation)"


@query(f"select follower, prev_idx=0 or r.idx is not null as matched from {ASKED_LOG} a left join rlog r on r.idx=a.prev_idx and r.term=a.prev_term", "rlog")
def log_match(spark, d):
    n = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("follower"), (F.col("n_nationkey") * 397).cast("long").alias("prev_idx"))
    asked = n.withColumn("prev_term", F.when(F.col("follower") % 4 == 0, F.lit(9).cast("long")).otherwise(F.expr("1 + (prev_idx - 1) div 3000")))
    return replication.log_matches(fx.raft_log(spark, d), asked)


@query("select a.idx, a.term, (a.term, a.idx) >= ((select term from rlog where idx=" + COMMIT + "), " + COMMIT + ") as ok from rlog a", "peers")
def log_up_to_date(spark, d):
    """Candidates whose logs end at each entry, judged by a node whose log ends at the commit index."""
    log, at = fx.raft_log(spark, d), _commit(spark, d)
    own = log.where(F.col("idx") == at).select(F.col("term").alias("own_term"), F.col("idx").alias("own_idx"))
    return log.join(F.broadcast(own)).select("idx", "term", replication.up_to_date(F.col("term"), F.col("idx"), F.col("own_term"), F.col("own_idx")).alias("ok"))


@query("select file_id, c as chunk, c*4096 as begin, least(4096, file_size-c*4096) as length from (select *, unnest(range(greatest(cast(ceil(file_size/4096) as bigint),1))) as c from manifest)", "manifest")
def snapshot_chunks(spark, d):
    sizes = segments.manifest(fx.segments(spark, d)).select("file_id", F.col("file_size").alias("size"))
    return replication.snapshot_chunks(sizes, 4096)


@query("select node, case when node=0 then 'LEADER' else 'FOLLOWER' end as role, (select max(term) from rlog) as term, least(match_index,c) as commit_index, least(match_index,c) as last_applied, match_index as log_count from peers, (select " + COMMIT + " as c)", "peers")
def cluster_status(spark, d):
    return replication.status(fx.raft_log(spark, d), fx.peers(spark, d), _commit(spark, d))


@query("select node, match_index, cast(greatest(" + COMMIT + "-match_index,0) as bigint) as lag from peers", "peers")
def replication_lag(spark, d):
    return replication.lag(fx.raft_log(spark, d), fx.peers(spark, d), _commit(spark, d))


ROLES = "(select event_id as seq, user_id%3 as node, case event_type when 'purchase' then 2 when 'signup' then 1 when 'error' then 7 else 0 end as r from events)"


@query(f"select distinct r as role, case r when 0 then 'FOLLOWER' when 1 then 'CANDIDATE' when 2 then 'LEADER' else 'UNKNOWN' end as name from {ROLES}")
def role_name(spark, d):
    return _roles(spark, d).select("r").distinct().select(F.col("r").alias("role"), replication.role_name(F.col("r")).alias("name"))


def _roles(spark, d) -> DataFrame:
    kind = F.col("event_type")
    return fx.table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 3).alias("node"), F.when(kind == "purchase", 2).when(kind == "signup", 1).when(kind == "error", 7).otherwise(0).alias("r"))


@query(f"select node, r as role, cast(island as bigint) as island, min(seq) as first_seq, max(seq) as last_seq, count(*) as n from (select *, sum(new) over (partition by node order by seq) as island from (select *, case when r is distinct from lag(r) over (partition by node order by seq) then 1 else 0 end as new from {ROLES})) group by 1,2,3")
def role_timeline(spark, d):
    return replication.role_timeline(_roles(spark, d).withColumnRenamed("r", "role"))


@query("select client_id, count(*) filter (where leader<>prev) as switches from (select *, lag(leader) over (partition by client_id order by seq) as prev from (select seq, client_id, seq//700%3 as leader from hist)) group by 1", "hist")
def leader_switches(spark, d):
    seen = fx.history(spark, d).select("seq", "client_id", F.expr("seq div 700 % 3").alias("leader"))
    return replication.leader_switches(seen)


# --- metrics and sweeps


@query("select count(*) filter (where op='PUT') as puts_total, count(*) filter (where op='DEL') as deletes_total, (select count(*) from asked join state_a using (key)) as gets_total, (select count(*) from asked where key not in (select key from state_a)) as get_misses_total from ops", "state_a", "asked")
def op_counters(spark, d):
    return metrics.op_counters(fx.ops(spark, d), _reads(spark, d))


def _reads(spark, d) -> DataFrame:
    return state.get_many(fx.ops(spark, d), fx.asked(spark, d)).select(F.col("value").isNotNull().alias("hit"))


@query("select count(*) as reads, count(s.key) as hits, round(count(s.key)/count(*),6) as ratio from asked a left join state_a s using (key)", "state_a", "asked")
def hit_ratio(spark, d):
    return metrics.hit_ratio(_reads(spark, d))


@query("select name, bucket, round((total-pt)/(bucket-pb),6) as per_bucket from (select *, lag(total) over w as pt, lag(bucket) over w as pb from samples window w as (partition by name order by bucket))", "samples")
def metric_rate(spark, d):
    return metrics.rate(fx.samples(spark, d))


@query("select memtable_kb, count(*) as n, round(avg(write_ops),4) as mean from sweep where status='OK' group by 1", "sweep")
def sweep_means(spark, d):
    return metrics.sweep_means(fx.sweep(spark, d))


@query("select memtable_kb, write_ops as best from sweep where status='OK' order by write_ops desc, memtable_kb desc limit 1", "sweep")
def sweep_best(spark, d):
    return metrics.sweep_best(fx.sweep(spark, d))


@query("select p_brand as config, count(*) as n_runs, round(case when avg(p_size%7)>0 then avg(p_retailprice)/avg(p_size%7) else 0 end,4) as ops from part group by 1")
def sweep_avg(spark, d):
    runs = fx.table(spark, d, "part").select(F.col("p_brand").alias("config"), (F.col("p_size") % 7).alias("seconds"), F.col("p_retailprice").alias("entries"))
    return metrics.run_average(runs)


@query("select time_bucket(interval '5 seconds', ts) as start, event_type as name, count(*) as n, round(sum(value),4) as total from events group by 1,2")
def stream_metrics(spark, d):
    from tidelog.streaming import apply

    rows = fx.table(spark, d, "events").select("ts", F.col("event_type").alias("name"), "value")
    return apply.windowed(rows).withColumn("total", F.round("total", 4))


@query(f"select node, raft_term::integer as term from ({NODE_METRICS}) where raft_is_leader=1", "ops", "peers")
def leader_node(spark, d):
    """The node whose exposed metrics say that it leads, of several the one with the greatest term."""
    lines = metrics.prometheus_text(_node_metrics(spark, d)).select("node", F.explode(F.split("body", "\n")).alias("line"))
    wide = metrics.pivot(text.parse_metrics(lines, "node"), ["raft_is_leader", "raft_term"])
    return wide.where("raft_is_leader = 1").orderBy(F.desc("raft_term"), "node").limit(1).select("node", F.col("raft_term").cast("int").alias("term"))


# --- sharding


ROUTED = "select k.key, coalesce((select r.node from {r} r where r.pos>=k.h order by r.pos limit 1), (select node from {r} order by pos limit 1)) as node from (select key, ('0x'||substr(md5(key),25,8))::bigint & 2147483647 as h from {k}) k"


@query(ROUTED.format(r="ring3", k="state_a"), "state_a", "ring3")
def shard_route(spark, d):
    return shard.route(fx.state_a(spark, d).select("key"), shard.ring(spark, 3))


@query("select key, ('0x'||substr(md5(key),25,8))::bigint & 2147483647 as h from state_a", "state_a")
def shard_hash(spark, d):
    return fx.state_a(spark, d).select("key", shard.key_hash(F.col("key")).alias("h"))


@query(f"select node, count(*) as n from ({ROUTED.format(r='ring3', k='state_a')}) group by node", "state_a", "ring3")
def shard_distribution(spark, d):
    return shard.distribution(fx.state_a(spark, d), shard.ring(spark, 3))


@query(f"select a.node as from_node, b.node as to_node, count(*) as n from ({ROUTED.format(r='ring3', k='state_a')}) a join ({ROUTED.format(r='ring4', k='state_a')}) b using (key) where a.node<>b.node group by 1,2", "state_a", "ring3", "ring4")
def shard_moves(spark, d):
    return shard.moves(fx.state_a(spark, d), shard.ring(spark, 3), shard.ring(spark, 4))


@query("select key from state_a union all select key from state_b", "state_a", "state_b")
def shard_keys_union(spark, d):
    return shard.gathered_keys([fx.state_a(spark, d), fx.state_b(spark, d)])


# --- functions


@query("select a.key as a, b.key as b, a.key<b.key as less, encode(a.key)<encode(b.key) as less_bytes from state_a a join state_b b on a.seq=b.seq+1 or a.seq=b.seq", "state_a", "state_b")
def key_compare(spark, d):
    a = fx.state_a(spark, d).select(F.col("key").alias("a"), F.explode(F.array(F.col("seq"), F.col("seq") - 1)).alias("s"))
    b = fx.state_b(spark, d).select(F.col("key").alias("b"), F.col("seq").alias("s"))
    return a.join(b, "s").select("a", "b", (F.col("a") < F.col("b")).alias("less"), (F.col("a").cast("binary") < F.col("b").cast("binary")).alias("less_bytes"))


@query("select key, lower(hex(encode(key))) as hexed, key as back from state_a", "state_a")
def hex_roundtrip(spark, d):
    return fx.state_a(spark, d).select("key", codecs.to_hex(F.col("key")).alias("hexed")).withColumn("back", codecs.from_hex(F.col("hexed")))


#: The bytes of a text, and 32-bit hashes of ASCII keys, as list expressions.
OCTETS = "list_transform(range(octet_length(encode({x}))), lambda i: ('0x'||substr(hex(encode({x})), 2*i+1, 2))::bigint)"
CRC_TABLE = "(select list_transform(range(256), lambda n: list_reduce([n]||range(8), lambda a, k: case when a&1=1 then xor(a>>1, 3988292384) else a>>1 end)) as t)"


@query("select seq, xor(list_reduce([4294967295::bigint]||c, lambda a, x: xor(a>>8, t[(xor(a, x)&255)+1])), 4294967295) as crc from (select seq, " + OCTETS.format(x="key||coalesce(value,'')") + " as c from ops), " + CRC_TABLE, "ops")
def row_crc32(spark, d):
    return fx.ops(spark, d).select("seq", F.crc32(F.concat("key", F.coalesce("value", F.lit(""))).cast("binary")).alias("crc"))


@query("select n, case when n<128 then 1 when n<16384 then 2 when n<2097152 then 3 when n<268435456 then 4 when n<34359738368 then 5 else 6 end as bytes from (select l_orderkey*l_partkey*l_linenumber as n from lineitem)")
def varint_len(spark, d):
    n = (F.col("l_orderkey") * F.col("l_partkey") * F.col("l_linenumber")).alias("n")
    return fx.table(spark, d, "lineitem").select(n).select("n", codecs.varint_length(F.col("n")).alias("bytes"))


@query("select key, list_reduce([2166136261::bigint] || c, lambda a, x: (xor(a, x) * 16777619) & 4294967295) as h1, list_reduce([0::bigint] || c, lambda a, x: (a * 33 + x) & 4294967295) as h2 from (select key, list_transform(range(1, strlen(key)+1), lambda i: ord(substr(key, i, 1))::bigint) as c from state_a)", "state_a")
def fnv1a(spark, d):
    return fx.state_a(spark, d).select("key", codecs.fnv1a(F.col("key")).alias("h1"), codecs.times33(F.col("key")).alias("h2"))


@query("select event_id, concat('key_',lpad(cast(event_id as varchar),8,'0')) as key from events")
def keygen(spark, d):
    return fx.table(spark, d, "events").select("event_id", codecs.padded_key("key_", F.col("event_id")).alias("key"))


@query("select n, p, bits, greatest(cast(floor(bits*0.69314718056/n) as bigint),1) as hashes from (select *, (cast(floor(-n*ln(p)/(0.69314718056*0.69314718056)) as bigint)+7)//8*8 as bits from (select c_custkey+1 as n, case c_custkey%3 when 0 then 0.01 when 1 then 0.001 else 0.0001 end::double as p from customer))")
def bloom_params(spark, d):
    c = fx.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("n"), F.when(F.col("c_custkey") % 3 == 0, 0.01).when(F.col("c_custkey") % 3 == 1, 0.001).otherwise(0.0001).alias("p"))
    bits, hashes = bloom.params_columns(F.col("n"), F.col("p"))
    return c.select("n", "p", bits.alias("bits"), hashes.alias("hashes"))


def _filter(spark, d) -> tuple[DataFrame, bytes]:
    """The live keys and the filter over them, sized by their number."""
    keys = fx.state_a(spark, d).select("key")
    return keys, bytes(bloom.build(keys, *bloom.sized(keys)).first()[0])


SIZE = "(select *, greatest(cast(floor(bits*0.69314718056/n) as bigint),1) as hashes from (select n, (cast(floor(-n*ln(0.01)/(0.69314718056*0.69314718056)) as bigint)+7)//8*8 as bits from (select count(*) as n from state_a)))"
HASHES = "(select key, list_reduce([2166136261::bigint]||c, lambda a, x: (xor(a, x)*16777619)&4294967295) as h1, list_reduce([0::bigint]||c, lambda a, x: (a*33+x)&4294967295) as h2 from (select key, " + OCTETS.format(x="key") + " as c from {k}))"
BITS = "(select key, ((h1+i*h2)&4294967295)%bits as bit from " + HASHES + ", " + SIZE + ", lateral (select unnest(range(hashes)) as i))"


@query("select max(s.bits) as bits, max(s.hashes) as hashes, count(distinct bit) as ones from " + BITS.format(k="state_a") + ", " + SIZE + " s", "state_a")
def bloom_build(spark, d):
    bits, hashes, body = bloom.deserialize(_filter(spark, d)[1])
    return spark.createDataFrame([(bits, hashes, sum(b.bit_count() for b in body))], "bits long, hashes long, ones long")


@query("select key, key in (select key from state_a) as there, bool_and(bit in (select bit from " + BITS.format(k="state_a") + ")) as may from " + BITS.format(k="(select distinct key from asked)") + " group by key", "state_a", "asked")
def bloom_probe(spark, d):
    keys, raw = _filter(spark, d)
    asked = fx.asked(spark, d).distinct().join(keys.withColumn("there", F.lit(True)), "key", "left")
    return asked.select("key", F.coalesce("there", F.lit(False)).alias("there"), bloom.may_contain(raw, F.col("key")).alias("may"))


@query("select 12+bits//8 as size, true as same from " + SIZE, "state_a")
def bloom_roundtrip(spark, d):
    raw = _filter(spark, d)[1]
    return spark.createDataFrame([(len(raw), bloom.serialize(*bloom.deserialize(raw)) == raw)], "size long, same boolean")


@query()
def lru_hits(spark, d):
    return cache.lru_hits(fx.ops(spark, d).withColumn("part", F.col("seq") % 4), 30)


ORACLES["lru_hits"] = f"""with recursive ops as ({fx.SQL['ops']}), a as (select seq%4 as part, key, row_number() over (partition by seq%4 order by seq) as i from ops),
  f as (select part, cast(0 as bigint) as i, cast([] as varchar[]) as cache, cast(0 as bigint) as hits from a where i=1 union all
    select a.part, a.i, case when list_contains(cache, a.key) or len(cache)<30 then list_append(list_filter(cache, lambda x: x<>a.key), a.key) else list_append(cache[2:], a.key) end,
      hits + case when list_contains(cache, a.key) then 1 else 0 end from f join a on a.part=f.part and a.i=f.i+1)
  select part, max(hits) as hits, max(i)-max(hits) as misses from f group by part"""


# --- streams


@query("select key, value, seq from state_a", "state_a")
def stream_apply(spark, d):
    """The log as a stream of files in no order, folded into a table of states."""
    from tidelog.streaming import apply

    path = scratch(spark)
    fx.ops(spark, d).repartition(3, F.col("seq") % 3).write.parquet(f"{path}/in")
    log = apply.read_log(spark, f"{path}/in", files_per_batch=1)
    apply.maintain_table(log, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return state.current_state(apply.read_table(spark, f"{path}/table"))


@query("select key, op, value, seq from last", "last")
def stream_changes(spark, d):
    """Each key's newest row as a stream keeps it: the last that it reported."""
    from tidelog.streaming import apply

    path = scratch(spark)
    fx.ops(spark, d).repartition(3, F.col("seq") % 3).write.parquet(f"{path}/in")
    changes = apply.stream_changes(apply.read_log(spark, f"{path}/in", files_per_batch=1))
    report = lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{path}/out/batch={epoch}")
    changes.writeStream.outputMode("update").foreachBatch(report).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state.latest(spark.read.schema("key string, op string, value string, seq long").parquet(f"{path}/out"), unique_seq=False)


@query("select time_bucket(interval '5 seconds', ts) as start, event_type as name, count(*) as n, round(sum(value),4) as total from events group by 1,2")
def stream_windows(spark, d):
    """Windows over the events as a stream of files in order of time, with a watermark: the last report of each."""
    from tidelog.streaming import apply

    path = scratch(spark)
    rows = fx.table(spark, d, "events").select("ts", F.col("event_type").alias("name"), "value")
    rows.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    report = lambda rows, epoch: rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/out/batch={epoch}")
    apply.windowed(stream, late="365 days").writeStream.outputMode("update").foreachBatch(report).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema("start timestamp, name string, n long, total double, epoch long").parquet(f"{path}/out")
    last = seen.groupBy("start", "name").agg(F.max_by(F.struct("n", "total"), "epoch").alias("x"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "name", "x.n", F.round("x.total", 4).alias("total"))
