"""Logs, histories and catalogs derived from the driver tables, as DataFrames and as SQL.

The DataFrames are what the queries read; SQL holds the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators import state
from tidelog.schemas import VNODES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def ops(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DEL").otherwise("PUT")
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), key.alias("key"), F.when(F.col("event_type") != "error", F.col("props")).alias("value"))


def ops_large(spark, sf_dir) -> DataFrame:
    """A log of lineitem's size.  seq packs order and line, and below them part and supplier modulo ten
    million, so that lines keep their order at any size and no global numbering is needed."""
    li = table(spark, sf_dir, "lineitem")
    seq = (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 10_000_000 + (F.col("l_partkey") * 13 + F.col("l_suppkey") % 13) % 10_000_000
    returned = F.col("l_returnflag") == "R"
    value = F.when(~returned, F.concat("l_linestatus", F.lit(":"), F.col("l_linenumber").cast("string")))
    return li.select(seq.alias("seq"), F.when(returned, "DEL").otherwise("PUT").alias("op"), F.concat(F.lit("part:"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("key"), value.alias("value"))


def share_of_log(spark, sf_dir, tenths: int) -> int:
    """The sequence number at so many tenths of the log."""
    return (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) * tenths // 10


def segments(spark, sf_dir) -> DataFrame:
    log = ops(spark, sf_dir).withColumn("file_id", F.floor(F.col("seq") / 1000) + 1)
    last = log.agg(F.max("file_id").alias("mx"))
    age = F.col("mx") - F.col("file_id")
    level = F.when(age < 2, 0).when(age < 5, 1).otherwise(2)
    return log.join(F.broadcast(last)).select("file_id", level.cast("int").alias("level"), "seq", "op", "key", "value")


def state_a(spark, sf_dir) -> DataFrame:
    return state.current_state(ops(spark, sf_dir))


def state_b(spark, sf_dir) -> DataFrame:
    return state.current_state(ops(spark, sf_dir).where("seq % 7 <> 0"))


def raft_log(spark, sf_dir) -> DataFrame:
    return ops(spark, sf_dir).select((F.floor(F.col("seq") / 3000) + 1).alias("term"), (F.col("seq") + 1).alias("idx"), "op", "key", "value")


def peers(spark, sf_dir) -> DataFrame:
    end = raft_log(spark, sf_dir).agg(F.max("idx").alias("m"))
    share = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(s).alias("s")) for n, s in ((0, 1.0), (1, 0.95), (2, 0.7))])
    return end.select("m", F.inline(share)).select("node", F.floor(F.col("m") * F.col("s")).alias("match_index"))


def history(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    kind, bit = F.col("event_type"), F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string"))
    op = F.when(kind.isin("purchase", "click"), "put").when(kind == "view", "get").when(kind == "signup", "cas").otherwise("inc")
    nth = F.row_number().over(Window.partitionBy(F.col("user_id") % 16, "event_type").orderBy("event_id"))
    result = F.when(kind == "view", bit).when(kind == "signup", F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")).when(kind == "error", (nth - F.when(F.col("event_id") % 50 == 0, 2).otherwise(0)).cast("string"))
    value = F.when(kind.isin("purchase", "click"), bit).when(kind == "signup", F.concat(bit, F.lit("->w")))
    return e.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 4).alias("client_id"), F.concat(F.lit("reg:"), (F.col("user_id") % 16).cast("string")).alias("key"),
        op.alias("op"), value.alias("value"), result.alias("result"), F.col("us").alias("start_us"), (F.col("us") + F.round(F.col("value") * 1000000).cast("long")).alias("end_us"), (F.col("event_id") % 20 != 0).alias("success"),
    )


def samples(spark, sf_dir) -> DataFrame:
    counts = events(spark, sf_dir).groupBy(F.col("event_type").alias("name"), F.floor(F.col("us") / 3600000000).alias("bucket")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("name", "bucket", F.sum("n").over(upto).alias("total"))


def sweep(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("p_partkey") % 10 == 0, "BUILD_FAILED").otherwise("OK")
    return table(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("memtable_kb"), F.col("p_retailprice").alias("write_ops"), status.alias("status"))


def asked(spark, sf_dir) -> DataFrame:
    """Keys that clients ask for, some twice, some never written."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("user:"), F.lpad((F.col("n_nationkey") * 11 % 170).cast("string"), 8, "0")).alias("key"))


LAST = "(select *, row_number() over (partition by key order by seq desc) as rn from {})"
SQL = {
    "ops": "select event_id as seq, case when event_type='error' then 'DEL' else 'PUT' end as op, concat('user:',lpad(cast(user_id as string),8,'0')) as key, case when event_type<>'error' then props end as value from events",
    "ops_l": "select (l_orderkey*100+l_linenumber)*10000000+(l_partkey*13+l_suppkey%13)%10000000 as seq, case when l_returnflag='R' then 'DEL' else 'PUT' end as op, concat('part:',lpad(cast(l_partkey as string),8,'0')) as key, case when l_returnflag<>'R' then concat(l_linestatus,':',cast(l_linenumber as string)) end as value from lineitem",
    "last": f"select * exclude(rn) from {LAST.format('ops')} where rn=1",
    "state_a": "select key,value,seq from last where op='PUT' and value<>''",
    "last_b": f"select * exclude(rn) from {LAST.format('(select * from ops where seq%7<>0)')} where rn=1",
    "state_b": "select key,value,seq from last_b where op='PUT' and value<>''",
    "seg": "select fid as file_id, cast(case when mx-fid<2 then 0 when mx-fid<5 then 1 else 2 end as integer) as level, seq,op,key,value from (select *, cast(floor(seq/1000) as bigint)+1 as fid, cast(floor(max(seq) over ()/1000) as bigint)+1 as mx from ops)",
    "manifest": "select file_id, level, cast(sum(strlen(key)+coalesce(strlen(value),0)) as bigint) as file_size, min(key) as smallest, max(key) as largest from seg group by file_id, level",
    "rlog": "select 1+cast(floor(seq/3000) as bigint) as term, seq+1 as idx, op,key,value from ops",
    "peers": "select 0 as node, max(idx) as match_index from rlog union all select 1, cast(floor(max(idx)*0.95) as bigint) from rlog union all select 2, cast(floor(max(idx)*0.7) as bigint) from rlog",
    "hist": """select event_id as seq, user_id%4 as client_id, concat('reg:',cast(user_id%16 as string)) as key,
      case when event_type in ('purchase','click') then 'put' when event_type='view' then 'get' when event_type='signup' then 'cas' else 'inc' end as op,
      case when event_type in ('purchase','click') then concat('v',cast(event_id%2 as string)) when event_type='signup' then concat('v',cast(event_id%2 as string),'->w') end as value,
      case when event_type='view' then concat('v',cast(event_id%2 as string)) when event_type='signup' then case when event_id%2=0 then 'true' else 'false' end
           when event_type='error' then cast(row_number() over (partition by user_id%16,event_type order by event_id) - case when event_id%50=0 then 2 else 0 end as string) end as result,
      epoch_us(ts) as start_us, epoch_us(ts)+cast(round(value*1000000) as bigint) as end_us, event_id%20<>0 as success from events""",
    "samples": "select name, bucket, sum(n) over (partition by name order by bucket) as total from (select event_type as name, cast(floor(epoch_us(ts)/3600000000) as bigint) as bucket, count(*) as n from events group by 1,2)",
    "sweep": "select (p_size%4) as memtable_kb, p_retailprice as write_ops, case when p_partkey%10=0 then 'BUILD_FAILED' else 'OK' end as status from part",
    "asked": "select concat('user:',lpad(cast(n_nationkey*11%170 as string),8,'0')) as key from nation",
    "ring3": f"select pos, max(node) as node from (select n.range::integer as node, (('0x'||substr(md5('node_'||n.range||'_vnode_'||v.range),25,8))::bigint & 2147483647) as pos from range(3) n, range({VNODES}) v) group by pos",
    "ring4": f"select pos, max(node) as node from (select n.range::integer as node, (('0x'||substr(md5('node_'||n.range||'_vnode_'||v.range),25,8))::bigint & 2147483647) as pos from range(4) n, range({VNODES}) v) group by pos",
}
NEEDS = {
    "last": ["ops"], "state_a": ["last"], "last_b": ["ops"], "state_b": ["last_b"], "seg": ["ops"], "manifest": ["seg"], "rlog": ["ops"], "peers": ["rlog"],
}


def sql(body: str, *views: str) -> str:
    """A query with the views that it needs before it."""
    ordered: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, []):
            add(n)
        if v not in ordered:
            ordered.append(v)

    for v in views:
        add(v)
    return "with " + ", ".join(f"{v} as ({SQL[v]})" for v in ordered) + ("" if body.startswith(",") else " ") + body if ordered else body
