"""Commands of the server protocol as queries over a log, and their replies."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import state
from tidelog.operators.ordered import folded

#: The INFO reply: sections and fields of the protocol, with this engine's own version.
INFO = "# Server\r\ntidelog_version:1.0.0\r\n\r\n# Keyspace\r\n"
#: Fixed names of the protocol's commands.
COMMANDS = ("ping", "set", "get", "del", "keys", "scan", "exists", "dbsize", "flushdb", "info", "health", "quit", "save", "bgsave", "command")


def glob_regex(pattern: str) -> str:
    """`*` is any run, `?` one character; nothing else is special."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def keys(log: DataFrame, pattern: str) -> DataFrame:
    prefix = re.split(r"[*?]", pattern, maxsplit=1)[0]
    rows = log.where(F.col("key").startswith(prefix)) if prefix else log
    return state.current_state(rows.where(F.col("key").rlike(glob_regex(pattern)))).select("key").orderBy("key")


def bulk(x: Column) -> Column:
    """A bulk string, or the null reply."""
    return F.when(x.isNull(), F.lit("$-1\r\n")).otherwise(F.concat(F.lit("$"), F.octet_length(x).cast("string"), F.lit("\r\n"), x, F.lit("\r\n")))


def simple(x: Column) -> Column:
    return F.concat(F.lit("+"), x, F.lit("\r\n"))


def error(x: Column) -> Column:
    return F.concat(F.lit("-ERR "), x, F.lit("\r\n"))


def integer(x: Column) -> Column:
    return F.concat(F.lit(":"), x.cast("string"), F.lit("\r\n"))


def get_replies(log: DataFrame, asked: DataFrame) -> DataFrame:
    """key, reply of GET for each asked key."""
    return state.get_many(log, asked).select("key", bulk(F.col("value")).alias("reply"))


def del_count(asked: DataFrame) -> DataFrame:
    """DEL answers with the number of accepted arguments, not of keys that existed."""
    return asked.agg(F.count_if(F.octet_length("key") > 0).alias("n"))


def exists_count(log: DataFrame, asked: DataFrame) -> DataFrame:
    """A key that is asked twice counts twice."""
    live = state.current_state(log.join(asked.distinct(), "key", "left_semi")).select("key")
    return asked.join(live, "key").agg(F.count("*").alias("n"))


def dbsize(log: DataFrame) -> DataFrame:
    return state.current_state(log).agg(F.count("*").alias("n"))


def static_reply(name: Column) -> Column:
    """Replies that do not depend on the data; null for other commands."""
    low = F.lower(name)
    return F.when(low == "ping", F.lit("+PONG\r\n")).when(low.isin("quit", "command"), F.lit("+OK\r\n")).when(low == "info", bulk(F.lit(INFO)))


def save(log: DataFrame, path: str, names: DataFrame) -> DataFrame:
    """name, reply of SAVE and BGSAVE, which answer when the log's state is stored at `path`."""
    state.latest(log).write.mode("overwrite").parquet(path)
    return names.select("name", F.when(F.lower("name").isin("save", "bgsave"), F.lit("+OK\r\n")).alias("reply"))


def retries(failed: DataFrame, nodes: int, tries: int = 3, wait_us: int = 100_000) -> DataFrame:
    """seq, attempt, at_us, node: when and where a client tries requests (seq, start_us) that keep failing.
    It waits twice as long after each attempt, and goes from node to node."""
    attempt = F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("attempt")
    waited = (F.pow(F.lit(2), F.col("attempt")) - 1).cast("long") * wait_us
    rows = failed.select("seq", "start_us", attempt)
    return rows.select("seq", "attempt", (F.col("start_us") + waited).alias("at_us"), ((F.col("seq") + F.col("attempt")) % nodes).alias("node"))


def leader_probes(requests: DataFrame, ttl_us: int = 5_000_000) -> DataFrame:
    """client_id, seq: the requests (client_id, seq, start_us) before which a client looks for the leader, as what it
    knows is as old as `ttl_us` or older.  Each look starts the time anew, so a client's requests are gone
    through in order, by one task."""

    def begin():
        known = None

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal known
            times, out = pdf["start_us"].to_numpy(), []
            at = 0 if known is None else int(np.searchsorted(times, known + ttl_us))
            while at < len(times):
                out.append(at)
                known = int(times[at])
                at = int(np.searchsorted(times, known + ttl_us))
            return pdf.iloc[out][["client_id", "seq"]]

        return step

    kind = requests.schema["client_id"].dataType.simpleString()
    return folded(requests.select("client_id", "seq", "start_us"), "client_id", ["start_us", "seq"], begin, f"client_id {kind}, seq long")


def dispatch(argv: DataFrame) -> DataFrame:
    """name (lower case), known, and the error reply of an unknown command; argv has column argv."""
    name = F.lower(F.get("argv", F.lit(0)))
    known = F.coalesce(name.isin(*COMMANDS), F.lit(False))
    return argv.select("id", name.alias("name"), known.alias("known"), F.when(~known, error(F.concat(F.lit("unknown command '"), F.coalesce(name, F.lit("")), F.lit("'")))).alias("reply"))


def health_text(stats: DataFrame) -> DataFrame:
    """The HEALTH reply body from memtable_size, sstable_count, total_keys and wal_enabled."""
    parts = [F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in ("memtable_size", "sstable_count", "total_keys", "wal_enabled")]
    return stats.select(F.concat(F.lit("# Health\r\nstatus:ok\r\n"), F.concat_ws("\r\n", *parts), F.lit("\r\n")).alias("body"))
