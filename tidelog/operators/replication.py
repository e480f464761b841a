"""Replicated logs: quorum, ordered apply, truncation, snapshots, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import state
from tidelog.operators.ordered import running_count, with_previous
from tidelog.schemas import CHUNK_BYTES, RAFT_SNAPSHOT_BYTES, RAFT_SNAPSHOT_ENTRIES, REPL_BATCH

ENTRY_BYTES = 25
STRETCH = 100_000


def commit_index(log: DataFrame, peers: DataFrame) -> DataFrame:
    """commit_index: the greatest index of the current term that more than half of the nodes hold.

    The quorum's index is the (n // 2 + 1)-th greatest match, so the log is not joined to the
    peers: one aggregate over a handful of peers, one over the log."""
    quorum = peers.agg(F.sort_array(F.collect_list("match_index"), False).alias("m")).select(F.get("m", F.expr("size(m) div 2").cast("int")).alias("q"))
    current = log.agg(F.max("term").alias("t"))
    rows = log.join(F.broadcast(quorum.join(F.broadcast(current))), (F.col("idx") <= F.col("q")) & (F.col("term") == F.col("t")))
    return rows.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("commit_index"))


def apply_committed(log: DataFrame, applied: int, commit: int) -> DataFrame:
    """State from entries after `applied` up to `commit`."""
    rows = log.where((F.col("idx") > applied) & (F.col("idx") <= commit))
    return state.current_state(rows.withColumnRenamed("idx", "seq"))


def propose(log: DataFrame, entries: DataFrame, term: int) -> DataFrame:
    """The log with entries (order, op, key, value) appended at the next indexes.  A batch of proposals
    is small beside the log, so only the batch is numbered in one task."""
    end = log.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("last"))
    numbered = entries.withColumn("n", F.row_number().over(Window.orderBy("order"))).join(F.broadcast(end))
    new = numbered.select(F.lit(term).cast("long").alias("term"), (F.col("last") + F.col("n")).alias("idx"), "op", "key", "value")
    return log.select("term", "idx", "op", "key", "value").unionByName(new)


def truncate(received: DataFrame) -> DataFrame:
    """What stays of received entries (arrival, node, term, idx): an entry goes once one with another
    term arrives later at its index or below; of equal ones the first stays."""
    w = Window.partitionBy("node", "idx").orderBy("arrival")
    rows = received.withColumn("prev_term", F.lag("term").over(w))
    # An arrival that meets another term at its index cuts the log from there on.
    cuts = rows.where("prev_term is not null and prev_term <> term").select("node", F.col("arrival").alias("cut_at"), F.col("idx").alias("cut_from"))
    marks = received.select("node", "arrival", "term", "idx", F.lit(None).cast("long").alias("cut_from")).unionByName(
        cuts.select("node", F.col("cut_at").alias("arrival"), F.lit(None).cast("long").alias("term"), F.lit(None).cast("long").alias("idx"), "cut_from")
    )
    # The least index cut after each arrival: a running minimum backwards, within stretches of
    # arrivals, and over the stretches' own minima, so that no task holds a node's whole log.
    marks = marks.withColumn("part", F.expr(f"arrival div {STRETCH}"))
    later = Window.partitionBy("node", "part").orderBy(F.col("arrival").desc()).rangeBetween(Window.unboundedPreceding, -1)
    beyond = Window.partitionBy("node").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = marks.groupBy("node", "part").agg(F.min("cut_from").alias("m")).select("node", "part", F.min("m").over(beyond).alias("after"))
    near = marks.withColumn("near", F.min("cut_from").over(later)).where("idx is not null")
    kept = near.join(after, ["node", "part"]).withColumn("cut", F.least("near", "after")).where("cut is null or idx < cut")
    return kept.groupBy("node", "idx", "term").agg(F.min("arrival").alias("arrival"))


def vote_tally(votes: DataFrame, nodes: int) -> DataFrame:
    """term, candidate, votes, elected."""
    return votes.groupBy("term", "candidate").agg(F.count_if("granted").alias("votes")).withColumn("elected", F.col("votes") * 2 > nodes)


def snapshot_need(log: DataFrame) -> DataFrame:
    """entries, bytes, needed."""
    size = ENTRY_BYTES + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    used = log.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
    return used.withColumn("needed", (F.col("entries") >= RAFT_SNAPSHOT_ENTRIES) | (F.col("bytes") >= RAFT_SNAPSHOT_BYTES))


def load_after_snapshot(log: DataFrame, snapshot_index: int) -> DataFrame:
    return log.where(F.col("idx") > snapshot_index)


def snapshot_plus_log(log: DataFrame, snapshot_index: int) -> DataFrame:
    """State from a snapshot at an index and the entries after it."""
    rows = log.withColumnRenamed("idx", "seq").select("seq", "op", "key", "value")
    snapshot = state.latest(rows.where(F.col("seq") <= snapshot_index)).select("seq", "op", "key", "value")
    return state.current_state(snapshot.unionByName(rows.where(F.col("seq") > snapshot_index)))


def replication_batch(log: DataFrame, next_index: int, size: int = REPL_BATCH) -> DataFrame:
    return log.where(F.col("idx") >= next_index).orderBy("idx").limit(size)


def log_matches(log: DataFrame, asked: DataFrame) -> DataFrame:
    """follower, matched: does the log have the entry that a follower's batch builds on?  Index 0 is
    before all entries and always matches."""
    found = asked.join(log.select(F.col("idx").alias("prev_idx"), F.col("term").alias("prev_term"), F.lit(True).alias("hit")), ["prev_idx", "prev_term"], "left")
    return found.select("follower", ((F.col("prev_idx") == 0) | F.coalesce("hit", F.lit(False))).alias("matched"))


def up_to_date(term: Column, idx: Column, own_term: Column, own_idx: Column) -> Column:
    """Is a candidate's log at least as new as one's own?"""
    return F.struct(term, idx) >= F.struct(own_term, own_idx)


def snapshot_chunks(sizes: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """file_id, chunk, begin, length of each file's chunks (file_id, size)."""
    n = F.greatest(F.ceil(F.col("size") / F.lit(chunk)), F.lit(1))
    rows = sizes.select("file_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("chunk"))
    begin = F.col("chunk") * chunk
    return rows.select("file_id", "chunk", begin.alias("begin"), F.least(F.lit(chunk).cast("long"), F.col("size") - begin).alias("length"))


def role_name(role: Column) -> Column:
    return F.when(role == 0, "FOLLOWER").when(role == 1, "CANDIDATE").when(role == 2, "LEADER").otherwise("UNKNOWN")


def lag(log: DataFrame, peers: DataFrame, commit: int) -> DataFrame:
    """node, match_index, lag behind the commit index."""
    return peers.select("node", "match_index", F.greatest(F.lit(commit) - F.col("match_index"), F.lit(0)).cast("long").alias("lag"))


def status(log: DataFrame, peers: DataFrame, commit: int, leader: int = 0) -> DataFrame:
    """node, role, term, commit_index, last_applied, log_count: what each node knows of the log."""
    end = log.agg(F.max("term").alias("term"))
    commit_ = F.least(F.col("match_index"), F.lit(commit).cast("long"))
    role = role_name(F.when(F.col("node") == leader, 2).otherwise(0))
    return peers.join(F.broadcast(end)).select("node", role.alias("role"), "term", commit_.alias("commit_index"), commit_.alias("last_applied"), F.col("match_index").alias("log_count"))


def role_timeline(changes: DataFrame) -> DataFrame:
    """node, role, island, first_seq, last_seq, n: stretches in which a node kept its role."""
    part = F.expr(f"seq div {STRETCH}")
    new = F.coalesce(F.col("role") != F.col("prev"), F.lit(True))
    marked = with_previous(changes, "node", ["seq"], part, prev="role").withColumn("new", new)
    islands = running_count(marked, "node", ["seq"], part, "new", "island")
    return islands.groupBy("node", "role", "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


def leader_switches(seen: DataFrame) -> DataFrame:
    """client_id, switches: how often the leader that a client sees changes."""
    rows = with_previous(seen, "client_id", ["seq"], F.expr(f"seq div {STRETCH}"), prev="leader")
    return rows.groupBy("client_id").agg(F.count_if(F.col("leader") != F.col("prev")).alias("switches"))
