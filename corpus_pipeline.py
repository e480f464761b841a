"""A corpus from raw documents: five stages, each over all that the stage before it kept.

run(spark, sf_dir) applies them to `documents`.  All but the last return the columns named in
COLUMNS; further columns of the table are dropped by the first stage.  Texts that line dedup cuts
get a new n_chars.  Rows are documents: rows that share an id, or have none, pass or go by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontamination, line_dedup, simhash, toxicity
from tidelog.llm.common import discard, table, written
from tidelog.llm.queries import byte_bpe_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_each(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and ends (see bpe.encode) and n_tokens."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), byte_bpe_path())
    return out.withColumn("n_tokens", F.expr("cast(octet_length(ids) / 4 as bigint)"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: The first stage learns its lexicon, which SQL cannot express; tests hold run() against a
#: brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if old is not None:
            discard(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
