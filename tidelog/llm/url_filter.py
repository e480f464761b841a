"""URL filters: host rules first, then a naive Bayes verdict on segmented names.

Names in hosts and paths are often words written together.  A unigram model, counted from the words
of the pages, gives each candidate part of a distinct name its probability; candidates meet the
counts in a hash join, and Viterbi's recursion per name picks the most probable split.  The
parts of host and path feed multinomial naive Bayes over hashed tokens, trained on pages that a
rule decides (`allow` against `block`) outside a held-out third (crc32 of the id leaves 1 when
divided by 3).  Names that the rules themselves state are no tokens: they would only repeat the rules.
Runs of digits are one token.

Rules are a list that fits in a query plan.  A rule `host/path` fits the host and its
subdomains if the path starts with the rule's; the longest rule wins.  A null url, or one
without "://", has an empty host and path and no rule.  Repeated rows each get their verdict;
if no page is decided by a rule, every other page is allowed.

Hosts, names and words may be those of most pages: tables that are looked up by them are
repeated, and the rows that ask are dealt to the copies.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import looked_up, written
from tidelog.llm.labelled import held_out

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST_WORD, BUCKETS = 20, 1 << 16


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path, both empty without "://"."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """word, n: the words of all pages, without tags and scripts."""
    plain = F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = F.regexp_extract_all(F.lower(plain), F.lit(f"([a-z]{{2,{LONGEST_WORD}}})"), F.lit(1))
    return pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of a label; an unknown part costs 10 / (total * 10**length)."""
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for j in range(1, len(label) + 1):
        for i in range(max(0, j - LONGEST_WORD), j):
            part = label[i:j]
            n = counts.get(part)
            p = math.log(n / total) if n else math.log(10 / total) - len(part) * math.log(10)
            if best[i] + p > best[j]:
                best[j], back[j] = best[i] + p, i
    out, j = [], len(label)
    while j:
        out.append(label[back[j] : j])
        j = back[j]
    return out[::-1]


def rule_names(rules) -> list[str]:
    """The names in the hosts and paths of the rules."""
    return sorted({x for _, text in rules for x in re.split(r"[^a-z0-9]+", text) if x})


def names_of(text: Column, rules) -> Column:
    """The names in a host or path that no rule states; runs of digits as 0."""
    shape = F.regexp_replace(F.translate(text, UPPER, LOWER), "[0-9]+", "0")
    return F.filter(F.split(shape, r"[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(rule_names(rules)))


def segment_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """name, parts: the most probable split of every distinct name (column name)."""
    words = written(words)
    total = words.agg(F.sum("n")).first()[0] or 1
    names = names.select("name").distinct()
    size = F.length("name")
    begins = F.explode(F.sequence(F.lit(1), size)).alias("i")
    spans = names.select("name", begins).select("name", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), size - F.col("i") + 1))).alias("k"))
    found = looked_up(spans.select("name", F.expr("substring(name, i, k)").alias("word")).distinct(), words, "word", F.col("name"))
    known = names.join(found.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known")), "name", "left")

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(x, {} if k is None else {r["word"]: r["n"] for r in k}, total) for x, k in zip(name, known)])

    return known.select("name", split("name", "known").alias("parts"))


def segment(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """text, parts: of distinct texts (columns text and names) the parts of all names."""
    placed = looked_up(texts.select("text", F.explode("names").alias("name")), parts, "name", F.col("text"))
    return placed.groupBy("text").agg(F.flatten(F.collect_list("parts")).alias("parts"))  # their order means nothing to the model


def _tokens(host_parts: Column, path_parts: Column) -> Column:
    """Hashed tokens, those of paths marked."""
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce(host_parts, none), F.transform(F.coalesce(path_parts, none), lambda x: F.concat(F.lit("/"), x)))
    return F.transform(every, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, held_out, and score: the method's log odds of `block`, also for
    pages that a rule decides."""
    host, path = url_parts(F.col(f"`{url}`"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("by_rule", verdict)
    shape = F.regexp_replace(F.translate("path", UPPER, LOWER), "[0-9]+", "0")
    parsed = written(parsed.withColumn("shape", shape).withColumn("held_out", held_out(F.col("page_id"))))
    texts = parsed.select(F.explode(F.array("host", "shape")).alias("text")).distinct()
    texts = written(texts.withColumn("names", names_of(F.col("text"), rules)))
    parts = segment_names(texts.select(F.explode("names").alias("name")), word_counts(pages, html))
    parts = written(segment(texts, written(parts)))
    full = looked_up(parsed, parts.toDF("host", "host_parts"), "host", F.col("page_id"), "left")
    full = looked_up(full, parts.toDF("shape", "path_parts"), "shape", F.col("page_id"), "left")
    full = written(full.select("page_id", "host", "path", "rule", "by_rule", "held_out", _tokens(F.col("host_parts"), F.col("path_parts")).alias("tokens")))
    # At most two rows for each of a fixed number of buckets come to the driver.
    learned = full.where("by_rule is not null and not held_out")
    seen = learned.select("by_rule", F.explode("tokens").alias("token")).groupBy("by_rule", "token").count().collect()
    prior = {r[0]: r[1] for r in learned.groupBy("by_rule").count().collect()}
    counts = np.ones((2, BUCKETS))
    for kind, token, n in seen:
        counts[int(kind == "block"), token] += n
    weights = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    bias = math.log((prior.get("block", 0) + 1) / (prior.get("allow", 0) + 1)) if prior else -1.0

    @F.pandas_udf("double")
    def log_odds(tokens: pd.Series) -> pd.Series:
        return pd.Series([bias + float(weights[np.asarray(t, int)].sum()) if len(t) else bias for t in tokens])

    scored = full.withColumn("score", log_odds("tokens"))
    final = F.coalesce("by_rule", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", final.alias("verdict"), "held_out", "score")


def verdicts(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
