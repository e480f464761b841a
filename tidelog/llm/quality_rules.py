"""Quality rules on documents and on their hosts, in DataFrame functions alone.

Each document is counted: words, characters, symbols, lines and repeated lines, words in repeated
five-word windows.  A document fails a rule on its own counts: the base rules (few words, repeated
windows), too many symbols for its word characters, too many repeated lines among its lines.

Per host the documents that fail are summed.  All hosts give an empirical beta prior: the mean failure
rate, and by the moments of the beta-binomial a strength that takes the noise of small hosts for what it
is; it shrinks each host's rate, so that few documents do not condemn a host.  The shrunk rate is joined
back to every document as the odds that it is bad, and each rule beyond the base that it fails itself
multiplies them by `failure_odds`.  A document goes if these odds exceed those of `host_limit`: all
documents of a host whose rate exceeds the limit go, and of other hosts those that fail a rule
themselves, unless the host is so clean that the failure is more likely an accident.

Windows are compared by a 64-bit hash of their words.  A null or empty text has no words and
fails.  Documents without a host form one host.  Rows with one id each get their row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import looked_up, written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OWN = (*COUNTS[:4], "n_lines")


def document_counts(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """docs' other columns and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    Windows are hashed for every document, but placed and sorted only where two hashes agree."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    trimmed = docs.select(*kept, t.alias("__text"), F.btrim(t, F.lit(BLANKS)).alias("__trimmed"))
    split = F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("__text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    symbols = F.length("__text") - F.length(F.regexp_replace("__text", f"[{SYMBOLS}]+", ""))
    zero = trimmed.select(*kept, split.alias("__split"), lines.alias("__lines"), symbols.cast("long").alias("n_symbols"))
    first = zero.select(
        *kept,
        "n_symbols",
        F.transform("__split", lambda w: F.xxhash64(w)).alias("__words"),
        F.length(F.array_join("__split", "")).cast("long").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
    )
    words, n = F.col("__words"), F.size("__words")
    hashed = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    second = first.select(
        *kept, "word_chars", "n_symbols", "n_dup_lines", "n_lines", n.cast("long").alias("n_words"),
        F.when(n >= width, hashed).otherwise(F.array().cast("array<bigint>")).alias("__hashes"),
    )
    hashes = F.col("__hashes")
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    third = second.select(*kept, *OWN, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed).otherwise(none).alias("__windows"))
    w = F.col("__windows")

    def twin(x, k):
        return F.coalesce(F.get(w, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(w, k + 1)["h"] == x["h"], F.lit(False))

    fourth = third.withColumn("__at", F.array_sort(F.transform(F.filter(w, twin), lambda x: x["i"])))
    at = F.col("__at")
    covered = F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return fourth.select(*kept, *OWN, total.alias("n_repeat_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) from columns n and failed, a row a host, by the moments of the beta-binomial: the
    variance between hosts beyond that within them."""
    share = F.col("failed") * F.col("failed") / F.col("n")
    r = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("x"), F.sum(share).alias("xx"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn")).first()
    if not r.k:
        return 0.5, 0.5
    mean = min(max(r.x / r.n, 0.001), 0.999)
    within = (r.x - r.xx) / (r.n - r.k) if r.n > r.k else mean * (1 - mean)
    alike = 0.0
    if r.k > 1:
        between, size = (r.xx - r.x * r.x / r.n) / (r.k - 1), (r.n - r.nn / r.n) / (r.k - 1)
        total = between + (size - 1) * within
        alike = (between - within) / total if total > 0 else 0.0
    alike = min(max(alike, 1e-4), 0.5)
    strength = 1 / alike - 1
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = 0.5, symbol_share: float = 0.1, line_share: float = 0.3, failure_odds: float = 20.0) -> DataFrame:
    """doc_id, host, the counts, base_failed, n_failed (further rules), any_failed, host_rate (shrunk) and kept."""
    counts = document_counts(docs.select("doc_id", F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    more = (F.col("n_symbols") > symbol_share * F.col("word_chars")).cast("int") + (F.col("n_dup_lines") > line_share * F.col("n_lines")).cast("int")
    counts = counts.withColumn("base_failed", base).withColumn("n_failed", more)
    counts = written(counts.withColumn("any_failed", F.col("base_failed") | (F.col("n_failed") > 0)))
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), F.count_if("any_failed").alias("failed"))
    hosts = written(hosts)
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    joined = looked_up(counts, hosts.select("host", rate.alias("host_rate")), "host", F.col("doc_id"))
    odds = F.col("host_rate") * F.pow(F.lit(failure_odds), F.col("n_failed")) * (1 - host_limit)
    return joined.withColumn("kept", ~F.col("base_failed") & (odds <= (1 - F.col("host_rate")) * host_limit))


def verdicts(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")
