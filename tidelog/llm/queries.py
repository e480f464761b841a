"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, decontamination, line_dedup, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup, toxicity, url_filter
from tidelog.llm.common import table


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), byte_bpe_path())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digests(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passage_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_url_filter": op5_url_filter,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
}

LINE_SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i
  from documents),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
frequent as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 40
  group by k having count(distinct doc_id) >= 5),
marked as (
  select l.doc_id, l.line, l.i, f.k is not null and l.doc_id <> f.keeper as lost
  from keyed l left join frequent f on l.k = f.k)
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not lost), '')) as kept_sha256
from marked group by doc_id
"""

QUALITY_SQL = r"""
with docs as (
  select row_number() over () as row, doc_id, source as host, coalesce(text, '') as t from documents),
words as (
  select row, unnest(ws) as w, unnest(range(len(ws))) as i
  from (select row, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from docs)),
windows as (
  select row, i, string_agg(w, ' ') over five as g, count(*) over five as k
  from words window five as (partition by row order by i rows between current row and 4 following)),
twice as (
  select row, i from (select row, i, count(*) over (partition by row, g) as c from windows where k = 5) where c > 1),
repeated as (
  select row, count(distinct j) as n_repeat_words
  from (select row, unnest(range(i, i + 5)) as j from twice) group by row),
lines as (
  select row, count(*) - count(distinct line) as n_dup_lines, count(*) as n_lines
  from (select row, unnest(string_split(t, chr(10))) as line from docs)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by row),
counted as (
  select row, count(*) as n_words, sum(length(w)) as word_chars from words group by row),
stats as (
  select d.row, doc_id, host, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
         cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from docs d left join counted using (row) left join lines using (row) left join repeated using (row)),
judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
         (n_symbols > 0.1::double * word_chars)::int + (n_dup_lines > 0.3::double * n_lines)::int as n_failed from stats),
hosts as (
  select host, count(*) as n, count(*) filter (where base_failed or n_failed > 0) as failed from judged group by host),
sums as (
  select count(*) as k, sum(n) as n, sum(failed) as x, sum(failed * failed / n) as xx, sum(n * n)::double as nn from hosts),
spread as (
  select *, least(greatest(x / n, 0.001), 0.999) as m, (xx - x * x / n) / nullif(k - 1, 0) as b, (n - nn / n) / nullif(k - 1, 0) as s from sums),
within_hosts as (
  select *, case when n > k then (x - xx) / (n - k) else m * (1 - m) end as w from spread),
prior as (
  select m, 1 / least(greatest(coalesce((b - w) / nullif(b + (s - 1) * w, 0), 0), 1e-4), 0.5) - 1 as strength from within_hosts),
rates as (
  select host, (failed + m * strength) / (n + strength) as host_rate from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and host_rate * power(20, n_failed) <= 1 - host_rate as kept
from judged j join rates r on j.host is not distinct from r.host
"""

PASSAGE_SQL = r"""
with docs as (
  select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
words as (select row, doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from docs),
windows as (
  select row, doc_id, unnest(range(len(ws) - 49)) as i, unnest(list_transform(range(len(ws) - 49), lambda k: md5(array_to_string(ws[k + 1 : k + 50], ' ')))) as g
  from docs where len(ws) >= 50),
first as (select g, min(doc_id) as least from windows group by g),
gone as (
  select distinct row, unnest(range(w.i, w.i + 50)) as i from windows w join first f using (g) where f.least < w.doc_id)
select d.doc_id, count(w.w) as n_words, count(g.i) as n_removed,
       sha256(coalesce(string_agg(w.w, ' ' order by w.i) filter (where g.i is null), '')) as kept_sha256
from docs d left join words w on d.row = w.row left join gone g on w.row = g.row and w.i = g.i
group by d.row, d.doc_id
"""

ORACLES: dict[str, str] = {"op2_line_dedup": LINE_SQL, "op3_quality_rules": QUALITY_SQL, "op10_substring_dedup": PASSAGE_SQL}
