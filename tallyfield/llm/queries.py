"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.token_file import token_file

    return token_file(table(spark, sf_dir, "documents"), end_id=2)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


ORACLE_SQL["op2_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k
  FROM documents),
d2 AS (
  SELECT *, size - size % CAST(pow(2, greatest(0, length(bin(size)) - 10)) AS BIGINT) AS class,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)
           % (64 * (1 + (SELECT count(*) FROM d) // 6400000)) AS salt
  FROM d),
s0 AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
s1 AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w FROM s0),
s2 AS (SELECT *, source_size / w AS fill FROM s1),
s3 AS (
  SELECT *, row_number() OVER f AS n,
         CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
           - CAST(2.0 AS DOUBLE) * CAST(coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM s2 WINDOW f AS (ORDER BY fill, k)),
lev AS (SELECT n AS ln, rest AS lrest, rest_w AS lw FROM s3
        WHERE w * rest / rest_w <= CAST(2.0 AS DOUBLE) * source_size ORDER BY n LIMIT 1),
t AS (SELECT k, source_size, CASE WHEN n >= ln THEN w * lrest / lw ELSE CAST(2.0 AS DOUBLE) * source_size END AS target FROM s3, lev),
r AS (SELECT d2.*, source_size, target,
             row_number() OVER (PARTITION BY d2.k ORDER BY class, salt, size, doc_id NULLS FIRST) AS r,
             CAST('0x' || substr(md5('offset:' || d2.k), 1, 5) AS BIGINT) / CAST(1048576.0 AS DOUBLE) AS u
      FROM d2 JOIN t ON d2.k = t.k),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(r * target / source_size + u) - floor((r - 1) * target / source_size + u) AS BIGINT) ELSE 0 END AS copies FROM r)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target, copies, CAST(copies * size AS BIGINT) AS taken FROM c
"""


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


@query
def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.quality_rules import ablations, ledger

    return ablations(ledger(table(spark, sf_dir, "documents")))


_LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT k, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w),
win AS (SELECT k, i, count(*) OVER (PARTITION BY k, words[i:i + 7]) AS c FROM pos),
rep AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nx FROM win WHERE c > 1),
cov AS (SELECT k, CAST(sum(least(8, coalesce(nx - i, 8))) AS BIGINT) AS n_repeat_words FROM rep GROUP BY k),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (k)),
led AS (SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
          + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
          + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
"""
ORACLE_SQL["op8_quality_rules"] = _LEDGER_SQL + "SELECT *, (fail_bits & 31) = 0 AS kept, (fail_bits & 3) <> 0 AS base_failed FROM led"
ORACLE_SQL["quality_rule_ablations"] = _LEDGER_SQL + """,
p(policy, mask, rule, bit) AS (VALUES ('base', 3, 'too_few_words', 1), ('base', 3, 'repeated_words', 2),
  ('v1', 7, 'too_few_words', 1), ('v1', 7, 'repeated_words', 2), ('v1', 7, 'symbols', 4),
  ('v2', 31, 'too_few_words', 1), ('v2', 31, 'repeated_words', 2), ('v2', 31, 'symbols', 4),
  ('v2', 31, 'repeated_lines', 8), ('v2', 31, 'word_length', 16))
SELECT policy, rule, count(*) AS n_docs, count(*) FILTER ((fail_bits & mask) <> 0) AS n_rejected,
       count(*) FILTER ((fail_bits & mask & bit) <> 0) AS n_failing, count(*) FILTER ((fail_bits & mask) = bit) AS n_only
FROM led, p GROUP BY policy, rule
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.toxicity import fit, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails
  FROM d LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM m GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(p, lambda i: 'ABCDE'[i]), '') AS filter_order, f.i AS step, p[f.i] AS f, p[1:f.i - 1] AS earlier FROM o, f),
r AS (
  SELECT part, filter_order, step, f, n, g, x, fails[f] AS failing,
         len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda b: b)) = 1 AND fails[f] AS sole
  FROM c, s),
a AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, f,
         CAST(coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND failing), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (sole), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(g) FILTER (NOT gone AND failing), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER (NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, f)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM a
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.periodic_runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), remake=True).drop("collapsed")


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.relative_parse import remove_repeated_words

    return remove_repeated_words(table(spark, sf_dir, "documents")).drop("kept")


ORACLE_SQL["op11_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM pos),
lo AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i FROM win JOIN lo USING (s) WHERE doc_id > lo),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
near AS (SELECT word.doc_id, word, i, max(hit.i) OVER (PARTITION BY word.doc_id ORDER BY word.i) AS h FROM word LEFT JOIN hit USING (doc_id, i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) FILTER (h IS NULL OR h < i - 49) AS t, count(*) FILTER (h >= i - 49) AS n_removed FROM near GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
