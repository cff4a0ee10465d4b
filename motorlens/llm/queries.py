"""The registered queries of the operators and, where one can be written, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.llm import (
    collocations, decontaminate, filter_audit, html_text, language, license_scan, mixing, ngram_join, quality, sharding,
    suffix_lm, toxicity, url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).drop("_hash")


@query("op8_shard_documents")
def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


URL_TWIN = r"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), named AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '') AS canonical,
    CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM named WHERE canonical <> '' AND regexp_matches(host,
    '(^|[._-])(ad|ads|adserver|adult|banner|bet|bets|betting|casino|click|clicks|counterfeit|crack|escort|gambling|jackpot|keygen'
    || '|loan|loans|malware|payday|pharmacy|phishing|pills|poker|porn|replica|roulette|sex|slots|spam|track|tracker|tracking'
    || '|viagra|warez|xxx)([._-]|$)')
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""


@query("op9_filter_urls", URL_TWIN)
def op9_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.listed_urls(pages))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"))


@query("op5_find_benchmark")
def op5_find_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), proximity=True)


@query("op2_extract_text")
def op2_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


@query("op4_score_toxicity")
def op4_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op6_identify_language")
def op6_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_language(_table(spark, sf_dir, "documents"))


@query("op3_score_suffix_tree")
def op3_score_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score_documents(_table(spark, sf_dir, "documents"))


@query("op1_join_ngrams")
def op1_join_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(_table(spark, sf_dir, "documents")).drop("identity")


AUDIT_TWIN = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d
), m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM f
  LEFT JOIN (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY ALL
), names AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, bit)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM names a, names b, names c, names d, names e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(bits[1:step]) AS INT) AS upto FROM orders, range(1, 6) AS s(step)
), counted AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & upto = bit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & upto <> bit THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & upto = bit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & upto = bit THEN bad ELSE 0 END) AS toxic_lost
  FROM m, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""


@query("op12_audit_filters", AUDIT_TWIN)
def op12_audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


COLLOCATION_TWIN = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p
), totals AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang
), grams AS (
  SELECT lang, w[i:i + k - 1] AS g, count(*) AS f FROM places, range(1, 5) AS s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30
), cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM grams WHERE len(g) > 1
), scored AS (
  SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, CAST(c.a AS HUGEINT) * 2000000 // (x.f + y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN grams y ON y.lang = c.lang AND y.g = c.g[k + 1:len(c.g)]
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, g[b:b + m - 1] AS g, max(f) AS f FROM grams, range(2, 4) AS s(m), range(1, 4) AS t(b)
  WHERE len(g) > m AND b + m - 1 <= len(g) GROUP BY ALL
), kept AS (
  SELECT w.*, array_to_string(w.g, ' ') AS phrase FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.g = w.g
  WHERE i.f IS NULL OR 100 * i.f < 80 * w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op13_mine_collocations", COLLOCATION_TWIN)
def op13_mine_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


@query("op11_scan_licenses")
def op11_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
