"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.bpe import encode_digests
from foliospark.llm.exact_dedup import exact_dedup
from foliospark.llm.html_extract import extract_pages
from foliospark.llm.language_id import identify_languages
from foliospark.llm.packing import pack_documents
from foliospark.llm.quality_rules import quality_filter
from foliospark.llm.sharding import SHARD_SQL, stratified_shards
from foliospark.llm.simhash import near_duplicates
from foliospark.llm.substring_dedup import remove_repeats
from foliospark.llm.url_filter import UrlRule, judge_urls, url_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (UrlRule("block", "net"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages whose document is labelled: paths are /language/document."""
    number = F.regexp_extract(url_path(F.col("url")), r"^/[a-z]+/(\d{1,18})(?:\D|$)", 1)
    named = pages.select("url", number.alias("number")).filter("number != ''").select("url", F.col("number").cast("long").alias("doc_id"))
    bad = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END")).alias("bad"))
    return named.join(bad, "doc_id").select("url", "bad")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, seed=42)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=35, with_text=False)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), URL_RULES).drop("bad_bound")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(table(spark, sf_dir, "documents"), n_shards=8, seed=42)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_packing, op3_substring_dedup, op4_url_filter, op5_quality_rules, op6_html_extract, op7_exact_dedup, op8_bpe, op9_sharding, op10_language_id)}

URL_SQL = """
WITH u AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT u.host, b.bad FROM u JOIN b ON b.doc_id = TRY_CAST(regexp_extract(u.path, '^/[a-z]+/([0-9]{1,18})([^0-9]|$)', 1) AS BIGINT)),
h0 AS (
  SELECT host, string_split(host, '.') AS p, count(*) AS n, sum(bad) AS y FROM o GROUP BY host
),
h1 AS (
  SELECT host, n, y, array_to_string(p[CASE WHEN len(p) >= 3 AND len(p[-1]) = 2 AND p[-2] IN ('ac','co','com','edu','gov','net','org') THEN -3 ELSE -2 END:], '.') AS domain FROM h0
),
h AS (SELECT *, CASE WHEN contains(domain, '.') THEN substr(domain, instr(domain, '.') + 1) ELSE '' END AS suffix FROM h1),
t AS (SELECT (coalesce(sum(y), 0) + 1) / (coalesce(sum(n), 0) + 2)::DOUBLE AS rate FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(y) AS y, any_value(rate) AS p, least(greatest(any_value(rate), 0.001), 0.999) AS c FROM h, t GROUP BY suffix),
sm AS (SELECT 1 / least(0.5, greatest(0.01, CASE WHEN sum(n * (n - 1)) > 0 THEN (sum((y - n * c) * (y - n * c) / (c * (1 - c))) - sum(n)) / sum(n * (n - 1)) ELSE 0.1 END)) - 1 AS m FROM s0),
s AS (SELECT suffix, (y + m * p) / (n + m) AS p FROM s0, sm),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY ALL),
d1 AS (SELECT d0.*, s.p, least(greatest(s.p, 0.001), 0.999) AS c FROM d0 JOIN s USING (suffix)),
dm AS (SELECT 1 / least(0.5, greatest(0.01, CASE WHEN sum(n * (n - 1)) > 0 THEN (sum((y - n * c) * (y - n * c) / (c * (1 - c))) - sum(n)) / sum(n * (n - 1)) ELSE 0.1 END)) - 1 AS m FROM d1),
d AS (SELECT domain, (y + m * p) / (n + m) AS p FROM d1, dm),
g1 AS (SELECT h.host, h.n, h.y, d.p, least(greatest(d.p, 0.001), 0.999) AS c FROM h JOIN d USING (domain)),
gm AS (SELECT 1 / least(0.5, greatest(0.01, CASE WHEN sum(n * (n - 1)) > 0 THEN (sum((y - n * c) * (y - n * c) / (c * (1 - c))) - sum(n)) / sum(n * (n - 1)) ELSE 0.1 END)) - 1 AS m FROM g1),
g2 AS (SELECT host, y + m * p AS a, n - y + m * (1 - p) AS z FROM g1, gm),
g AS (SELECT host, a / (a + z) - 1.645 * sqrt(a / (a + z) * (1 - a / (a + z)) / (a + z + 1)) AS bad_bound FROM g2),
k0 AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM u),
k1 AS (
  SELECT host, array_to_string(p[CASE WHEN len(p) >= 3 AND len(p[-1]) = 2 AND p[-2] IN ('ac','co','com','edu','gov','net','org') THEN -3 ELSE -2 END:], '.') AS domain FROM k0
),
k2 AS (SELECT *, CASE WHEN contains(domain, '.') THEN substr(domain, instr(domain, '.') + 1) ELSE '' END AS suffix FROM k1),
k3 AS (
  SELECT k2.host, g.bad_bound, coalesce(d.p, s.p, t.rate) AS p,
         gm.m / (gm.m + 1) * CASE WHEN d.p IS NULL THEN dm.m / (dm.m + 1) ELSE 1 END * CASE WHEN d.p IS NULL AND s.p IS NULL THEN sm.m / (sm.m + 1) ELSE 1 END AS kept
  FROM k2 LEFT JOIN g USING (host) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix), t, gm, dm, sm
),
k AS (SELECT host, CASE WHEN bad_bound IS NOT NULL THEN bad_bound WHEN host <> '' THEN p - 1.645 * sqrt(p * (1 - p) * (1 - kept)) END AS bad_bound FROM k3),
j AS (
  SELECT u.*, bad_bound, CASE
    WHEN (u.host = 'example.net' OR suffix(u.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (u.host = 'example.com' OR suffix(u.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (u.host = 'org' OR suffix(u.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (u.host = 'net' OR suffix(u.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u LEFT JOIN k USING (host)
)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END END AS verdict
FROM j
"""

ORACLE_SQL = {
    "op4_url_filter": URL_SQL,
    "op3_substring_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
c AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY h) > 1),
m AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM c),
x AS (SELECT r, list(j) AS gone, count(*) AS n FROM m GROUP BY r),
e AS (SELECT d.r, d.doc_id, d.w, unnest(range(1, greatest(len(d.w), 1) + 1)) AS j FROM d),
k AS (SELECT e.r, string_agg(e.w[e.j], ' ' ORDER BY e.j) FILTER (WHERE m.j IS NULL) AS kept FROM e LEFT JOIN m ON m.r = e.r AND m.j = e.j GROUP BY e.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d JOIN k USING (r) LEFT JOIN x USING (r)
""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op9_sharding": SHARD_SQL,
}
