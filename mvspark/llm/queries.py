"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mvspark.llm import decontaminate, embeddings, language, mixing, pii, simhash, token_counts, token_store, toxicity, url_filter
from mvspark.llm.common import importable, shared_dir, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_sections(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_frame(spark))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
j AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host || path, '(?i)(?:^|[./_-])online[_-]casino(?:[./_-]|$)|(?:^|[./_-])casino[_-]bonus(?:[./_-]|$)|(?:^|[./_-])free[_-]porn(?:[./_-]|$)|(?:^|[./_-])xxx(?:[./_-]|$)|(?:^|[./_-])buy[_-]viagra(?:[./_-]|$)|(?:^|[./_-])payday[_-]loans?[./_-]online|(?:^|\.)adserver\.|/warez/|/torrent/download(?:/|$)|/cgi-bin/redirect(?:[./]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM j
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP3_SQL = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS span
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, lens WHERE len(w) >= n)),
hits AS (SELECT dw.rid, dw.n, dw.i, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.span = iw.span),
cover AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT rid, n, i FROM hits)) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN cover USING (rid) LEFT JOIN ids USING (rid)
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.digest(pii.find(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid4().hex}"
    token_store.write_shards(table(spark, sf_dir, "documents"), path)
    return token_store.read_documents(spark, path).drop("shard")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), repeats=1.25)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, chr(1)) AS s, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+')) AS n, md5('doc:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
o AS (SELECT *, md5('block:' || s || ':' || CAST(CAST(('0x' || substr(k, 1, 8)) AS BIGINT) % 1024 AS VARCHAR)) AS b FROM d),
t AS (SELECT s, sum(n) AS t FROM d GROUP BY s),
l AS (SELECT list(CAST(t AS DOUBLE) ORDER BY s) AS ts, CAST(sum(t) AS DOUBLE) AS total FROM t WHERE t > 0),
bis(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN f THEN mid ELSE lo END, CASE WHEN f THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               list_max(list_transform(ts, lambda x: pow(x / total, (lo + hi) / 2) / list_sum(list_transform(ts, lambda y: pow(y / total, (lo + hi) / 2))) * total / x)) > 1.25 AS f
        FROM bis, l) WHERE i < 50),
a AS (SELECT CASE WHEN (SELECT count(*) FROM t WHERE t > 0) < 2 THEN 1 ELSE hi END AS alpha FROM bis WHERE i = 50),
w AS (SELECT s, t, floor(pow(t / total, alpha) / list_sum(list_transform(ts, lambda y: pow(y / total, alpha))) * total) AS target FROM t, l, a WHERE t > 0),
p AS (SELECT t.s, CASE WHEN t.t = 0 THEN 1 ELSE CAST(target AS BIGINT) // t.t END AS passes, CASE WHEN t.t = 0 THEN 0 ELSE CAST(target AS BIGINT) % t.t END AS rest FROM t LEFT JOIN w USING (s)),
c AS (
  SELECT s, b, total_b, rest - coalesce(sum(total_b) OVER (PARTITION BY s ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM (SELECT s, b, sum(n) AS total_b FROM o GROUP BY s, b) JOIN p USING (s)),
e AS (SELECT s, min(b) AS edge, arg_min(room, b) AS room FROM c WHERE total_b > room GROUP BY s),
u AS (SELECT s, max(k) AS cut FROM (SELECT o.s, k, room, sum(n) OVER (PARTITION BY o.s ORDER BY k RANGE UNBOUNDED PRECEDING) AS used FROM o JOIN e ON o.s = e.s AND o.b = e.edge) WHERE used <= room GROUP BY s)
SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens, CAST(passes + CASE WHEN b < edge OR (b = edge AND k <= cut) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM o JOIN p USING (s) LEFT JOIN e USING (s) LEFT JOIN u USING (s)
"""


def _registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Lets Python workers import this package wherever the driver was started."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: _registered(q) for q in (
    op1_token_counts, op2_url_filter, op3_decontaminate, op4_pii, op5_token_store, op6_language, op7_embeddings, op8_toxicity, op9_simhash, op10_mixing
)}
SQL: dict[str, str] = {"op2_url_filter": OP2_SQL, "op3_decontaminate": OP3_SQL, "op10_mixing": OP10_SQL}
