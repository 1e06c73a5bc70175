"""Queries over resources: outcomes, identity, summaries, reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import resources as R
from quire.plans.registry import query, table


@query("""SELECT source, count(*) AS received, count(DISTINCT sha256(text)) AS "unique", CAST(sum(strlen(text)) AS BIGINT) AS received_bytes, CAST(u.b AS BIGINT) AS unique_bytes FROM documents JOIN
(SELECT source AS s, sum(b) AS b FROM (SELECT DISTINCT source, sha256(text), strlen(text) AS b FROM documents) GROUP BY 1) u ON u.s = source GROUP BY source, u.b""")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stored(table(spark, sf_dir, "documents").select("source", F.col("text").cast("binary").alias("body")))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as resource records of an order's page."""
    k = F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "external").when(k == 7, "omitted").otherwise("embedded")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), kind.alias("kind"), F.sha2(F.concat_ws(":", "l_partkey", "l_suppkey"), 256).alias("sha"), (F.col("l_partkey") % 1000 + 1).cast("bigint").alias("size"))
    return rows.select("page_id", "kind", F.when(F.col("kind") == "embedded", F.col("sha")).alias("digest"), F.when(F.col("kind") == "embedded", F.col("size")).alias("bytes"))


_RECORDS = """(SELECT page_id, kind, CASE WHEN kind = 'embedded' THEN sha END AS digest, CASE WHEN kind = 'embedded' THEN size END AS bytes FROM (SELECT l_orderkey AS page_id,
CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'external' WHEN l_linenumber = 7 THEN 'omitted' ELSE 'embedded' END AS kind, sha256(l_partkey || ':' || l_suppkey) AS sha, l_partkey % 1000 + 1 AS size FROM lineitem))"""


@query(f"""WITH r AS {_RECORDS}, b AS (SELECT page_id, CAST(sum(bytes) AS BIGINT) AS b FROM (SELECT DISTINCT page_id, digest, bytes FROM r WHERE kind = 'embedded') GROUP BY 1)
SELECT r.page_id, count(*) AS discovered, count(*) FILTER (kind = 'embedded') AS embedded, count(*) FILTER (kind = 'external') AS "external", count(*) FILTER (kind = 'omitted') AS omitted, count(*) FILTER (kind = 'failed') AS failed, coalesce(max(b.b), 0) AS embedded_bytes FROM r LEFT JOIN b USING (page_id) GROUP BY 1""")
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(_records(spark, sf_dir))


@query("""SELECT sha256(l_suppkey || '') AS digest, min(l_partkey % 1000 + 1) AS least, max(l_partkey % 1000 + 1) AS most FROM lineitem GROUP BY 1 HAVING min(l_partkey % 1000) <> max(l_partkey % 1000)""")
def length_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.sha2(F.col("l_suppkey").cast("string"), 256).alias("digest"), (F.col("l_partkey") % 1000 + 1).cast("bigint").alias("bytes"))
    return R.length_conflicts(rows)


@query("""WITH e AS (SELECT l_partkey AS k, l_returnflag AS f, count(*) AS expected FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), o AS (SELECT l_partkey AS k, l_returnflag AS f, count(*) AS observed FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL)
SELECT k AS l_partkey, f AS l_returnflag, coalesce(expected, 0) AS expected, coalesce(observed, 0) AS observed, greatest(coalesce(expected, 0) - coalesce(observed, 0), 0) AS missing, greatest(coalesce(observed, 0) - coalesce(expected, 0), 0) AS surplus
FROM e FULL JOIN o USING (k, f) WHERE coalesce(expected, 0) <> coalesce(observed, 0)""")
def manifest_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return R.multiset_difference(rows.where("l_linenumber <= 3"), rows.where("l_linenumber >= 3"), ["l_partkey", "l_returnflag"])


@query("""WITH r AS (SELECT user_id, event_type, event_id AS sequence, CASE WHEN event_id % 97 = 0 THEN 'v2' ELSE 'v1' END AS variant, event_id % 89 <> 0 AS reusable,
CASE WHEN event_id % 61 = 0 THEN 'too-large' WHEN event_id % 3 = 0 THEN 'unavailable' ELSE 'complete' END AS state, event_id % 53 <> 0 AS finished, event_id % 5 = 0 AS failed, CASE WHEN user_id % 2 = 0 THEN 'same' ELSE 'c' || event_id % 2 END AS content FROM events)
SELECT user_id, event_type, CASE WHEN bool_or(NOT finished) THEN 'pending' WHEN min(variant) <> max(variant) OR NOT bool_and(reusable) THEN 'ambiguous' WHEN count(*) FILTER (NOT failed AND state = 'complete') = 0 THEN CASE WHEN bool_or(state = 'too-large') THEN 'too-large' ELSE 'unavailable' END
WHEN min(content) FILTER (NOT failed) <> max(content) FILTER (NOT failed) THEN 'ambiguous' ELSE 'ready' END AS verdict,
CASE WHEN NOT bool_or(NOT finished) AND NOT (min(variant) <> max(variant) OR NOT bool_and(reusable)) AND NOT (min(content) FILTER (NOT failed) <> max(content) FILTER (NOT failed)) THEN max(sequence) FILTER (NOT failed AND state = 'complete') END AS sequence FROM r GROUP BY 1, 2""")
def latest_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_type", e.alias("sequence"), F.when(e % 97 == 0, "v2").otherwise("v1").alias("variant"), (e % 89 != 0).alias("reusable"),
        F.when(e % 61 == 0, "too-large").when(e % 3 == 0, "unavailable").otherwise("complete").alias("state"), (e % 53 != 0).alias("finished"), (e % 5 == 0).alias("failed"), F.when(F.col("user_id") % 2 == 0, "same").otherwise(F.concat(F.lit("c"), (e % 2).cast("string"))).alias("content"),
    )
    return R.reusable_responses(rows, ["user_id", "event_type"])


@query("""SELECT user_id, count(*) AS requests, count(DISTINCT CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END || event_type || (event_id % 2)) AS variants FROM events GROUP BY 1""")
def request_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different requests each user made; header names' case and order don't count."""
    e = F.col("event_id")
    headers = F.when(e % 5 == 0, F.create_map(F.lit("Accept"), F.col("event_type"), F.lit("X-N"), (e % 2).cast("string"))).otherwise(F.create_map(F.lit("x-n"), (e % 2).cast("string"), F.lit("ACCEPT"), F.col("event_type")))
    rows = table(spark, sf_dir, "events").select("user_id", R.variant_key(F.when(e % 3 == 0, "POST").otherwise("GET"), F.lit(False), headers).alias("v"))
    return rows.groupBy("user_id").agg(F.count("*").alias("requests"), F.countDistinct("v").alias("variants"))


@query("""SELECT DISTINCT l_orderkey AS page_id, 'https://h/' || l_partkey AS url FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = l.l_orderkey AND f.l_partkey = l.l_partkey AND f.l_returnflag = 'R')""")
def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to load once failed URLs are remembered."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("https://h/"), F.col("l_partkey").cast("string")).alias("url"), "l_returnflag", F.col("l_linenumber").cast("string").alias("n"))
    refs = rows.select("page_id", F.concat("url", F.lit("#"), "n").alias("resolved"))
    return R.fetch_plan(refs, rows.where("l_returnflag = 'R'"))


@query("""SELECT l_orderkey AS page_id, min(pos) AS pos, min_by(run, pos) AS attempted FROM (SELECT l_orderkey, pos, CAST(sum(size) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM
(SELECT l_orderkey, l_partkey * 10 + l_linenumber AS pos, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size FROM lineitem GROUP BY ALL)) WHERE run > 100 GROUP BY 1""")
def budget_first_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").cast("bigint").alias("size")).groupBy("page_id", "pos").agg(F.sum("size").alias("size"))
    return R.budget(items, "page_id", "pos", "size", 100)


@query("""WITH r AS (SELECT o_orderkey AS page_id, 0 AS ref_id, 'image' AS role, 'https://h/' || o_orderkey AS resolved, o_orderstatus AS st, o_orderpriority AS body FROM orders UNION ALL SELECT o_orderkey, 1, 'stylesheet', 'data:text/css;base64,' || base64(encode(o_orderpriority)), o_orderstatus, o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 2, 'other', 'ftp://h/x', o_orderstatus, '' FROM orders),
x AS (SELECT *, CASE WHEN ref_id = 2 THEN 'resource.scheme' WHEN ref_id = 0 AND page_id % 5 = 0 THEN 'resource.missing' WHEN ref_id = 0 AND st = 'P' THEN 'resource.status' END AS error FROM r)
SELECT page_id, ref_id, CASE WHEN error IS NULL THEN 'embedded' ELSE 'failed' END AS kind, CASE WHEN error IS NULL THEN sha256(body) END AS digest, CASE WHEN error IS NULL THEN CASE ref_id WHEN 1 THEN 'text/css' ELSE CASE WHEN st = 'F' THEN 'image/png' ELSE 'application/octet-stream' END END END AS media_type, error FROM x""")
def resolved_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of three kinds against a table of responses: found, missing, refused, read in place."""
    o = table(spark, sf_dir, "orders")
    page = F.col("o_orderkey").alias("page_id")
    url = F.concat(F.lit("https://h/"), F.col("o_orderkey").cast("string"))
    refs = o.select(page, F.lit(0).alias("ref_id"), F.lit("image").alias("role"), url.alias("resolved")).union(o.select(page, F.lit(1), F.lit("stylesheet"), F.concat(F.lit("data:text/css;base64,"), F.base64(F.col("o_orderpriority").cast("binary"))))).union(o.select(page, F.lit(2), F.lit("other"), F.lit("ftp://h/x")))
    bodies = o.where("o_orderkey % 5 <> 0").select(page, url.alias("url"), F.when(F.col("o_orderstatus") == "P", 503).otherwise(200).alias("status"), F.when(F.col("o_orderstatus") == "F", "Image/PNG; q=1").alias("media_type"), F.col("o_orderpriority").cast("binary").alias("body"))
    return R.outcomes(refs, bodies).select("page_id", "ref_id", "kind", "digest", "media_type", "error")


@query("""SELECT o_orderkey AS page_id, 0 AS ref_id, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END AS outcomes FROM orders WHERE o_orderstatus <> 'F'""")
def incomplete_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    refs = o.select(F.col("o_orderkey").alias("page_id"), F.lit(0).alias("ref_id"))
    once, twice = refs.join(o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("page_id")), "page_id"), refs.join(o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("page_id")), "page_id")
    return R.completeness(refs, once.unionByName(twice))
