"""Queries over batches and crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import scheduling as S
from quire.plans.registry import query, table


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR (o_orderkey % 9 = 0) THEN 'pending' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'pending' ELSE 'resumed' END AS state FROM orders""")
def batch_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs against a checkpoint: new ones, changed requests, failures, successes whose file is unchanged or not."""
    o = table(spark, sf_dir, "orders")
    job = F.col("o_orderkey").cast("string")
    jobs = o.select("o_orderkey", job.alias("job_id"), F.concat(F.lit("d"), job).alias("request_digest"))
    done = o.where("o_orderkey % 4 <> 0")
    records = done.select(job.alias("job_id"), F.when(F.col("o_orderkey") % 9 == 0, "old").otherwise(F.concat(F.lit("d"), job)).alias("request_digest"), F.when(F.col("o_orderstatus") == "P", "failure").otherwise("success").alias("outcome"), F.concat(F.lit("f"), job).alias("artifact"), F.lit("x").alias("artifact_digest"))
    files = done.where("o_orderstatus <> 'P'").select(F.concat(F.lit("f"), job).alias("path"), F.when(F.col("o_orderkey") % 7 == 0, "y").otherwise("x").alias("digest"))
    return S.resumed(jobs, records, files).select("o_orderkey", "state")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus <> 'P') AS succeeded, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderkey % 3 = 0) AS resumed FROM orders GROUP BY 1""")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "P", "failure").otherwise("success").alias("outcome"), (F.col("o_orderkey") % 3 == 0).alias("was_resumed"))
    return S.counts(rows, "o_orderpriority")


@query("""WITH j AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN ' ' WHEN o_orderkey % 50 = 1 THEN 'twice' ELSE CAST(o_orderkey AS VARCHAR) END AS job_id, CASE WHEN o_orderkey % 50 = 2 THEN 'ftp://x' ELSE 'https://x/' END AS url, o_orderkey % 50 = 3 AS resume FROM orders)
SELECT job_id, CASE WHEN trim(job_id) = '' THEN 'input.job_id' WHEN job_id = 'twice' THEN 'input.duplicate_job' WHEN url LIKE 'ftp%' THEN 'input.url' ELSE 'input.resume_output' END AS error FROM j WHERE job_id IN (' ', 'twice') OR url LIKE 'ftp%' OR resume""")
def batch_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(F.when(k % 50 == 0, " ").when(k % 50 == 1, "twice").otherwise(k.cast("string")).alias("job_id"), F.when(k % 50 == 2, "ftp://x").otherwise("https://x/").alias("url"), (k % 50 == 3).alias("resume"), F.when(k % 50 == 3, "memory").otherwise("file").alias("output"))
    return S.job_errors(jobs)


_EDGES = "SELECT DISTINCT 'n' || l_suppkey AS source, 'n' || (l_partkey % 211) AS target FROM lineitem"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), c(url, depth) AS (SELECT 'n1', 0 UNION SELECT e.target, depth + 1 FROM c JOIN e ON e.source = c.url WHERE depth < 2)
SELECT url, min(depth) AS depth FROM c GROUP BY 1""")
def crawl_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth first to depth 2 without a bound on pages: which pages at which depth."""
    return S.crawl(_edges(spark, sf_dir), "n1", depth=2, pages=100_000).select("url", "depth")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("n"), (F.col("l_partkey") % 211).cast("string")).alias("target")).distinct()


@query(f"""WITH e AS ({_EDGES}), l0 AS (SELECT 'n1' AS url, 0 AS ordinal), l1 AS (SELECT target AS url, row_number() OVER (ORDER BY target) AS ordinal FROM e WHERE source = 'n1' AND target <> 'n1'),
l2 AS (SELECT target AS url, (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY p, target) AS ordinal FROM (SELECT target, min(ordinal) AS p FROM e JOIN l1 ON source = url WHERE target <> 'n1' AND target NOT IN (SELECT url FROM l1) GROUP BY 1))
SELECT * FROM (SELECT url, 0 AS depth, ordinal FROM l0 UNION ALL SELECT url, 1, ordinal FROM l1 UNION ALL SELECT url, 2, ordinal FROM l2) WHERE ordinal < 20""")
def crawl_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty pages of a crawl, numbered as they were found."""
    return S.crawl(_edges(spark, sf_dir), "n1", depth=2, pages=20)


@query("""WITH i AS (SELECT 'u' || (o_custkey % 400) AS url, 1 + o_custkey % 4 AS depth, min(o_orderkey) AS ordinal FROM orders GROUP BY 1, 2) SELECT url, depth, ordinal FROM i WHERE depth = (SELECT min(depth) FROM i) ORDER BY ordinal, url LIMIT 25""")
def frontier_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.concat(F.lit("u"), (F.col("o_custkey") % 400).cast("string")).alias("url"), (F.col("o_custkey") % 4 + 1).alias("depth"), F.col("o_orderkey").alias("ordinal"))
    return S.frontier(items, 25, 100)


@query("""SELECT id, CASE WHEN n = 0 THEN path ELSE left(path, length(path) - 5) || '-' || n || '.html' END AS path FROM (SELECT p_partkey AS id, replace(p_name, ' ', '_') || '.html' AS path, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 + CASE WHEN p_name LIKE 'red%' THEN 1 ELSE 0 END AS n FROM part)""")
def unique_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".html"))
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))
    return S.unique_names(wanted, wanted.where(F.col("path").startswith("red")).select("path"))


@query("""SELECT n_regionkey AS k, count(*) AS files, sha256(string_agg(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'd/' || n_name END || ':' || strlen(repeat(n_name, 3)) || ':' || sha256(repeat(n_name, 3)), chr(10) ORDER BY n_nationkey % 2, n_name)) AS digest FROM nation GROUP BY 1""")
def directory_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("d/"), "n_name")).alias("path"), F.repeat("n_name", 3).cast("binary").alias("body"))
    return S.directory_digest(files, "k")
