"""Queries over frames, assets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import frames as R
from quire.plans.registry import query, table


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as frames: 0 is a page's main frame, each other one lies in the frame of half its number."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.lit(1).alias("page_id"), k.alias("frame_id"), F.when(k > 0, F.floor(k / 2)).alias("parent_id"), F.when(k % 3 == 0, F.array(k, k)).otherwise(F.array(k)).alias("path"))


@query("""WITH RECURSIVE d AS (SELECT s_suppkey AS k, 0 AS depth FROM supplier WHERE s_suppkey = 0 UNION ALL SELECT s.s_suppkey, depth + CASE WHEN s.s_suppkey % 3 = 0 THEN 2 ELSE 1 END FROM d JOIN supplier s ON s.s_suppkey > 0 AND s.s_suppkey // 2 = d.k)
SELECT 1 AS page_id, k AS frame_id, depth, row_number() OVER (ORDER BY depth DESC, k) AS turn FROM d""")
def frame_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.processing_order(_frames(spark, sf_dir))


@query("""WITH RECURSIVE d AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey = 0 UNION ALL SELECT s.s_suppkey FROM d JOIN supplier s ON s.s_suppkey > 0 AND s.s_suppkey // 2 = d.k WHERE s.s_suppkey % 5 > 0 AND s.s_suppkey % 7 > 0)
SELECT k AS frame_id, CASE WHEN k = 0 THEN 0 ELSE k + 1000 END AS owner FROM d""")
def retained_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are left once some owners went (numbers divisible by 5) and others are empty (by 7)."""
    frames = _frames(spark, sf_dir)
    owners = frames.where("frame_id > 0 AND frame_id % 5 > 0").select("page_id", F.col("parent_id").alias("frame_id"), F.col("path").alias("original"), F.when(F.col("frame_id") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("frame_id") + 1000)).alias("path"))
    return R.retained(frames, owners).select("frame_id", F.get("path", F.lit(0)).alias("owner"))


@query("""SELECT user_id AS frame_id, event_id AS idx, CASE WHEN event_type = 'error' THEN 'cross-origin' ELSE event_type END AS code FROM events QUALIFY event_type <> 'error' OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > user_id % 4""")
def cross_origin_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    warnings = events.select(F.col("user_id").alias("frame_id"), F.col("event_id").alias("idx"), F.when(F.col("event_type") == "error", "cross-origin").otherwise(F.col("event_type")).alias("code"))
    captured = events.where("user_id % 4 > 0").select(F.col("user_id").alias("frame_id"), (F.col("user_id") % 4).cast("int").alias("children")).distinct()
    return R.remaining_warnings(warnings, captured)


@query("""SELECT user_id AS page_id, max_by('https://h/' || event_type || event_id, event_id) AS final_url, count(*) - 1 AS redirects, CASE WHEN count(*) - 1 > 60 THEN 'navigation.redirect_limit' END AS error FROM events GROUP BY 1""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("sequence"), F.concat(F.lit("https://h/"), "event_type", F.col("event_id").cast("string")).alias("url"))
    return R.navigations(rows, 60)


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'unchecked' WHEN p_size % 4 = 0 THEN 'unchecked' WHEN p_size % 3 = 0 THEN 'conflict' WHEN p_size % 2 = 0 THEN 'mismatch' ELSE 'fine' END AS verdict FROM part""")
def content_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    lengths = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 3 == 0, F.array(F.lit("7"), F.lit("8"))).when(n % 2 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit(" 7"), F.lit("7 ")))
    return table(spark, sf_dir, "part").select("p_partkey", R.length_verdict(F.when(n % 5 == 0, "gzip"), lengths, F.lit(7)).alias("verdict"))


@query("""SELECT p_partkey AS page_id, 'assets/b.png' AS path, 'missing' AS problem FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'assets/c.png', 'unused' FROM part WHERE p_size % 3 = 0""")
def asset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    md = p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("![a](assets/a.png) text ![x"), "p_name", F.lit("](assets/a.png)"), F.when(F.col("p_size") % 2 == 0, " ![](assets/b.png)").otherwise("")).alias("markdown"))
    paths = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("assets/a.png"), F.lit("assets/c.png"))).otherwise(F.array(F.lit("assets/a.png")))
    return R.asset_coverage(md, p.select(F.col("p_partkey").alias("page_id"), F.explode(paths).alias("path")))


@query("""SELECT p_partkey AS page_id, 3 AS elements, 3 AS attributes, 32 + strlen(p_type) AS markup_bytes, strlen(p_name) + 2 AS text_bytes FROM part""")
def markup_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of small pages made from parts: ``<p id=...>``, a line break, an image, text between."""
    html = F.concat(F.lit("<p id="), "p_type", F.lit(">"), "p_name", F.lit("é<br><img src='x' alt>"), F.lit("</p>"))
    return R.markup_sizes(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("""SELECT l_orderkey AS export_id, idx, run <= 60 AND n <= 3 AS fits FROM (SELECT l_orderkey, idx, sum(bytes) OVER w AS run, count(*) OVER w AS n FROM (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS idx, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY idx ROWS UNBOUNDED PRECEDING))""")
def export_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("export_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("idx")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("bytes"))
    return R.export_budget(rows.withColumn("files", F.lit(1)), 60, 3).select("export_id", "idx", "fits")


@query("""SELECT p_partkey AS error_id, CASE WHEN p_size % 4 = 0 THEN 'pa.internal.code' ELSE 'pa.k' || chr(97 + p_size % 3) || '.x' END AS code, CASE WHEN p_size % 5 = 0 THEN 'commit' WHEN p_size % 4 > 0 AND p_size % 3 = 0 THEN 'resource' WHEN p_size % 4 > 0 AND p_size % 3 = 1 THEN 'browser' ELSE 'internal' END AS stage, p_size % 4 > 0 AND p_size % 3 = 1 AS retryable FROM part""")
def error_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    code = F.when(n % 4 == 0, "Not a code").otherwise(F.concat(F.lit("pa.k"), F.char(n % 3 + 97), F.lit(".x")))
    errors = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("error_id"), code.alias("code"), F.when(n % 5 == 0, "commit").alias("stage"), F.lit(None).cast("boolean").alias("retryable"))
    registry = spark.createDataFrame([("pa.ka.x", "resource", False), ("pa.kb.x", "browser", True)], "code string, stage string, retryable boolean")
    return R.defaulted_errors(errors, registry)


@query("""SELECT user_id AS capture_id, least(count(*), 64) AS kept, greatest(count(*) - 64, 0) AS dropped FROM events GROUP BY 1""")
def diagnostic_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.newest(table(spark, sf_dir, "events").select(F.col("user_id").alias("capture_id")), 64)


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '<img src="a.png" srcset="b.png 2x">' WHEN 1 THEN '<img alt="x" src="s' || p_size || '.png">' ELSE '<img src="s' || p_size || '.png" alt=y>' END AS token FROM part""")
def responsive_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    token = F.when(n % 3 == 0, '<img src="a.png" srcset="b.png 2x">').when(n % 3 == 1, '<img alt="x" src="a.png" srcset="b.png 2x" sizes=100vw>').otherwise("<img srcset='b.png 2x' alt=y>")
    return table(spark, sf_dir, "part").select("p_partkey", R.responsive(token, F.when(n % 3 > 0, F.concat(F.lit("s"), n.cast("string"), F.lit(".png#f")))).alias("token"))
