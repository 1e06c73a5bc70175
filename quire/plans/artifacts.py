"""Queries over artifacts: encoding, verification, containers, validation, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import artifacts as A
from quire.operators import pages as P
from quire.plans.registry import query, table


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.col("page_id").alias("page"), F.sha2("url", 256).alias("urlSha256")))
    clean = pages.select("page_id", "url", P.sanitized(F.col("html")).alias("html"), manifest.alias("manifest"))
    return clean.select("page_id", "url", "manifest", A.encoded(F.col("html"), F.col("manifest")).alias("html"))


@query("""SELECT page_id, CAST(NULL AS VARCHAR) AS error, '{"schemaVersion":2,"page":' || page_id || ',"urlSha256":"' || sha256(url) || '"}' AS manifest FROM pages""")
def artifact_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages sanitized, encoded and verified: all are sound, and their manifests can be read back."""
    return A.verified(_encoded(spark, sf_dir)).select("page_id", "error", A.manifest_of(F.col("html")).alias("manifest"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'verify.manifest' WHEN 2 THEN 'verify.policy_text' WHEN 3 THEN 'verify.active_content' WHEN 4 THEN 'verify.remote_reference' ELSE 'verify.state_program' END AS error FROM pages""")
def artifact_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts spoiled in one way each: the first check that fails names it."""
    k, html = F.col("page_id") % 6, F.col("html")
    spoiled = (
        F.when(k == 1, F.replace(html, F.lit(A.MANIFEST_ID), F.lit("other")))
        .when(k == 2, F.replace(html, F.lit("base-uri 'none'"), F.lit("base-uri *")))
        .when(k == 3, F.replace(html, F.lit("<article>"), F.lit('<article onclick="x()">')))
        .when(k == 4, F.replace(html, F.lit("<article>"), F.lit('<article><img src="https://h/x.png">')))
        .when(k == 5, F.replace(html, F.lit("e.scrollTo("), F.lit("e.scrollBy(")))
        .otherwise(html)
    )
    return A.verified(_encoded(spark, sf_dir).withColumn("html", spoiled)).select("page_id", "error")


@query("SELECT page_id, sha256(html) AS digest FROM pages")
def mhtml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html", A.mhtml(F.col("html"), F.col("url")).alias("m"))
    return pages.select("page_id", F.sha2(A.mhtml_body(F.col("m")), 256).alias("digest"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN sha256(html) END AS digest, CASE WHEN page_id % 3 = 0 THEN 'zip.container' END AS error FROM pages")
def zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ZIP containers, every third one cut short."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.to_json(F.struct("page_id")).alias("manifest"))
    boxed = pages.withColumn("z", A.zipped(F.col("html"), F.col("manifest"))).withColumn("z", F.when(F.col("page_id") % 3 == 0, F.substring("z", 1, 30)).otherwise(F.col("z")))
    got = boxed.withColumn("u", A.unzipped(F.col("z")))
    return got.select("page_id", F.sha2("u.html", 256).alias("digest"), F.col("u.error").alias("error"))


@query("SELECT page_id, sha256(html) AS digest FROM pages")
def self_extracting_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "pages").select("page_id", A.self_extracting(F.col("html")).alias("x"))
    return packed.select("page_id", F.regexp_extract("x", 'data-pa-sha256="([0-9a-f]{64})"', 1).alias("digest"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'script-src ''none''' ELSE 'script-src ''sha256-' || base64(unhex(sha256(p_name))) || '''' END AS scripts, 11 AS directives FROM part""")
def content_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(A.content_policy(F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name"))), "; ")
    return table(spark, sf_dir, "part").select("p_partkey", parts.alias("p")).select("p_partkey", F.get("p", F.lit(9)).alias("scripts"), F.size("p").alias("directives"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'input.url_scheme' WHEN p_size % 5 = 0 THEN 'input.selector' WHEN p_size % 3 = 0 THEN 'input.selector_scope' WHEN p_size % 11 = 0 THEN 'input.remote_file' WHEN p_size % 2 = 0 THEN 'input.viewport' END AS error FROM part""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    url = F.when(n % 7 == 0, "ftp://x").when(n % 11 == 0, "file:///x").otherwise("https://x/")
    error = A.request_error(url, F.when(n % 5 == 0, "selector").otherwise("page"), F.when(n % 5 == 0, " ").when(n % 3 == 0, "#a"), F.when(n % 2 == 0, 0).otherwise(800), F.lit(600), n % 11 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", error.alias("error"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'export.version' WHEN p_size % 4 = 0 THEN 'export.no_format' WHEN p_size % 3 = 0 THEN 'export.duplicate_format' WHEN p_size % 7 = 0 THEN 'export.base_name' END AS error, CASE p_size % 5 WHEN 0 THEN p_name || '.pdf' WHEN 1 THEN p_name || '-markdown/' WHEN 2 THEN p_name || '.zip' WHEN 3 THEN p_name || '.compressed.html' ELSE p_name || '.mhtml' END AS name FROM part""")
def export_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    formats = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 3 == 0, F.array(F.lit("zip"), F.lit("zip"))).otherwise(F.array(F.lit("zip"), F.lit("pdf")))
    kind = F.element_at(F.array(*map(F.lit, A.FORMATS)), n % 5 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", A.export_error(formats, F.when(n % 7 == 0, "  ").otherwise(F.col("p_name")), F.when(n % 5 == 0, 9).otherwise(1)).alias("error"), A.export_name(F.col("p_name"), kind).alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 130 WHEN p_size % 6 = 1 THEN 1 WHEN p_size % 6 = 2 AND p_partkey % 2 = 0 THEN 3 WHEN p_size % 6 = 3 THEN 2 ELSE 1 END AS code, CASE WHEN p_size % 4 = 0 THEN 'verify.network' WHEN p_size % 4 = 1 THEN 'verify.page_error' WHEN p_size % 4 = 2 THEN 'verify.unstable' ELSE 'sound' END AS verdict FROM part""")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    code = F.when(n % 6 == 0, "pa.runtime.interrupted").when(n % 6 == 1, "pa.artifact.size").otherwise("pa.x.y")
    stage = F.when(n % 6 == 2, "verification").when(n % 6 == 3, "validation").when(n % 6 == 1, "validation").otherwise("encoding")
    one, none = F.array(F.lit("x")), F.array().cast("array<string>")
    verdict = A.observation_verdict(F.when(n % 4 == 0, one).otherwise(none), F.when(n % 4 < 2, one).otherwise(none), n % 4 == 3)
    return table(spark, sf_dir, "part").select("p_partkey", A.exit_code(code, stage, F.col("p_partkey") % 2 == 0).alias("code"), verdict.alias("verdict"))


@query("""SELECT event_type, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most, round(1000000 / (quantile_cont(value, 0.5) / 1000), 3) AS throughput FROM events GROUP BY 1""")
def bench_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.bench_statistics(table(spark, sf_dir, "events").withColumn("bytes", F.lit(1_000_000)), "event_type", "value", "bytes")
    return got.select("event_type", "least", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "most", F.round("throughput", 3).alias("throughput"))


@query("""SELECT source AS "group", count(*) AS attempted, count(*) FILTER (doc_id % 5 <> 0) AS succeeded, count(*) FILTER (doc_id % 5 = 0) AS failed, grouping(source) AS total FROM documents GROUP BY ROLLUP (source)""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over a corpus attempted, and how much of it succeeded and failed, by group and in total."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("group"), F.when(F.col("doc_id") % 5 == 0, "failure").otherwise("success").alias("outcome"))
    return A.corpus_report(rows, "group")
