"""Resources: outcomes of references, content identity, summaries, reuse of observed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import media, urls


def outcomes(references: DataFrame, resources: DataFrame, largest: int = 64 << 20) -> DataFrame:
    """Each reference with its outcome: ``kind, digest, media_type, bytes, data_url, error``.

    ``resources(page_id, url, status, media_type, body)``. ``data:`` URLs are
    read in place; other references match a resource by URL without fragment. A
    status outside 200 to 399, an unknown scheme, a body over ``largest`` or no
    resource at all is a failure, for which an empty stand-in by role is given.
    """
    own = references.withColumn("key", urls.without_fragment(F.col("resolved")))
    # merged: resources made by an explode look as small to Spark as what they were made of, and would pass through the driver
    table = resources.select(F.col("page_id").alias("r_page"), urls.without_fragment(F.col("url")).alias("r_url"), "status", F.col("media_type").alias("r_type"), "body").hint("merge")
    rows = own.join(table, (F.col("page_id") == F.col("r_page")) & (F.col("key") == F.col("r_url")) & (urls.scheme(F.col("resolved")) != "data"), "left")
    inline = media.decoded(F.col("resolved"))
    scheme = urls.scheme(F.col("resolved"))
    error = (
        F.when(scheme == "data", inline["error"])
        .when(~F.coalesce(scheme.isin("http", "https", "file", "blob"), F.lit(False)), "resource.scheme")
        .when(F.col("r_url").isNull(), "resource.missing")
        .when(~F.col("status").between(200, 399), "resource.status")
        .when(F.octet_length("body") > largest, "resource.limit")
    )
    body = F.when(scheme == "data", inline["body"]).otherwise(F.col("body"))
    kind = F.when(scheme == "data", media.essence(inline["media_type"])).otherwise(media.effective(F.col("r_type"), F.col("role"), F.col("resolved")))
    fragment = F.when(F.col("resolved").contains("#"), F.concat(F.lit("#"), F.substring_index("resolved", "#", -1))).otherwise(F.lit(""))
    rows = rows.withColumns({"error": error, "content": body, "type": kind})
    good = F.col("error").isNull()
    return rows.select(
        *references.columns, F.when(good, "embedded").otherwise("failed").alias("kind"), F.when(good, F.sha2("content", 256)).alias("digest"), F.when(good, F.col("type")).alias("media_type"),
        F.when(good, F.octet_length("content")).cast("bigint").alias("bytes"), F.when(good, F.concat(media.data_url(F.col("type"), F.col("content")), fragment)).otherwise(media.empty_fallback(F.col("role"))).alias("data_url"), "error",
        F.when(F.col("error") == "resource.status", F.col("status") >= 500).otherwise(F.lit(False)).alias("retryable"),
    )


def summary(records: DataFrame) -> DataFrame:
    """One row per page: how many references ended how, and the bytes of its distinct embedded contents."""
    each = records.groupBy("page_id", "kind", "digest").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("bigint").alias(kind)
    return each.groupBy("page_id").agg(F.sum("n").cast("bigint").alias("discovered"), *map(count, ("embedded", "external", "omitted", "failed")), F.coalesce(F.sum(F.when(F.col("kind") == "embedded", F.col("bytes"))), F.lit(0)).cast("bigint").alias("embedded_bytes"))


def length_conflicts(records: DataFrame) -> DataFrame:
    """Digests that claim more than one length."""
    return records.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where(F.col("least") != F.col("most"))


def stored(bodies: DataFrame, key: str = "source") -> DataFrame:
    """A content store's counters: bytes received, and bytes kept once equal contents are one, by ``key``."""
    each = bodies.groupBy(key, F.sha2("body", 256).alias("digest")).agg(F.count("*").alias("n"), F.max(F.octet_length("body")).cast("bigint").alias("bytes"))
    return each.groupBy(key).agg(F.sum("n").cast("bigint").alias("received"), F.count("*").alias("unique"), F.sum(F.col("n") * F.col("bytes")).cast("bigint").alias("received_bytes"), F.sum("bytes").cast("bigint").alias("unique_bytes"))


def multiset_difference(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, expected, observed, missing, surplus`` for keys whose counts differ."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(expected, "expected").join(count(observed, "observed"), keys, "full_outer").fillna(0, ["expected", "observed"])
    return both.where(F.col("expected") != F.col("observed")).withColumns({"missing": F.greatest(F.col("expected") - F.col("observed"), F.lit(0)), "surplus": F.greatest(F.col("observed") - F.col("expected"), F.lit(0))})


def variant_key(method: Column, has_body: Column, headers: Column) -> Column:
    """A request's identity: method, whether it has a body, and its headers in order of their lower-case names."""
    pairs = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"])))
    listed = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("\0"), e["value"], F.lit("\x01"))), "")
    return F.concat_ws(" ", method, has_body.cast("string"), F.sha2(listed, 256))


def reusable_responses(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Which observed response may serve a reference: ``keys, verdict, sequence``.

    Rows: ``keys, sequence, variant, reusable, state (complete, unavailable,
    too-large, streaming), finished, failed, content``. Pending beats ambiguous
    beats the newest complete one; one that finished with other content makes
    the choice ambiguous. All by partial aggregation: no window, no sort.
    """
    usable = F.col("finished") & ~F.col("failed")
    ready = usable & (F.col("state") == "complete")
    found = responses.groupBy(*keys).agg(
        F.bool_or((F.col("state") == "streaming") | ~F.col("finished")).alias("pending"),
        F.min("variant").alias("v0"), F.max("variant").alias("v1"), F.bool_and("reusable").alias("reusable"), F.bool_or(F.col("variant").isNull()).alias("unknown"),
        F.max(F.when(ready, F.col("sequence"))).alias("sequence"), F.count_if(ready).alias("ready"),
        F.min(F.when(usable, F.coalesce("content", F.lit("")))).alias("c0"), F.max(F.when(usable, F.coalesce("content", F.lit("")))).alias("c1"), F.bool_or(F.col("state") == "too-large").alias("large"),
    )
    verdict = (
        F.when(F.col("pending"), "pending")
        .when((F.col("v0") != F.col("v1")) | F.col("unknown") | ~F.col("reusable"), "ambiguous")
        .when(F.col("ready") == 0, F.when(F.col("large"), "too-large").otherwise("unavailable"))
        .when(F.col("c0") != F.col("c1"), "ambiguous")
        .otherwise("ready")
    )
    return found.select(*keys, verdict.alias("verdict"), F.when(verdict == "ready", F.col("sequence")).alias("sequence"))


def fetch_plan(references: DataFrame, failed: DataFrame) -> DataFrame:
    """What is left to load: each URL of a frame once, without those that failed there before."""
    return references.select("page_id", urls.without_fragment(F.col("resolved")).alias("url")).distinct().join(failed.select("page_id", "url").distinct(), ["page_id", "url"], "left_anti")


def budget(items: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """The first item of each key at which the running sum passes ``limit``: ``key, order, attempted``."""
    running = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    over = items.select(key, order, running.alias("attempted")).where(F.col("attempted") > limit)
    return over.groupBy(key).agg(F.min(F.struct(order, "attempted")).alias("first")).select(key, f"first.{order}", "first.attempted")


def completeness(references: DataFrame, records: DataFrame) -> DataFrame:
    """References without exactly one outcome: ``page_id, ref_id, outcomes``."""
    n = records.groupBy("page_id", "ref_id").agg(F.count("*").alias("outcomes"))
    return references.select("page_id", "ref_id").join(n, ["page_id", "ref_id"], "left").fillna(0, ["outcomes"]).where(F.col("outcomes") != 1)
