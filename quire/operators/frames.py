"""Frames, assets and reports around a capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import urls
from quire.operators.pages import TOKEN, attributes, tag_of


def processing_order(frames: DataFrame) -> DataFrame:
    """``page_id, frame_id, depth, turn`` for ``frames(page_id, frame_id, parent_id, path)``: deepest frames first, then by id.

    A frame's depth is its parent's plus the length of its owner path. Levels
    are found by a recursive query, one round for each level.
    """
    depths = frames.sparkSession.sql("""
        WITH RECURSIVE d(page_id, frame_id, depth) AS (
          SELECT page_id, frame_id, 0 FROM {frames} WHERE parent_id IS NULL
          UNION ALL SELECT f.page_id, f.frame_id, d.depth + size(f.path) FROM d JOIN {frames} f ON f.page_id = d.page_id AND f.parent_id = d.frame_id)
        SELECT * FROM d""", frames=frames)
    turn = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("depth").desc(), "frame_id"))
    return depths.withColumn("turn", turn)


def retained(frames: DataFrame, owners: DataFrame) -> DataFrame:
    """Frames whose parent is retained and still has their owner: ``page_id, frame_id, path`` with the owner's new path.

    ``owners(page_id, frame_id, original, path)`` maps a frame's owner paths to
    what is left of them; an empty new path drops the frame below it.
    """
    return frames.sparkSession.sql("""
        WITH RECURSIVE k(page_id, frame_id, path) AS (
          SELECT page_id, frame_id, path FROM {frames} WHERE parent_id IS NULL
          UNION ALL SELECT f.page_id, f.frame_id, o.path FROM k
            JOIN {frames} f ON f.page_id = k.page_id AND f.parent_id = k.frame_id
            JOIN {owners} o ON o.page_id = f.page_id AND o.frame_id = f.parent_id AND o.original = f.path
            WHERE size(o.path) > 0)
        SELECT * FROM k""", frames=frames, owners=owners)


def remaining_warnings(warnings: DataFrame, captured: DataFrame) -> DataFrame:
    """Warnings without each frame's first cross-origin ones, as many as it has captured children.

    ``warnings(frame_id, idx, code)``, ``captured(frame_id, children)``.
    """
    rank = F.row_number().over(Window.partitionBy("frame_id", "code").orderBy("idx"))
    rows = warnings.withColumn("rank", rank).join(captured, "frame_id", "left").fillna(0, ["children"])
    return rows.where((F.col("code") != "cross-origin") | (F.col("rank") > F.col("children"))).select("frame_id", "idx", "code")


def navigations(requests: DataFrame, most: int = 20) -> DataFrame:
    """``page_id, final_url, redirects, error`` from the main document's requests ``(page_id, sequence, url)``."""
    chain = requests.groupBy("page_id").agg(F.max_by("url", "sequence").alias("final_url"), (F.count("*") - 1).alias("redirects"))
    return chain.withColumn("error", F.when(F.col("redirects") > most, "navigation.redirect_limit"))


def length_verdict(encoding: Column, lengths: Column, received: Column) -> Column:
    """Whether a body has the length that its headers claim: skipped if it was encoded, wrong if the claims differ."""
    claims = F.array_distinct(F.transform(lengths, lambda x: F.trim(x)))
    return (
        F.when((F.coalesce(encoding, F.lit("identity")) != "identity") | (F.size(claims) == 0), "unchecked")
        .when(F.size(claims) > 1, "conflict")
        .when(~F.get(claims, F.lit(0)).rlike("^[0-9]+$") | (F.get(claims, F.lit(0)).try_cast("bigint") != received), "mismatch")
        .otherwise("fine")
    )


def asset_coverage(markdown: DataFrame, assets: DataFrame) -> DataFrame:
    """``page_id, path, problem``: images without an asset, and assets that no image shows."""
    found = markdown.select("page_id", F.explode(F.regexp_extract_all("markdown", F.lit(r"!\[[^\]]*\]\(([^)]*)\)"))).alias("path")).distinct()
    missing = found.join(assets, ["page_id", "path"], "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(assets.select("page_id", "path").distinct().join(found, ["page_id", "path"], "left_anti").withColumn("problem", F.lit("unused")))


def markup_sizes(pages: DataFrame) -> DataFrame:
    """``page_id, elements, attributes, markup_bytes, text_bytes``: what a budget is charged before anything is parsed further."""
    rows = pages.select("page_id", F.octet_length("html").alias("whole"), F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TOKEN), 0).alias("tokens"))
    opens = F.filter("tokens", lambda t: ~t.startswith("</") & (tag_of(t) != ""))
    total = lambda array, f: F.aggregate(array, F.lit(0), lambda a, t: a + f(t))
    sized = rows.select("page_id", F.size(opens).alias("elements"), total(opens, lambda t: F.size(attributes(t))).alias("attributes"), total(F.col("tokens"), F.octet_length).cast("bigint").alias("markup_bytes"), "whole")
    return sized.select("page_id", "elements", "attributes", "markup_bytes", (F.col("whole") - F.col("markup_bytes")).cast("bigint").alias("text_bytes"))


def export_budget(outputs: DataFrame, most_bytes: int, most_files: int) -> DataFrame:
    """Outputs in order with ``fits``: whether bytes and files so far stay within a shared budget, by ``export_id``."""
    w = Window.partitionBy("export_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return outputs.withColumn("fits", (F.sum("bytes").over(w) <= most_bytes) & (F.sum("files").over(w) <= most_files))


def defaulted_errors(errors: DataFrame, registry: DataFrame) -> DataFrame:
    """Errors with the registry's stage and retryability where they give none; a code that isn't one is ``pa.internal.code``."""
    fine = F.col("code").rlike(r"^[a-z]+(\.[a-z_]+){2,}$")
    known = registry.select(F.col("code").alias("r_code"), F.col("stage").alias("r_stage"), F.col("retryable").alias("r_retryable"))
    rows = errors.withColumn("code", F.when(fine, F.col("code")).otherwise("pa.internal.code")).join(known, F.col("code") == F.col("r_code"), "left")
    return rows.select("error_id", "code", F.coalesce("stage", "r_stage", F.lit("internal")).alias("stage"), F.coalesce("retryable", "r_retryable", F.lit(False)).alias("retryable"))


def newest(events: DataFrame, most: int) -> DataFrame:
    """``capture_id, kept, dropped``: how many of a capture's events a ring of the newest holds."""
    n = events.groupBy("capture_id").agg(F.count("*").alias("n"))
    return n.select("capture_id", F.least("n", F.lit(most)).alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).alias("dropped"))


def responsive(html: Column, chosen: Column) -> Column:
    """An image token with the source that was shown, without its alternatives; a null choice leaves it as it is."""
    plain = F.regexp_replace(html, r"""(?i)\s(srcset|sizes)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", "")
    shown = F.when(plain.rlike(r"(?i)\ssrc\s*="), F.regexp_replace(plain, r"""(?i)(\ssrc\s*=\s*)("[^"]*"|'[^']*'|[^\s>"']+)""", "$1\"@\"")).otherwise(F.regexp_replace(plain, r"(?i)^<img", "<img src=\"@\""))
    return F.when(chosen.isNull(), html).otherwise(F.replace(shown, F.lit("@"), urls.without_fragment(chosen)))
