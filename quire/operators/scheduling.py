"""Batches and crawls: what is left to do, what was found, how outputs are named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.levels import shared_folder


def job_errors(jobs: DataFrame) -> DataFrame:
    """``job_id, error`` for jobs that can't be scheduled: ids blank, too long or given twice, no http URL, resumption without a file."""
    twice = jobs.groupBy("job_id").agg(F.count("*").alias("n"))
    rows = jobs.join(twice, "job_id")
    error = (
        F.when((F.trim("job_id") == "") | (F.length("job_id") > 256), "input.job_id")
        .when(F.col("n") > 1, "input.duplicate_job")
        .when(~F.lower("url").rlike("^https?://[^/]"), "input.url")
        .when(F.col("resume") & (F.col("output") != "file"), "input.resume_output")
    )
    return rows.select("job_id", error.alias("error")).where(F.col("error").isNotNull())


def resumed(jobs: DataFrame, records: DataFrame, files: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Each job with ``state``: ``resumed``, ``failed`` (kept as it was) or ``pending``.

    A record counts if id and request digest are the job's; a success also needs
    its file's digest unchanged.
    """
    known = records.select("job_id", F.col("request_digest").alias("r_digest"), "outcome", "artifact", F.col("artifact_digest").alias("r_artifact"))
    now = files.select(F.col("path").alias("artifact"), F.col("digest").alias("f_digest"))
    rows = jobs.join(known, "job_id", "left").join(now, "artifact", "left")
    same = F.coalesce(F.col("request_digest") == F.col("r_digest"), F.lit(False))
    fresh = F.coalesce(F.col("f_digest") == F.col("r_artifact"), F.lit(False))
    state = F.when(same & (F.col("outcome") == "success") & fresh, "resumed").when(same & (F.col("outcome") == "failure") & F.lit(not retry_failed), "failed").otherwise("pending")
    return rows.select(*[F.col(c) for c in jobs.columns], state.alias("state"))


def counts(outcomes: DataFrame, *keys: str) -> DataFrame:
    """``succeeded, failed, resumed``; a resumed success counts in both."""
    return outcomes.groupBy(*keys).agg(F.count_if(F.col("outcome") == "success").alias("succeeded"), F.count_if(F.col("outcome") == "failure").alias("failed"), F.count_if("was_resumed").alias("resumed"))


def frontier(items: DataFrame, width: int, left: int) -> DataFrame:
    """The items to take next: of the least depth only, in order of ordinal and URL, each URL once, no more than allowed."""
    once = items.groupBy("depth", "url").agg(F.min("ordinal").alias("ordinal"))
    first = once.agg(F.min("depth").alias("least"))
    return once.join(F.broadcast(first), F.col("depth") == F.col("least")).orderBy("ordinal", "url").limit(min(width, left)).select("url", "depth", "ordinal")


def crawl(edges: DataFrame, seed: str, depth: int = 3, pages: int = 100) -> DataFrame:
    """Breadth first over ``edges(source, target)``: ``url, depth, ordinal``.

    A level's new URLs are ordered by the ordinal of the page that has the link,
    then by URL, and cut where ``pages`` is reached; what a level finds is joined
    to the edges and checked against all seen, so levels never pass through the
    driver, which learns their sizes only.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    seen = spark.createDataFrame([(seed, 0, 0)], "url string, depth int, ordinal bigint")
    level, total = seen, 1
    for d in range(1, depth + 1):
        found = level.join(edges, F.col("url") == F.col("source")).groupBy("target").agg(F.min("ordinal").alias("parent"))
        found = found.join(seen.select("url"), F.col("target") == F.col("url"), "left_anti")
        # bounded by the pages left, so that one task may number them
        chosen = found.orderBy("parent", "target").limit(pages - total)
        order = Window.orderBy("parent", "target")
        level = chosen.select(F.col("target").alias("url"), F.lit(d).alias("depth"), (F.row_number().over(order) + F.lit(total - 1)).cast("bigint").alias("ordinal")).checkpoint()
        n = level.count()
        total += n
        seen = seen.unionByName(level)
        if not n or total >= pages:
            break
    return seen


def unique_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``id, path``: of equal paths, and of paths that exist, later ones get ``stem-N.ext`` with the next N that is free.

    A path that is itself of the form ``stem-N.ext`` keeps it; names made for
    others avoid all that are wanted or taken.
    """
    rank = F.row_number().over(Window.partitionBy("path").orderBy("id"))
    rows = wanted.select("id", "path", rank.alias("rank"))
    used = taken.select("path").unionByName(wanted.select("path")).distinct()
    numbered = r"^(.*)-([1-9][0-9]{0,8})((?:\.[^./]*)?)$"
    numbers = used.where(F.col("path").rlike(numbered)).select(F.concat(F.regexp_extract("path", numbered, 1), F.regexp_extract("path", numbered, 3)).alias("path"), F.regexp_extract("path", numbered, 2).cast("int").alias("n"))
    numbers = numbers.groupBy("path").agg(F.array_sort(F.collect_set("n")).alias("numbers"))
    rows = rows.join(taken.select("path", F.lit(1).alias("have")).distinct(), "path", "left").join(numbers, "path", "left")
    n = F.col("rank") - 1 + F.coalesce("have", F.lit(0))
    free = F.aggregate(F.coalesce("numbers", F.array().cast("array<int>")), n, lambda at, used_: F.when(used_ <= at, at + 1).otherwise(at))
    return rows.select("id", F.when(n == 0, F.col("path")).otherwise(F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("-"), free.cast("string"), F.regexp_extract("path", r"(\.[^./]*)$", 1))).alias("path"))


def directory_digest(files: DataFrame, key: str) -> DataFrame:
    """``key, files, digest``: SHA-256 over each file's path, length and content digest, sorted by depth, then path."""
    item = F.struct((F.size(F.split("path", "/")) - 1).alias("depth"), "path", F.octet_length("body").alias("bytes"), F.sha2("body", 256).alias("digest"))
    listed = files.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    line = lambda x: F.concat_ws(":", x["path"], x["bytes"].cast("string"), x["digest"])
    return listed.select(key, F.size("items").alias("files"), F.sha2(F.array_join(F.transform("items", line), "\n"), 256).alias("digest"))
