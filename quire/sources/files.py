"""Files as tables: bounded reads, strict JSON, bundles, settings; and a table of outputs that takes all of them or none."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import relative_path_valid
from quire.operators.scheduling import unique_names

MOST_FILE_BYTES, MOST_CONFIG_BYTES, MOST_BUNDLE_FILES = 64 << 20, 1 << 20, 10_001


def bounded(spark: SparkSession, path: str, most: int = MOST_FILE_BYTES, pattern: str = "*") -> DataFrame:
    """``path, bytes, body`` of files up to ``most`` bytes; larger ones aren't read, as the bound reaches the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.col("content").alias("body"))


def under(files: DataFrame, roots: list[str]) -> DataFrame:
    """Files below one of the allowed roots, by their path without ``.`` and ``..``."""
    plain = F.regexp_replace("path", r"^file:/+", "/")
    allowed = F.lit(False)
    for root in roots:
        allowed |= plain.startswith(os.path.realpath(root).rstrip("/") + "/")
    return files.where(allowed & ~plain.rlike(r"/\.\.?(/|$)"))


def strict_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON records with ``error``: null, ``input.json`` for what can't be read, ``input.unknown_field`` for fields that the schema lacks."""
    raw = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "raw")
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    rows = raw.select("raw", F.from_json("raw", schema).alias("record"), F.json_object_keys("raw").alias("keys"))
    error = F.when(F.col("keys").isNull() | F.col("record").isNull(), "input.json").when(F.size(F.array_except("keys", names)) > 0, "input.unknown_field")
    return rows.select("record", error.alias("error"))


def bundles(spark: SparkSession, path: str, most: int = MOST_FILE_BYTES) -> DataFrame:
    """Markdown bundles below a folder: ``bundle, files, bytes, error``; ``index.md`` and direct entries of ``assets``."""
    files = bounded(spark, path, most)
    parts = F.regexp_extract("path", r"^(.*)/(index\.md|assets/[^/]+)$", 1)
    rows = files.select(parts.alias("bundle"), F.regexp_extract("path", r"(index\.md|assets/[^/]+)$", 1).alias("name"), "bytes").where(F.col("bundle") != "")
    rows = rows.groupBy("bundle").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("name") == "index.md").alias("index"))
    return rows.select("bundle", "files", "bytes", F.when(F.col("index") != 1, "bundle.index").when(F.col("files") > MOST_BUNDLE_FILES, "bundle.files").alias("error"))


def settings(user: str | None = None, explicit: str | None = None, environment: dict[str, str] | None = None, prefix: str = "PAGE_ARCHIVE_", names: tuple[str, ...] = ("timeout", "viewport", "concurrency", "missing")) -> list[tuple[str, str, str]]:
    """Settings as rows ``source, name, value`` from a user's file, an explicit file and the environment; an unknown name is an error."""
    rows = []
    for source, path in (("user", user), ("explicit", explicit)):
        if path and os.path.isfile(path):
            if os.path.getsize(path) > MOST_CONFIG_BYTES:
                raise ValueError(f"{path}: settings of {MOST_CONFIG_BYTES} bytes at most")
            with open(path, "rb") as f:
                rows += [(source, k, str(v)) for k, v in tomllib.load(f).items()]
    rows += [("env", k.removeprefix(prefix).lower(), v) for k, v in (environment or {}).items() if k.startswith(prefix)]
    if unknown := sorted({name for _, name, _ in rows} - set(names)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return rows


def save_artifacts(artifacts: DataFrame, folder: str, conflict: str = "fail") -> None:
    """Add ``artifacts(name, body)`` to the Parquet table in ``folder``: all of them, or none.

    ``conflict`` says what happens to a name that is there already: ``fail``
    refuses the whole output, ``replace`` makes the new body the one that is
    read, ``uniquify`` names it ``stem-N.ext``. Names that aren't portable, and
    under the first two a name that comes twice, are refused. Every save is one
    batch that Spark's committer publishes at once; names stay in the cluster.
    """
    if conflict not in ("fail", "replace", "uniquify"):
        raise ValueError(f"conflict: {conflict}")
    spark = artifacts.sparkSession
    wrong = artifacts.where(~relative_path_valid(F.col("name"))).limit(1)
    if not wrong.isEmpty():
        raise ValueError(f"not a portable relative file: {wrong.first()['name']}")
    rows = artifacts.select("name", F.col("body").cast("binary").alias("body"))
    have = saved_artifacts(spark, folder)
    if conflict == "uniquify":
        own = rows.withColumn("id", F.struct("name", F.sha2("body", 256)))
        named = unique_names(own.select("id", F.col("name").alias("path")).distinct(), have.select(F.col("name").alias("path")))
        rows = own.dropDuplicates(["id"]).join(named, "id").select(F.col("path").alias("name"), "body")
    else:
        twice = rows.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("name")
        taken = twice if conflict == "replace" else twice.unionByName(rows.join(have.select("name"), "name", "left_semi").select("name"))
        if in_the_way := [r["name"] for r in taken.limit(3).collect()]:
            raise ValueError(f"outputs are in the way: {sorted(in_the_way)}")
    batch = (have.agg(F.max("batch")).first()[0] or 0) + 1
    rows.withColumns({"digest": F.sha2("body", 256), "batch": F.lit(batch).cast("long")}).write.mode("append").parquet(folder)


def saved_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """``name, body, digest, batch``: of each name what the newest batch has; an empty table where nothing was saved."""
    schema = "name string, body binary, digest string, batch long"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(folder)
    last = rows.groupBy("name").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["name", "batch"]).select("name", "body", "digest", "batch")
