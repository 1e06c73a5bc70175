"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one table of ``sf_dir`` through Spark, so any store that Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of its own (tests); a cluster is refused."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir: set it to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="quire-checkpoints-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._quire_folder = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``kept`` wrote and that nothing reads any more."""
    for df in tables:
        if folder := getattr(df, "_quire_folder", None):
            delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, whatever store that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_MEMORIES: dict[str, Callable[[], None]] = {}


def remembering(owner: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called in a Python worker by an operator's task: what other operators left in the worker's memory is forgotten.

    Workers serve one stage after the other, so without this their memories would add up.
    """
    for other in [x for x in _MEMORIES if x != owner]:
        _MEMORIES.pop(other)()
    _MEMORIES[owner] = forget


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column of that name is there; Spark doesn't tell upper from lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sample_share(key: Column, share: float) -> Column:
    """A deterministic sample: true for about ``share`` of the keys, whatever their order or partition."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)
