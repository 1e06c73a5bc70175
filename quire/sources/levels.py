"""Tables between the rounds of an iteration: written to the cluster's shared folder, read back, and deleted when the next one stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of its own; a cluster is refused."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir: set it to a folder that the driver and all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}"
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


class Levels:
    """The tables of one iteration."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}"
        self.number = 0

    def kept(self, df: DataFrame) -> DataFrame:
        """``df`` as a table: its lineage is cut, and it survives lost executors.

        Joins with it are merged. Spark would judge it by its compressed files,
        which rows that repeat each other make small however many there are,
        and would pass all of them through the driver.
        """
        self.number += 1
        path = f"{self.folder}/{self.number}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).hint("merge")

    def drop(self, number: int) -> None:
        """Delete the table that was written as the ``number``-th."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
