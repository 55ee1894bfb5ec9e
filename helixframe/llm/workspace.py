"""Tables that cut lineage, written to the folder that the cluster shares.

An operator of several rounds writes what it has so far as Parquet below
``spark.checkpoint.dir`` and reads it back.  A lost executor then costs the
running stage only, and no plan grows with the number of rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only in local mode where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen:
        return chosen.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="helixframe-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


class Workspace:
    """A folder of intermediate tables; ``finish`` keeps the last one and removes the others."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Write ``df``, then drop every earlier table of this workspace."""
        out, _ = self.write(df)
        for i in range(1, self._n):
            self.remove(f"{self.root}/{i:03d}")
        return out
