"""Written intermediate tables: the one way this library cuts lineage.

Everything goes below the shared folder named by ``spark.checkpoint.dir``. Only
where a local session has no such setting (unit tests, a laptop) a folder of our
own is made and set; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; set to a fresh local one only if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="memloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """A private subfolder of the shared folder that holds one run's tables."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/memloom/{label}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back, so later stages and retries start from files."""
        target = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again: what was made of them is written."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def clear(self) -> None:
        """Delete all tables of this run; for callers whose results are written elsewhere."""
        self._delete(self.path)

    def _delete(self, target: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
