"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or under a local master a folder of our own where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Spark's setting by which the shuffle files of a plan are removed as it ends, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting by which tables that are both dealt out by document are joined by document and place as they lie.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


class Scratch:
    """Tables of one run. Plans that refer to one several times read it instead of making it again."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex[:12]}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back. Its shuffle files, which nothing reads again, go when it is written."""
        wanted = {SHUFFLE_CLEANUP: "true", ALL_KEYS: "false"}
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/{name}")
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
