"""What the training-data operators share: inputs, scratch tables, bounded hot keys."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that become Python objects at a time. Spark itself bounds a batch's bytes.
ARROW_ROWS = 512
#: Rows of one key that a plain join may send to one task, whatever share of the table they are.
HOT_KEY_ROWS = 10_000_000
#: Spark's setting by which the shuffle files of a plan are removed as it ends, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Options of scratch tables. On a local disk they have no checksum files, each of which costs a process (``chmod``)
#: that shares the executor's memory until it calls exec. Stores of other schemes take no notice.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(batches, rows: int = ARROW_ROWS):
    """The same rows in smaller Arrow batches (no copies): whole texts are long rows to hold as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, text`` and ``more``, a null text being the empty one. Other columns are pruned here."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def versions(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``rows`` with a column ``version`` that tells texts of one ``doc_id`` apart.

    It is 0 unless a ``doc_id`` comes with several texts, then a hash of the text: what refers to places in
    a text names both. One look at the ids finds out; where they are unique that is all.
    """
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    several = rows.groupBy(doc_id).agg(F.min(h).alias("a"), F.max(h).alias("b")).filter("a <> b")
    if not several.take(1):
        return rows.withColumn("version", F.lit(0).cast("long"))
    flagged = rows.join(several.select(doc_id, F.lit(True).alias("several")), doc_id, "left")
    return flagged.withColumn("version", F.when(F.col("several"), h).otherwise(0)).drop("several")


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns named ``c0, c1 ...``, so that names of our own clash with none; and those names.

    ``doc_id`` (cast to long) is added as ``__doc``.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    inner = docs.toDF(*names)
    return inner.withColumn("__doc", F.col(names[docs.columns.index("doc_id")]).cast("long")), names


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a folder of its own. On a cluster other machines could not
    see such a folder, so there the setting is asked for.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    found = found or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written in the shared folder. They outlive lost executors and cut lineage.

    Results are lazy and read from here, so tables that one refers to stay until :meth:`drop` is called or
    the driver ends; operators drop the others themselves.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self.drop()

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def cut(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` and read it back. Its shuffle files, which nothing reads again, go when it is written."""
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.options(**PLAIN_FILES).mode("overwrite").partitionBy(*partition_by).parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.read(df.schema, name)

    def read(self, schema, name: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them once results have been written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(
    rows: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "inner", hot_rows: int = 2000
) -> DataFrame:
    """Join ``rows`` with one-row-per-key ``keyed`` although a few keys hold most of the rows.

    ``keyed`` has the number of ``rows`` each key holds in column ``count``. Keys with more than
    1/``hot_rows`` of all rows, or with more than HOT_KEY_ROWS, are broadcast: fewer than ``hot_rows`` plus one
    for every HOT_KEY_ROWS rows of the table. The others are joined by a shuffle in which no key is large.
    """
    total = keyed.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    least = min(max(total // hot_rows, 1), HOT_KEY_ROWS)
    hot = keyed.filter(F.col(count) > least)
    cold = keyed.filter(F.col(count) <= least)
    if not hot.take(1):
        return rows.join(cold, on, how)
    is_hot = hot.select(*on, F.lit(True).alias("__is_hot"))
    flagged = rows.join(F.broadcast(is_hot), on, "left")
    first = flagged.filter(F.col("__is_hot")).drop("__is_hot").join(F.broadcast(hot), on, how)
    rest = flagged.filter(F.col("__is_hot").isNull()).drop("__is_hot").join(cold, on, how)
    return first.unionByName(rest)
