"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import PLAIN_FILES, Scratch, join_hot, numbered, versions

#: Fixed value: the white space that is stripped from a line, U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
ADDED = ("n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    """The line stripped at both ends with A-Z lower-cased. Where all is ASCII ``lower`` is just that, and faster."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashes(key: Column) -> list[Column]:
    """128 bits in two longs: equal keys only, for any number of lines that fits on disks."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """Sorted runs of all line hashes seen so far, each a table bucketed and sorted by hash.

    A new batch's distinct hashes are merged against every run: what no run has becomes a run of its own at
    level 0. ``fanout`` runs of a level are compacted into one of the next level, so n batches leave about
    log(n) runs and a hash is rewritten log(n) times. Runs and batches share one bucketing, so merging
    shuffles the batch alone. The tables are in the session's current database until :meth:`close`.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 2) -> None:
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.written = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def seen(self, keys: DataFrame) -> DataFrame:
        """``keys`` with a column ``seen``: whether a run has the key. Runs have no key in common."""
        out = keys.withColumn("seen", F.lit(False))
        for run in self.runs():
            hit = run.select(*KEY, F.lit(True).alias("hit"))
            out = out.join(hit, KEY, "left").withColumn("seen", F.col("seen") | F.col("hit").isNotNull()).drop("hit")
        return out

    def add(self, keys: DataFrame) -> None:
        """Keep keys that no run has as a new run, then compact."""
        self._put(keys, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self.spark.table(old[0])
            for name in old[1:]:
                merged = merged.union(self.spark.table(name))
            self.levels[level] = []
            self._put(merged, level + 1)
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")
                self.scratch.drop(name)
            level += 1

    def _put(self, keys: DataFrame, level: int) -> None:
        name = f"run_{self.scratch.base.rpartition('-')[2]}_{self.written}"
        self.written += 1
        dealt = keys.select(*KEY).repartition(self.buckets, *KEY)
        out = dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).options(**PLAIN_FILES)
        out.option("path", self.scratch.path(name)).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
                self.scratch.drop(name)
        self.levels = []


def dedup_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and ``n_lines``, ``n_dropped`` (long) added.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``least`` code points
    or more that two documents hold lose their lines in all but the smallest ``doc_id`` holding them; there
    all stay, and so do other lines. Documents come in ``batches`` by ascending ``doc_id``: a batch's keys
    are held against the runs of the batches before it, and within the batch against their own smallest
    document. All documents are read whatever the number of batches, which only bounds the size of one.

    A null or empty text is one empty line and comes back empty. Rows that repeat a ``doc_id`` are parts of
    one document: what only they share stays in each of them. Rows without a ``doc_id`` keep all lines and
    own none. Other columns pass through whatever their names, but for columns called ``n_lines`` or
    ``n_dropped``, which are replaced. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    dropped = _dropped(docs, least, batches, fanout, scratch)
    places = dropped.groupBy("__doc", "version").agg(F.collect_set("pos").alias("__gone"))

    inner, names = numbered(docs)
    body = names[docs.columns.index("text")]
    wide = versions(inner, "__doc", body).join(places, ["__doc", "version"], "left")
    lines = F.split(F.coalesce(body, F.lit("")), "\n", -1)
    none = F.array().cast("array<int>")
    wide = wide.withColumn("__lines", lines).withColumn("__gone", F.coalesce("__gone", none))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    cut = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    text = F.when(F.size("__gone") == 0, F.coalesce(body, F.lit(""))).otherwise(cut)
    columns = [(text if c == "text" else F.col(k)).alias(c) for k, c in zip(names, docs.columns) if c not in ADDED]
    counts = [F.size(c).cast("long").alias(name) for c, name in zip(("__lines", "__gone"), ADDED)]
    return wide.select(*columns, *counts)


def _dropped(docs: DataFrame, least: int, batches: int, fanout: int, scratch: Scratch) -> DataFrame:
    """``__doc, version, pos`` of the lines that :func:`dedup_lines` drops."""
    id_of, text_of = F.col("doc_id").cast("long").alias("__doc"), F.coalesce("text", F.lit("")).alias("text")
    rows = versions(docs.select(id_of, text_of).filter("__doc IS NOT NULL"), "__doc")
    bounds = rows.approxQuantile("__doc", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    bounds = sorted(set(bounds))
    batch = sum((F.when(F.col("__doc") > b, 1).otherwise(0) for b in bounds), F.lit(0)).alias("batch")
    split = rows.select("__doc", "version", batch, F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = split.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= least)
    lines = keyed.select("batch", "__doc", "version", "pos", *hashes(F.col("key")))
    lines = scratch.cut(lines, "lines", ("batch",))

    store = LineRuns(docs.sparkSession, scratch, fanout)
    dropped = None
    try:
        for k in range(len(bounds) + 1):
            part = lines.filter(F.col("batch") == k).drop("batch")
            ends = F.min("__doc").alias("first"), F.max("__doc").alias("last")
            keys = part.groupBy(*KEY).agg(*ends, F.count("*").alias("n"))
            marked = scratch.cut(store.seen(keys), f"keys-{k}")
            if k < len(bounds):
                store.add(marked.filter("NOT seen"))
            owner = F.when(F.col("seen"), None).otherwise(F.col("first")).alias("owner")
            repeats = marked.filter("seen OR first < last").select(*KEY, owner, "n")
            gone = join_hot(part, repeats, KEY, "n").filter("owner IS NULL OR __doc <> owner")
            gone = scratch.cut(gone.select("__doc", "version", "pos"), f"gone-{k}")
            scratch.drop(f"keys-{k}")
            dropped = gone if dropped is None else dropped.union(gone)
    finally:
        store.close()
        scratch.drop("lines")
    return dropped
