"""SimHash near-duplicates by an inverted index over byte positions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, join_hot, numbered, parts, texts
from tessera.llm.components import Forest, components

#: Positional bytes of a fingerprint.
BYTES = 8
#: Shingle hashes whose bits are tallied at once.
BLOCK = 65_536
#: Buckets up to this size are compared by shifts over a whole batch of buckets.
SMALL = 32
#: Fingerprints of a posting that one task compares; larger ones are parted into blocks.
POSTING = 4096


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    split = text.encode().lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    ends = np.cumsum([len(w) + 1 for w in split])
    k = min(words, len(split))
    starts, stops = (ends - [len(w) + 1 for w in split])[: len(split) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of every whole text."""

    def run(batches):
        for batch in parts(batches):
            each = (fingerprint(t.as_py(), words, seed) for t in batch.column("text"))
            fp = np.fromiter(each, np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def postings(fp: Column, least: int) -> Column:
    """Keys of the inverted index: every choice of ``least`` byte positions with the bytes there.

    Fingerprints that share at least ``least`` positional bytes share a key, so meeting in a posting is the
    count filter's tally having reached its minimum. The choice's number lies in a byte that it leaves free.
    """
    keys = []
    for number, chosen in enumerate(combinations(range(BYTES), least)):
        mask = sum(0xFF << 8 * p for p in chosen)
        free = next((p for p in range(BYTES) if p not in chosen), None)
        key = fp.bitwiseAND(F.lit(_signed(mask)))
        keys.append(key if free is None else key.bitwiseOR(F.lit(_signed(number << 8 * free))))
    return F.array(*keys)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that have the components of all pairs within ``radius``.

    Two fingerprints that differ in r bits share at least 8 - r bytes at their places. Each key's
    fingerprints stand side by side after one shuffle and are counted there; keys with one alone go no
    further. A task tallies and verifies the others as they stream past and gives only links that join
    something, so a key with many fingerprints gives fewer links than it has members. Keys of more than
    POSTING fingerprints are parted into blocks, every two of which meet in a group of their own. All pairs
    of a key are compared, by vectors of eight-byte words; no pair is a row.
    """
    least = BYTES - radius
    if least < 1:
        raise ValueError("the radius must be below 8 bits")

    def run(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        forest = Forest()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
            yield from within(keys[:whole], fps[:whole], radius, least, forest)
            keys, fps = keys[whole:], fps[whole:]
            if len(forest.up) > 1_000_000:
                forest = Forest()
        yield from within(keys, fps, radius, least, forest)

    spread = distinct.select("fp", F.explode(postings(F.col("fp"), least)).alias("key"))
    sized = spread.withColumn("size", F.count("*").over(Window.partitionBy("key"))).filter("size > 1")
    small = sized.filter(F.col("size") <= POSTING).select("key", "fp").sortWithinPartitions("key")
    large = sized.filter(F.col("size") > POSTING)
    blocks = F.ceil(2 * F.col("size") / POSTING).cast("long")
    large = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    large = large.select(group.alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    schema = "a long, b long"
    return small.mapInArrow(run, schema).union(large.mapInArrow(run, schema))


def within(keys: np.ndarray, fps: np.ndarray, radius: int, least: int, forest: Forest):
    """Batches of links in whole buckets, given by sorted keys."""
    if len(keys) < 2:
        return
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    found: list[tuple[int, int]] = []
    small = np.repeat(size <= SMALL, size)
    for shift in range(1, int(min(size.max(), SMALL))):
        at = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:])
        if not len(at):
            break
        a, b = fps[at], fps[at + shift]
        near = close(a, b, radius, least)
        found += zip(a[near].view(np.int64).tolist(), b[near].view(np.int64).tolist())
    for start, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        found += one_bucket(fps[start : start + n], radius, least)
    new = [p for p in found if forest.link(*p)]
    if new:
        a, b = zip(*new)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def close(a, b, radius: int, least: int) -> np.ndarray:
    """The tally of shared positional bytes, then the differing bits."""
    differ = a ^ b
    bits = np.bitwise_count(differ)
    shared = (differ[..., None].view(np.uint8).reshape(*differ.shape, BYTES) == 0).sum(axis=-1)
    return (shared >= least) & (bits <= radius)


def one_bucket(fps: np.ndarray, radius: int, least: int) -> list[tuple[int, int]]:
    """A spanning forest of one bucket: each member is compared with all before it, one link is kept per part reached."""
    part = np.arange(len(fps))
    out = []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius)
        near = near[close(fps[near], np.full(len(near), fps[i]), radius, least)]
        for p, at in zip(*np.unique(part[near], return_index=True)):
            out.append((int(fps[near[at]].view(np.int64)), int(fps[i].view(np.int64))))
            part[:i][part[:i] == p] = part[i]
    return out


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: fingerprints within ``radius`` bits link, components are closed.

    Rows with the same fingerprint are one class before anything is compared, however many they are; the
    index, its verification and the components work on classes, named by their smallest ``doc_id``.

    A null, empty or blank text has the fingerprint 0 and links like any other; repeated rows are each
    given; a row without a ``doc_id`` has a null class if no other row of its component has one; other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.cut(fingerprints(docs, words, seed), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = scratch.cut(classes, "classes")
    found = scratch.cut(links(classes.select("fp"), radius), "links")
    a = classes.select(F.col("fp").alias("a"), F.col("first").alias("x"))
    b = classes.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    edges = found.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    joined = components(edges, scratch).withColumnRenamed("id", "first")
    named = classes.join(joined, "first", "left")
    named = scratch.cut(named.select("fp", "n", F.coalesce("component_id", "first").alias("component_id")), "named")
    return join_hot(rows, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with the document of the smallest ``doc_id`` of each component only; columns as they were.

    Rows that repeat a ``doc_id`` are one document and stay together; rows without one stay.
    """
    found = simhash_components(docs, words, radius, seed).filter("doc_id = component_id")
    keep = found.select(F.col("doc_id").alias("__doc")).distinct()
    inner, names = numbered(docs)
    kept = inner.join(keep, "__doc", "left_semi").unionByName(inner.filter("__doc IS NULL"))
    return kept.select(*names).toDF(*docs.columns)
