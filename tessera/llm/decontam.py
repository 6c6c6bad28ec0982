"""Benchmark decontamination by SimHash of item-sized windows. DataFrame operations only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, numbered, versions

#: Blocks of the multi-index, and the differing bits tried in each block.
BLOCKS, FLIPS = 10, 1
#: Fingerprints that differ in at most this many bits share a block up to FLIPS bits: one of BLOCKS blocks has no more.
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Shingles that two-byte counters, four in one long, can count; longer windows take four-byte ones, two in one long.
LANE_MAX = 30_000
#: Rows of the benchmark's shingles, and of its filed fingerprints, that are broadcast (up to some 50 bytes
#: each); larger benchmarks are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bits of the filter of documents that have windows, as a power of two; 64 are a row of what is broadcast.
FILTER_BITS = 24


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def with_shingles(rows: DataFrame, n: int) -> DataFrame:
    """``text`` replaced by ``s``: a hash for every n-word shingle, in order; the whole sequence if it has fewer words.

    Words are hashed once, in a projection of their own that later ones refer to several times, which keeps
    Catalyst from folding the hashing into the loop over shingles.
    """
    others = [c for c in rows.columns if c != "text"]
    hashed = rows.select(*others, F.transform(words_of(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("h"))

    def folded(i: Column) -> Column:
        return reduce(lambda acc, k: F.xxhash64(acc, F.get("h", i + k)), range(1, n), F.get("h", i))

    whole = F.array(F.aggregate("h", F.lit(0).cast("bigint"), lambda acc, h: F.xxhash64(acc, h)))
    long_enough = F.transform(F.sequence(F.lit(0), F.size("h") - n), folded)
    shingles = F.when(F.size("h") >= n, long_enough).when(F.size("h") > 0, whole).otherwise(F.array().cast("array<bigint>"))
    return hashed.select(*others, F.size("h").alias("n_words"), shingles.alias("s"))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def simhash(shingles: Column) -> Column:
    """A bit for each of 64 that is set in over half the shingle hashes, repeats weighing as often as they occur.

    Long sums hold the 64 counters: four in each of sixteen for windows of up to ``LANE_MAX`` shingles, two in
    each of thirty-two for longer ones.
    """
    return F.when(F.size(shingles) <= LANE_MAX, majorities(shingles, 4)).otherwise(majorities(shingles, 2))


def majorities(shingles: Column, lanes: int) -> Column:
    """The bits of :func:`simhash` by sums of so many counters each.

    With n sums, bits g, g + n, g + 2n ... of a hash are lanes of sum g. A counter is over half the window
    where adding 2**(n - 2) - 1 less that half reaches 2**(n - 2).
    """
    sums = 64 // lanes
    ones = sum(1 << sums * k for k in range(lanes))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"l{g}") for g in range(sums)])

    def add(acc: Column, h: Column) -> Column:
        return F.struct(*[(acc[f"l{g}"] + F.shiftrightunsigned(h, g).bitwiseAND(F.lit(ones))).alias(f"l{g}") for g in range(sums)])

    def majority(acc: Column) -> Column:
        over = F.lit((1 << sums - 2) - 1).cast("bigint") - F.floor(F.size(shingles) / 2).cast("bigint")
        bits = [F.shiftleft(F.shiftrightunsigned(acc[f"l{g}"] + over * F.lit(ones), sums - 2).bitwiseAND(F.lit(ones)), g) for g in range(sums)]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return F.aggregate(shingles, zero, add, majority)


def block_bits() -> list[tuple[int, int]]:
    """(first bit, bits) of each block of 64."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_keys(fp: Column, flips: int) -> Column:
    """Keys of all blocks; with ``flips``, of all values that differ from the block's in so many bits."""
    keys = []
    for number, (first, width) in enumerate(block_bits()):
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        for n in range(flips + 1):
            for bits in combinations(range(width), n):
                keys.append(value.bitwiseXOR(F.lit(sum(1 << b for b in bits)).cast("bigint")) + F.lit(number << 8))
    return F.array(*keys)


def first_block(a: Column, b: Column) -> Column:
    """The first block in which two fingerprints differ in at most ``FLIPS`` bits: of those where a pair meets, the one that counts."""
    differ = a.bitwiseXOR(b)
    return F.coalesce(*[F.when(F.bit_count(differ.bitwiseAND(F.lit(_signed(((1 << width) - 1) << first)))) <= FLIPS, F.lit(number)) for number, (first, width) in enumerate(block_bits())])


def starts(at: Column, size: Column, long: Column, least: float) -> Column:
    """Ranges ``lo, hi`` of the starts of windows of ``long`` shingles that may reach ``least``.

    ``at`` are the places of shingles that count, ascending, in a document of ``size`` shingles. A whole window
    needs 2 * long * least / (1 + least) of them. One that the document's end cuts needs least * long, and is
    no shorter than that.
    """

    def ranges(need: Column, first: Column, last: Column) -> Column:
        lo = lambda i: F.greatest(F.get(at, i + need - 1) - long + 1, first)
        hi = lambda i: F.least(F.get(at, i), last)
        rows = F.transform(F.sequence(F.lit(0), F.size(at) - need), lambda i: F.struct(F.when(i == 0, lo(i)).otherwise(F.greatest(lo(i), hi(i - 1) + 1)).alias("lo"), hi(i).alias("hi")))
        return F.when(F.size(at) >= need, F.filter(rows, lambda r: r["lo"] <= r["hi"])).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))

    count = lambda x: F.greatest(F.ceil(x - 1e-9).cast("int"), F.lit(1))
    whole = ranges(count(long * (2 * least / (1 + least))), F.lit(0), size - long)
    short = count(long * least)
    return F.concat(whole, ranges(short, F.greatest(size - long + 1, F.lit(0)), size - short))


def sifted(rows: DataFrame, some: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose key ``some`` may have: all that it has, and of the others as many as share a bit with one.

    A key's hash is one of 2**FILTER_BITS bits. They are broadcast as at most 2**(FILTER_BITS - 6) rows, for any number of keys.
    """
    h = F.shiftrightunsigned(F.xxhash64(*on), 64 - FILTER_BITS)
    word, bit = F.shiftright(h, 6), h.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    words = some.select(word.alias("__word"), one.alias("one")).groupBy("__word").agg(F.bit_or("one").alias("__bits"))
    met = rows.withColumn("__word", word).join(F.broadcast(words), "__word")
    return met.filter(F.getbit("__bits", bit) == 1).drop("__word", "__bits")


KEY = ["doc_id", "version"]
FOUND = "doc_id long, item_id long, start_word int, n_words int, similarity double, n_windows long"


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """Benchmark items found in documents: a row for each pair of document and item.

    Returns ``doc_id, item_id, start_word, n_words, similarity, n_windows``: the best window (the first of
    equals) and how many reach ``least``. Windows have the item's number of words; words are runs of letters
    and digits, lower-cased. A window and an item are compared by their bags of ``words``-word shingles:
    the weight of a shingle is its number of occurrences, the similarity the sum of the smaller weights over
    the sum of the larger.

    A window and an item that reach ``least`` have so many shingles in common that the window's own places
    that hold a shingle of some item of that length are at least as many. So windows are laid at every start
    from which that many places lie in the window, wherever in the item their shingles stand: copies with parts
    in another order have their windows too, and what is skipped cannot reach ``least``. Windows that
    the document's end cuts short count where no whole one reaches ``least``. Each window then gets a SimHash,
    and the multi-index finds all items of its length whose fingerprints lie within ``RADIUS`` bits: of
    ``BLOCKS`` blocks one differs in at most ``FLIPS`` bits, so the items are filed under all values that near
    to theirs. The exact similarity decides on each candidate.

    Texts are shuffled of documents that have windows, which a filter of fixed size picks, and of the few that it
    takes for such. The windows and the items' shingles are shuffled or, while they are few, broadcast. A null or empty
    text or item has no words and matches nothing. An item of fewer than ``words`` words is one shingle, as is
    a document: it is found in documents of the same words, not inside longer ones. Rows that repeat a
    ``doc_id`` are searched each, and give a pair once with its best window; rows without an id are left out;
    other columns are ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL")
    items = scratch.cut(with_shingles(items, words).filter("n_words > 0").distinct(), "item-shingles")
    items = scratch.cut(items.select("item_id", "n_words", "s", simhash(F.col("s")).alias("fp")), "items")

    # the lengths of the items that each shingle stands in
    seeds = scratch.cut(items.select("n_words", F.explode("s").alias("h")).groupBy("h").agg(F.collect_set("n_words").alias("uses")), "seeds")
    maybe = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    id_of, text_of = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    rows = versions(docs.select(id_of, text_of).filter("doc_id IS NOT NULL"))
    shingled = with_shingles(rows, words).select(*KEY, F.size("s").alias("size"), "s")
    # an inner explode would have its array filtered first, and made twice
    places = shingled.select(*KEY, "size", F.posexplode_outer("s").alias("at", "h"))
    hits = places.join(maybe(seeds), "h").select(*KEY, "size", F.explode("uses").alias("n_words"), "at")
    held = hits.groupBy(*KEY, "size", "n_words").agg(F.sort_array(F.collect_set("at")).alias("at"))
    long = F.greatest(F.col("n_words") - words + 1, F.lit(1))
    ranges = F.explode(starts(F.col("at"), F.col("size"), long, least)).alias("r")
    windows = held.select(*KEY, "n_words", ranges).select(*KEY, "n_words", "r.lo", "r.hi")
    windows = scratch.cut(windows, "windows")
    if not windows.take(1):
        return spark.createDataFrame([], FOUND)

    # windows are cut from the documents that have any; what the join moves is their text, from which shingles are made again
    laid = windows.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi", "n_words")).alias("laid"))
    hit_docs = with_shingles(sifted(rows, windows, KEY).join(laid.hint("merge"), KEY), words).select(*KEY, "s", F.explode("laid").alias("l"))
    hit_docs = hit_docs.select(*KEY, "s", "l.lo", "l.hi", "l.n_words").filter(F.col("lo") < F.size("s"))
    held = F.slice("s", F.col("lo") + 1, F.col("hi") - F.col("lo") + long).alias("s")
    ranges = hit_docs.select(*KEY, "lo", "hi", "n_words", held)
    last = F.least(F.col("hi"), F.col("lo") + F.size("s") - 1)
    each = ranges.select(*KEY, "lo", "n_words", "s", F.explode(F.sequence("lo", last)).alias("start"))
    one = F.slice("s", F.col("start") - F.col("lo") + 1, long).alias("s")
    cut = each.select(*KEY, "start", "n_words", one).dropDuplicates([*KEY, "start", "n_words"])
    # written twice, as plans that fold slicing, hashing and filing into each other compile to methods of gigabytes
    cut = scratch.cut(cut, "cut")
    cut = scratch.cut(cut.select("doc_id", "start", "n_words", "s", simhash(F.col("s")).alias("fp")), "cut-fingerprints")

    filed = items.select("n_words", F.explode(block_keys(F.col("fp"), FLIPS)).alias("key"), F.col("fp").alias("item_fp"), "item_id")
    filed = scratch.cut(filed, "filed")
    asked = cut.select("doc_id", "start", "n_words", "s", "fp", F.explode(block_keys(F.col("fp"), 0)).alias("key"))
    near = asked.join(maybe(filed), ["n_words", "key"])
    near = near.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.filter(first_block(F.col("fp"), F.col("item_fp")) == F.shiftright("key", 8)).drop("n_words", "fp", "key")
    texts = items.select("item_id", "n_words", F.col("fp").alias("item_fp"), F.col("s").alias("item_s"))
    near = near.join(texts, ["item_id", "item_fp"])  # each row of an item that repeats has its own
    exact = near.withColumn("similarity", bag_similarity(F.col("s"), F.col("item_s"))).filter(F.col("similarity") >= least)
    whole = (F.size("s") == long) | (F.col("start") == 0)
    each = exact.groupBy("doc_id", "item_id", "start", "n_words").agg(F.max("similarity").alias("similarity"), F.max(whole).alias("whole"))
    best = each.groupBy("doc_id", "item_id").agg(F.max(F.struct("whole", "similarity", -F.col("start"), "n_words")).alias("b"), F.count_if("whole").alias("n_whole"), F.count("*").alias("n"))
    return best.select("doc_id", "item_id", (-F.col("b.col3")).alias("start_word"), "b.n_words", "b.similarity", F.when(F.col("b.whole"), F.col("n_whole")).otherwise(F.col("n")).alias("n_windows"))


def bag_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger weights of two bags of hashes.

    Where either bag has no repeats the sum of the smaller weights is the size of the intersection. Else
    both are sorted into one list, and a fold over it closes the counts of one hash as the next one comes.
    """
    side = lambda bag, n: F.transform(bag, lambda x: F.struct(x.alias("h"), F.lit(n).alias("side")))
    both = F.sort_array(F.concat(side(a, 0), side(b, 1)))
    count = lambda n: F.lit(n).cast("int")
    start = F.struct(F.lit(0).cast("bigint").alias("h"), count(0).alias("x"), count(0).alias("y"), count(0).alias("common"))

    def step(acc: Column, e: Column) -> Column:
        same = acc["h"] == e["h"]
        x = F.when(same, acc["x"]).otherwise(0) + F.when(e["side"] == 0, 1).otherwise(0)
        y = F.when(same, acc["y"]).otherwise(0) + F.when(e["side"] == 1, 1).otherwise(0)
        closed = F.when(same, 0).otherwise(F.least(acc["x"], acc["y"]))
        return F.struct(e["h"].alias("h"), x.alias("x"), y.alias("y"), (acc["common"] + closed).alias("common"))

    folded = F.aggregate(both, start, step, lambda acc: acc["common"] + F.least(acc["x"], acc["y"]))
    once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    common = F.when(once, F.size(F.array_intersect(a, b))).otherwise(folded)
    return common / (F.size(a) + F.size(b) - common)


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold an item of ``benchmark``; columns as they were.

    Rows without a ``doc_id`` stay.
    """
    leaks = contamination(docs, benchmark, words, least).select(F.col("doc_id").alias("__doc")).distinct()
    inner, names = numbered(docs)
    return inner.join(leaks, "__doc", "left_anti").select(*names).toDF(*docs.columns)
