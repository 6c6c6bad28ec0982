"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import flat_graph
from tessera.llm.common import Scratch, join_hot, parts
from tessera.llm.components import Forest, components

#: Vectors that the centroids are fitted on, and centroids, at most.
SAMPLE, MAX_SHARDS = 20_000, 4096
#: Vectors of a shard on average, before overlap; shards above SHARD_MAX are clustered again, on SPLIT_SAMPLE of theirs.
SHARD, SHARD_MAX, SPLIT_SAMPLE = 1024, 16_384, 2048
#: Nearest centroids that a vector goes to, and of those in a shard that is clustered again; such rounds at most.
OVERLAP, SPLIT_OVERLAP, SPLITS = 3, 2, 4
#: How far below the wanted cosine a vertex is still expanded, and may still lead a search into other shards.
SLACK, BRIDGE = 0.07, 0.03
#: Rounds in which searches go on into other shards, at most.
ROUNDS = 8
#: Rows of a group in which vectors of a large shard are dealt to its parts.
DEAL = 20_000

def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means with evenly spaced first centres."""
    if not len(sample):
        return sample
    centre = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)]
    for _ in range(rounds):
        chunks = np.array_split(sample, len(sample) // 4096 + 1)
        nearest = np.concatenate([(part @ centre.T).argmax(axis=1) for part in chunks])
        total = np.zeros_like(centre)
        np.add.at(total, nearest, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centre)
    return centre


def nearest_centroids(u: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each vector, the nearest first."""
    s = u @ centre.T
    k = min(k, len(centre))
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def place(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of the shards, one row for each shard of a class: ``cid, u, n, shards, shard``.

    Centroids are fitted on a bounded sample. Shards above SHARD_MAX are clustered again by centroids of their
    own, fitted where their sample is, so that a cluster that holds a large part of all vectors is many
    shards as well. What SPLITS rounds leave above is searched as it is.
    """
    spark = classes.sparkSession
    total = classes.count()
    k = max(1, min(MAX_SHARDS, total // SHARD))
    by_width: dict[int, list] = {}
    for r in classes.select("cid", "u").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect():
        by_width.setdefault(len(r.u), []).append(r.u)
    centre, first, at = {}, {}, 0
    for width in sorted(by_width):
        centre[width], first[width] = centroids(np.array(by_width[width]), k), at
        at += len(centre[width])
    shared = spark.sparkContext.broadcast((centre, first))

    def deal(batches):
        centre, first = shared.value
        for batch in parts(batches, 4096):
            out: list = [None] * batch.num_rows
            vectors = batch.column("u").to_pylist()
            for width in {len(v) for v in vectors}:
                rows = [i for i, v in enumerate(vectors) if len(v) == width]
                if width not in centre:  # a width that the sample has none of: one shard
                    found = np.full((len(rows), 1), -width)
                else:
                    own = np.array([vectors[i] for i in rows])
                    found = first[width] + nearest_centroids(own, centre[width], OVERLAP)
                for i, shards in zip(rows, found.tolist()):
                    out[i] = shards
            shards = pa.array(out, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, shards], [*batch.schema.names, "shards"])

    dealt = classes.select("cid", "u", "n").mapInArrow(deal, "cid long, u array<double>, n long, shards array<long>")
    dealt = scratch.cut(dealt, "dealt-0")
    for turn in range(1, SPLITS + 1):
        sizes = dealt.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count("*").alias("size"))
        large = scratch.cut(sizes.filter(F.col("size") > SHARD_MAX), f"large-{turn}")
        if not large.take(1):
            break
        dealt = scratch.cut(_split(dealt, large), f"dealt-{turn}")
    return dealt.withColumn("shard", F.explode("shards"))


def _split(dealt: DataFrame, large: DataFrame) -> DataFrame:
    """``dealt`` with the ``large`` shards replaced by clusters within them."""
    members = dealt.withColumn("shard", F.explode("shards"))
    few = large.count() <= 100_000
    sized = members.join(F.broadcast(large) if few else large, "shard", "left")
    rest = sized.filter("size IS NULL").select("cid", F.col("shard").alias("part"))
    inside = sized.filter("size IS NOT NULL").select("cid", "u", "shard", "size")
    chance = F.lit(2.0 * SPLIT_SAMPLE) / F.col("size")  # by hash, so the same rows whenever a task runs again
    sample = inside.filter(F.pmod(F.xxhash64("cid", "shard"), F.lit(1 << 20)) < chance * (1 << 20))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        k = int(np.clip(pdf["size"].iloc[0] // SHARD, 2, 256))
        found = centroids(np.stack(pdf["u"].to_numpy()), k)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "centre": [found.ravel().tolist()]})

    fitted = sample.groupBy("shard").applyInPandas(fit, "shard long, centre array<double>")
    salts = F.ceil(F.col("size") / DEAL).cast("int")
    copies = fitted.join(large, "shard").select("shard", "centre", F.explode(F.sequence(F.lit(0), salts)).alias("salt"))
    salted = inside.withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("size") / DEAL + 1).cast("int")).drop("size")

    def deal(members: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(centres):
            return members.assign(part=members["shard"])[["cid", "part"]] if len(members) else pd.DataFrame({"cid": [], "part": []})
        u = np.stack(members["u"].to_numpy())
        found = nearest_centroids(u, np.asarray(centres["centre"].iloc[0]).reshape(-1, u.shape[1]), SPLIT_OVERLAP)
        base = np.int64(members["shard"].iloc[0]) * 257 + (1 << 40)
        return pd.DataFrame({"cid": np.repeat(members["cid"].to_numpy(), found.shape[1]), "part": base + found.ravel()})

    grouped = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt"))
    parted = grouped.applyInPandas(deal, "cid long, part long")
    lists = rest.unionByName(parted).groupBy("cid").agg(F.sort_array(F.collect_set("part")).alias("shards"))
    return dealt.drop("shards").join(lists, "cid")


def united_graph(members: DataFrame, scratch: Scratch) -> DataFrame:
    """``cid, to``: adjacency lists of the graphs built on every shard, united."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        ids = pdf["cid"].to_numpy()
        edges = flat_graph.build(np.stack(pdf["u"].to_numpy()).astype(np.float32))
        return pd.DataFrame({"cid": ids, "to": [ids[e[e >= 0]].tolist() for e in edges]})

    lists = members.select("shard", "cid", "u").groupBy("shard").applyInPandas(build, "cid long, to array<long>")
    lists = scratch.cut(lists, "lists")
    return lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))


#: What a search gives: the links that it counts for a vertex (``links``), a link (``b``), or a shard where it goes on.
FOUND = "a long, links long, b long, shard long, seed long"


def _frame(links=(), edges=(), on=()) -> pd.DataFrame:
    """Rows of FOUND from (vertex, links), (vertex, vertex) and (vertex, shard, seed)."""
    none = [None]
    columns = {
        "a": [x[0] for x in (*links, *edges, *on)],
        "links": [x[1] for x in links] + none * (len(edges) + len(on)),
        "b": none * len(links) + [x[1] for x in edges] + none * len(on),
        "shard": none * (len(links) + len(edges)) + [x[1] for x in on],
        "seed": none * (len(links) + len(edges)) + [x[2] for x in on],
    }
    return pd.DataFrame({c: pd.array(v, "Int64") for c, v in columns.items()})


class _Shard:
    """One shard's part of the united graph, in a task."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values("cid", ignore_index=True)
        self.shard, self.ids, self.n = int(pdf["shard"].iloc[0]), pdf["cid"].to_numpy(), pdf["n"].to_numpy()
        self.u = np.stack(pdf["u"].to_numpy())
        self.x = self.u.astype(np.float32)
        self.lists = [frozenset(s) for s in pdf["shards"]]
        to = [np.asarray(t, np.int64) for t in pdf["to"]]
        flat, row = np.concatenate(to), np.repeat(np.arange(len(to)), [len(t) for t in to])
        at = np.minimum(np.searchsorted(self.ids, flat), len(self.ids) - 1)
        row, at = row[self.ids[at] == flat], at[self.ids[at] == flat]
        size = np.bincount(row, minlength=len(to))
        self.edges = np.full((len(to), max(1, int(size.max()))), -1)
        self.edges[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = at
        self.medoid = flat_graph.medoid(self.x)

    def search(self, ids: np.ndarray, u: np.ndarray, now: list, earlier: list, seeds: np.ndarray, least: float):
        """All queries ``ids`` from the medoid and their seeds; ``now`` and ``earlier`` are the shards they are searched in.

        A pair counts in the first of the shards ``now`` that its vertex is in, unless it is in an earlier one.
        """
        start = np.searchsorted(self.ids, seeds)
        start = np.c_[np.full(len(ids), self.medoid), start]
        x = u.astype(np.float32)
        ways, kinds = list(dict.fromkeys(zip(now, earlier))), list(dict.fromkeys(self.lists))
        number = {w: k for k, w in enumerate(ways)}, {w: k for k, w in enumerate(kinds)}
        way = np.array([number[0][w] for w in zip(now, earlier)])
        kind = np.array([number[1][w] for w in self.lists])
        known: dict[int, tuple[bool, frozenset]] = {}

        def judged(key: int) -> tuple[bool, frozenset]:
            """Whether pairs of this way and kind count here, and the shards that they lead to."""
            if key not in known:
                (into, past), held = ways[key // len(kinds)], kinds[key % len(kinds)]
                known[key] = min(into & held, default=None) == self.shard and not past & held, held - into - past
            return known[key]

        on: dict[tuple[int, int], tuple[float, int]] = {}
        links, forest, edges = np.zeros(len(ids), np.int64), Forest(), []
        for q, v in flat_graph.range_pairs(self.x, self.edges, x, start, least - SLACK):
            other = ids[q] != self.ids[v]
            q, v = q[other], v[other]
            cos = np.einsum("ij,ij->i", u[q], self.u[v])
            linked = cos >= least
            keys, of_pair = np.unique(way[q] * len(kinds) + kind[v], return_inverse=True)
            counts = np.array([judged(k)[0] for k in keys.tolist()], bool)
            leads = np.array([bool(judged(k)[1]) for k in keys.tolist()], bool)
            mine = linked & counts[of_pair]
            np.add.at(links, q[mine], self.n[v[mine]])
            for a, b in zip(ids[q[linked]].tolist(), self.ids[v[linked]].tolist()):
                if forest.link(a, b):
                    edges.append((a, b))
            out = np.flatnonzero(leads[of_pair] & (cos >= least - BRIDGE))
            for a, b, c, k in zip(q[out].tolist(), v[out].tolist(), cos[out].tolist(), of_pair[out].tolist()):
                for t in judged(int(keys[k]))[1]:
                    if (a, t) not in on or on[a, t][0] < c:
                        on[a, t] = c, b
        some = np.flatnonzero(links)
        return _frame(
            list(zip(ids[some].tolist(), links[some].tolist())),
            edges,
            [(int(ids[a]), t, int(self.ids[b])) for (a, t), (_, b) in on.items()],
        )


def graph_links(classes: DataFrame, least: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(``cid, links``, ``a, b``): links to vectors of other classes, and edges with their components.

    Every vector is searched in its shards: greedily from the medoid and its own place, then over all that
    lies in range. A vertex in range that is in other shards too is where a search leaves: it goes on there
    in the next round, from that vertex and the medoid, until no search has a shard to go to where it has
    not been. Cosines are verified in double precision.
    """
    members = scratch.cut(place(classes, scratch), "members")
    graph = scratch.cut(members.join(united_graph(members, scratch), "cid"), "graph")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        s = _Shard(pdf)
        return s.search(s.ids, s.u, s.lists, [frozenset()] * len(s.ids), s.ids, least)

    found = scratch.cut(graph.groupBy("shard").applyInPandas(first, FOUND), "found-0")
    rounds = [found]
    been = members.select(F.col("cid").alias("a"), "shard", F.lit(0).alias("turn"))
    for turn in range(1, ROUNDS + 1):
        on = found.filter("shard IS NOT NULL").groupBy("a", "shard").agg(F.min("seed").alias("seed"))
        on = scratch.cut(on.join(been, ["a", "shard"], "left_anti"), f"on-{turn}")
        if not on.take(1):
            break
        past = been.join(on.select("a").distinct(), "a").groupBy("a").agg(F.collect_set("shard").alias("earlier"))
        into = on.groupBy("a").agg(F.collect_set("shard").alias("now"))
        asked = on.join(into, "a").join(past, "a").join(classes.select(F.col("cid").alias("a"), "u"), "a")
        found = scratch.cut(_go_on(graph, asked, on, least), f"found-{turn}")
        rounds.append(found)
        been = been.unionByName(on.select("a", "shard", F.lit(turn).alias("turn")))
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    links = every.filter("links IS NOT NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    return links, every.filter("b IS NOT NULL").select("a", "b")


def _go_on(graph: DataFrame, asked: DataFrame, on: DataFrame, least: float) -> DataFrame:
    """One more round of searches in the shards that they go to, a bounded number of them in a task."""
    sizes = on.groupBy("shard").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("salts"))
    queries = asked.join(sizes, "shard").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
    copies = graph.join(sizes, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def search(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return _frame()
        s = _Shard(members)
        now, earlier = ([frozenset(x) for x in queries[c]] for c in ("now", "earlier"))
        u = np.stack(queries["u"].to_numpy())
        return s.search(queries["a"].to_numpy(), u, now, earlier, queries["seed"].to_numpy(), least)

    grouped = queries.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt"))
    return grouped.applyInPandas(search, FOUND)


def unit_vector(vector: Column) -> Column:
    """The vector at length one in double precision, scaled first so that no square over- or underflows; null if it can't link.

    Null, empty and zero vectors can't, nor can those with null or non-finite components.
    """

    def let(value: Column, body) -> Column:  # computed once, where a column named in a lambda is computed at each element
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def at_length_one(v: Column) -> Column:
        length = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x * x))
        over = lambda w, by: F.transform(w, lambda x: x / by)
        largest = F.array_max(F.transform(v, lambda x: F.abs(x)))
        return let(let(largest, lambda m: over(v, m)), lambda w: let(length(w), lambda n: over(w, n)))

    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    return F.when(usable, let(v, at_length_one))


def near_vectors(rows: DataFrame, least: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Links at a cosine of ``least`` or more: ``vec_id, n_links, component_id, kept`` for every row.

    Vectors of one direction are one class, however many; a robust-pruned graph over the classes finds the
    links between classes, and double precision verifies each. Centroids are fitted on at most SAMPLE vectors
    (those with the smallest hash), every vector is indexed in its OVERLAP nearest shards, adjacency lists
    of all shards are united, and each vector is searched from the medoids of its shards and on into others.
    Links that the graph misses are missed; :func:`true_links` counts those of some vectors by brute force.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths don't link. Rows with the same ``vec_id`` count as several vectors, each with its own
    links. Rows without one have no class of their own: they link with nothing, ``component_id`` null,
    ``kept`` null. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "vectors")
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), unit_vector(F.col(vector)).alias("u"))
    keyed = base.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("u")).alias("u"))
    keyed = keyed.select("vec_id", "u", F.xxhash64("u").alias("h1"), F.xxhash64(F.lit(1), F.col("u")).alias("h2"))
    keyed = scratch.cut(keyed, "keyed")
    same = keyed.filter("u IS NOT NULL").groupBy("h1", "h2")
    classes = same.agg(F.min("vec_id").alias("first"), F.first("u").alias("u"), F.count("*").alias("n"))
    classes = scratch.cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    links, edges = graph_links(classes.select("cid", "u", "n"), least, scratch)
    parts_of = components(edges, scratch).withColumnRenamed("id", "cid")
    placed = classes.select("cid", "h1", "h2", "n", "first").join(links, "cid", "left").join(parts_of, "cid", "left")
    placed = placed.withColumn("part", F.coalesce("component_id", "cid")).drop("component_id")
    names = placed.groupBy("part").agg(F.min("first").alias("component_id"))
    others = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    named = scratch.cut(placed.join(names, "part").select("h1", "h2", "n", others, "component_id"), "named")
    good = keyed.filter("u IS NOT NULL").select("vec_id", "h1", "h2")
    good = join_hot(good, named, ["h1", "h2"], "n").select("vec_id", "n_links", "component_id")
    bad = keyed.filter("u IS NULL")
    bad = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def true_links(rows: DataFrame, least: float = 0.95, queries: int = 200, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, true_links`` of a bounded sample (``queries`` vectors, smallest hashes), each held against all rows.

    The audit of :func:`near_vectors`: recall is the sum of ``n_links`` over that of ``true_links``.
    """
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), unit_vector(F.col(vector)).alias("u"))
    base = base.filter("vec_id IS NOT NULL AND u IS NOT NULL")
    once = base.groupBy("vec_id").agg(F.count("*").alias("n"), F.first("u").alias("u")).filter("n = 1")
    asked = once.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).collect()
    by_width: dict[int, list] = {}
    for r in asked:
        by_width.setdefault(len(r.u), []).append(r)
    wanted = {w: ([r.vec_id for r in rs], np.array([r.u for r in rs])) for w, rs in by_width.items()}

    def count(batches):
        tally: dict[int, int] = {}
        for batch in parts(batches, 4096):
            by: dict[int, list] = {}
            for u in batch.column("u").to_pylist():
                by.setdefault(len(u), []).append(u)
            for width, us in by.items():
                ids, q = wanted.get(width, ([], None))
                if ids:
                    near = np.count_nonzero(q @ np.array(us).T >= least, axis=1)
                    for k, n in zip(ids, near.tolist()):
                        tally[k] = tally.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.int64()), pa.array(tally.values(), pa.int64())], ["vec_id", "n"])

    counted = base.select("u").mapInArrow(count, "vec_id long, n long")
    return counted.groupBy("vec_id").agg((F.sum("n") - 1).alias("true_links"))
