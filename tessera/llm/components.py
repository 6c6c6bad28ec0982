"""Connected components of an edge table that no single task can hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Steps that a vertex follows in one round, as a power of two.
DOUBLINGS = 2


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def link(self, a: int, b: int) -> bool:
        """Whether the two were apart before."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning_forest(edges: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """Fewer edges with the same components: each task keeps those that join something in its own split.

    A task forgets what it knows after ``flush`` kept edges, which bounds its memory.
    """

    def keep(batches):
        forest, kept = Forest(), 0
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            mask = np.fromiter((forest.link(x, y) for x, y in zip(a, b)), bool, len(a))
            kept += int(mask.sum())
            if kept > flush:
                forest, kept = Forest(), 0
            yield batch.filter(pa.array(mask))

    return edges.mapInArrow(keep, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, component_id`` of every vertex of ``edges`` (columns ``a, b``): the smallest vertex it reaches.

    Each round sends every vertex to its smallest neighbour, itself included, follows that step four times
    and contracts: the edges are renamed, loops and repeats go. The smallest vertex of a component never
    moves, and all others end there; a chain in the worst order is a quarter as long after a round.
    All steps are joins and combinable minima; each round is a table in the shared folder, so a lost
    executor costs one round at most. Self-loops and repeated edges are allowed; no edges, no rows.
    """
    left = scratch.cut(_clean(edges), "edges-0")
    names: DataFrame | None = None
    k = 0
    while left.take(1):
        k += 1
        both = left.select("a", "b").union(left.select("b", "a")).toDF("id", "to")
        nearest = both.groupBy("id").agg(F.min("to").alias("to"))
        moved = scratch.cut(nearest.select("id", F.least("id", "to").alias("to")), f"near-{k}")
        for _ in range(DOUBLINGS):
            moved = _follow(moved, moved)
        moved = scratch.cut(moved, f"moved-{k}")
        names = scratch.cut(_follow(names, moved), f"names-{k}")
        if k > 1:
            scratch.drop(f"names-{k - 1}")
        a = moved.select(F.col("id").alias("a"), F.col("to").alias("x"))
        b = moved.select(F.col("id").alias("b"), F.col("to").alias("y"))
        renamed = left.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        # a vertex goes to its nearest one, which may have gone on itself: that step is an edge still
        chain = moved.filter("id <> to").select(F.col("to").alias("a")).join(a, "a").select("a", F.col("x").alias("b"))
        left = scratch.cut(_clean(renamed.union(chain)), f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
    if names is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).limit(0)
    return names.select("id", F.col("to").alias("component_id"))


def _clean(edges: DataFrame) -> DataFrame:
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.distinct()


def _follow(names: DataFrame | None, moved: DataFrame) -> DataFrame:
    """Names of all vertices so far after one more move."""
    if names is None:
        return moved
    step = moved.select(F.col("id").alias("to"), F.col("to").alias("next"))
    return names.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
