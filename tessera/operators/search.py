"""Vector search and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """The dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search_units(vectors: DataFrame, query: list[float], k: int = 5, by: str = "id") -> DataFrame:
    """The ``k`` nearest by dot product; each task sends k rows, whatever the table's size."""
    return vectors.select(by, dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])).alias("score")).orderBy(F.desc("score"), by).limit(k)


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 5, by: str = "id", most_queries: int = 10_000) -> DataFrame:
    """The ``k`` nearest to each of a bounded number of queries (``query_id, vector``): ``query_id, id, score, rank``.

    Queries are sent to where the vectors are; more than ``most_queries`` are refused, which is what bounds
    what is broadcast. Ranks are pruned in every task before rows are shuffled.
    """
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries: ask in parts")
    q = queries.select("query_id", F.col("vector").alias("q"))
    scored = vectors.select(by, "vector").join(F.broadcast(q)).select("query_id", by, dot("vector", "q").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), by)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def adjacent_drift(vectors: DataFrame, key: str, order: str) -> DataFrame:
    """The cosine of each unit vector and the one before within ``key``."""
    w = Window.partitionBy(key).orderBy(order)
    return vectors.select(key, order, dot(F.col("vector"), F.lag("vector").over(w)).alias("similarity")).filter("similarity IS NOT NULL")
