"""Model usage and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# US dollars for a million tokens in, out, and in from a cache; the first name that a model begins with holds.
PRICES = (
    ("gemini-2.5-flash", 0.30, 2.50, 0.075),
    ("gemini-2.5-flash-lite", 0.10, 0.40, 0.025),
    ("gemini-3.7-flash", 0.375, 1.875, 0.09),
    ("gemini-3.6-flash", 0.75, 3.75, 0.1875),
    ("gemini-2.0-flash", 0.10, 0.40, 0.025),
)
DEFAULT_PRICE = (0.30, 2.50, 0.075)
LOCAL = ("local/", "ollama/", "mlx/")


def is_local(model: Column) -> Column:
    out = F.lit(False)
    for prefix in LOCAL:
        out = out | model.startswith(prefix)
    return out


def price(model: Column, part: int) -> Column:
    """One of the three rates of a model; local ones are free, unknown ones have the default."""
    out = F.when(is_local(model), 0.0)
    for row in PRICES:
        out = out.when(model.startswith(row[0]), row[1 + part])
    return out.otherwise(DEFAULT_PRICE[part])


def is_known(model: Column) -> Column:
    out = is_local(model)
    for row in PRICES:
        out = out | model.startswith(row[0])
    return out


def cost(model: Column, in_tokens: Column, out_tokens: Column, cached: Column) -> Column:
    fresh = F.greatest(F.lit(0), in_tokens - cached)
    cached_rate = F.when(price(model, 2) != 0, price(model, 2)).otherwise(price(model, 0))
    return (fresh * price(model, 0) + cached * cached_rate + out_tokens * price(model, 1)) / 1e6


def ledger(calls: DataFrame) -> DataFrame:
    """Totals by model, dearest first. ``calls``: ``model, in_tokens, out_tokens, cached_tokens``. Merging ledgers is the union of their calls or totals."""
    n = (F.col("calls") if "calls" in calls.columns else F.lit(1)).cast("bigint")
    g = calls.withColumn("n", n).groupBy("model").agg(F.sum("n").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.sum("cached_tokens").alias("cached_tokens"))
    g = g.withColumns({"cost_usd": F.round(cost(F.col("model"), F.col("in_tokens"), F.col("out_tokens"), F.col("cached_tokens")), 6), "local": is_local(F.col("model")), "estimated": ~is_known(F.col("model")), "cache_hit_pct": F.when(F.col("in_tokens") > 0, F.round(100 * F.col("cached_tokens") / F.col("in_tokens"), 1)).otherwise(0.0)})
    return g.orderBy(F.desc("cost_usd"), "model")


def totals(led: DataFrame) -> DataFrame:
    paid = ~F.col("local")
    return led.agg(F.sum("calls").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.sum(F.when(paid, F.col("in_tokens")).otherwise(0)).alias("paid_in"), F.sum(F.when(paid, F.col("out_tokens")).otherwise(0)).alias("paid_out"), F.sum(F.when(paid, 0).otherwise(F.col("in_tokens"))).alias("local_in"), F.sum(F.when(paid, 0).otherwise(F.col("out_tokens"))).alias("local_out"))


def job_totals(units: DataFrame) -> DataFrame:
    """Units that needed no model, flagged, and enriched ones; percentages half to even."""
    n = F.count("*")
    flagged = F.coalesce(F.size("escalation_flags"), F.lit(0)) > 0
    return units.agg(n.alias("units"), F.coalesce(F.bround(100 * F.count_if(F.coalesce("tier", F.lit(0)) == 0) / n).cast("int"), F.lit(0)).alias("tier0_pct"), F.count_if(flagged).alias("flagged"), F.count_if(F.coalesce(F.col("situating_summary"), F.lit("")) != "").alias("enriched"))
