"""Document profiles and the route to a chunking strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import count_tokens
from tessera.schema import TEXT_KINDS


def build_profile(elements: DataFrame, counter=count_tokens) -> DataFrame:
    """One row a document: counts, density, whether it is timed or tabular. One aggregation, combined before the shuffle."""
    tokens = counter(F.col("text"))
    of = lambda *kinds: F.col("kind").isin(*kinds)
    grid = F.when(of("table"), F.size("grid"))
    out = elements.select("doc_id", "kind", "pos", "text", "t0", "grid", tokens.alias("tokens")).groupBy("doc_id").agg(
        F.count("*").alias("element_count"),
        F.count_if(of(*TEXT_KINDS)).alias("text_element_count"),
        F.count_if(of("heading")).alias("heading_count"),
        F.count_if(of("table")).alias("table_count"),
        F.count_if(of("figure")).alias("figure_count"),
        F.bool_or(F.col("t0").isNotNull()).alias("has_timestamps"),
        F.coalesce(F.bool_or(of("table") & (F.coalesce(grid, F.lit(0)) > 0)), F.lit(False)).alias("has_grid"),
        F.coalesce(F.sum(F.when(of("table"), F.col("tokens"))), F.lit(0)).alias("table_tokens"),
        F.coalesce(F.sum(F.when(of("paragraph", "list_item"), F.col("tokens"))), F.lit(0)).alias("prose_tokens"),
        F.sum("tokens").alias("total_tokens"),
        F.coalesce(F.sum(F.when(grid > 0, grid - 1)), F.lit(0)).alias("row_count"),
        F.coalesce(F.max(F.when(grid > 0, F.size(F.get("grid", F.lit(0))))), F.lit(0)).alias("column_count"),
        F.min_by("text", F.when(of("heading"), F.col("pos"))).alias("first_heading"),
    )
    tabular = F.col("has_grid") & (F.col("table_tokens") > 0) & (F.col("table_tokens") >= 4 * F.col("prose_tokens"))
    return out.withColumn("heading_density", F.col("heading_count") / F.greatest(F.col("text_element_count"), F.lit(1))).withColumn("is_tabular", tabular)


def route_of(embedder: bool = False) -> Column:
    """The strategy: the first rule that holds."""
    return (
        F.when(F.col("has_timestamps"), "temporal")
        .when(F.col("is_tabular"), "tabular")
        .when((F.col("heading_count") >= 3) & (F.col("heading_density") >= 0.03), "structural")
        .otherwise("semantic" if embedder else "paragraph_fallback")
    )


def route(profile: DataFrame, embedder: bool = False) -> DataFrame:
    """``profile`` with ``route`` and ``route_reason``."""
    tables = F.when(F.col("table_count") == 1, "sheet").otherwise("sheets")
    reason = (
        F.when(F.col("has_timestamps"), "elements carry timestamps")
        .when(F.col("is_tabular"), F.format_string("%,d rows × %d columns over %d %s — the input is a dataset", "row_count", "column_count", "table_count", tables))
        .when((F.col("heading_count") >= 3) & (F.col("heading_density") >= 0.03), F.format_string("%d headings over %d text elements (density %.2f)", "heading_count", "text_element_count", "heading_density"))
        .otherwise("no usable headings — paragraphs are grouped by topic" if embedder else "no usable headings and no embedder — paragraphs are packed")
    )
    return profile.withColumn("route", route_of(embedder)).withColumn("route_reason", reason)


def actual_route(routed: DataFrame, used: DataFrame) -> DataFrame:
    """``routed`` with the strategy that units came out with (``doc_id, strategy``), told where it differs."""
    out = routed.join(used.groupBy("doc_id").agg(F.min("strategy").alias("route_actual")), "doc_id", "left").withColumn("route_actual", F.coalesce("route_actual", "route"))
    fell = F.concat("route_reason", F.lit(" (fell back to "), "route_actual", F.lit(")"))
    return out.withColumn("route_reason", F.when(F.col("route_actual") != F.col("route"), fell).otherwise(F.col("route_reason")))


def titles(elements: DataFrame, titled: DataFrame | None = None) -> DataFrame:
    """``doc_id, title``: the given one (``titled``), else the first heading."""
    first = elements.filter("kind = 'heading'").groupBy("doc_id").agg(F.min_by("text", "pos").alias("heading"))
    docs = elements.select("doc_id").distinct().join(first, "doc_id", "left")
    if titled is None:
        return docs.select("doc_id", F.col("heading").alias("title"))
    return docs.join(titled.select("doc_id", "title"), "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("title") != "", F.col("title")), "heading").alias("title"))
