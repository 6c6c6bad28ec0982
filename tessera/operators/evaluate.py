"""Scores of units against the fixed-window baseline, and of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import norm

# The edges that a cut should not sever, and strategies whose boundaries are sound by themselves.
CRITICAL = ("captions", "captioned_by", "parent", "has_schema", "schema_of", "answered_by", "explains")
SOUND = ("structural", "atomic", "tabular", "temporal")


def probes(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """What should stay together: ``doc_id, metric, probe_id, probe, context``; normalised texts.

    ``caption integrity`` asks for a table's caption where its first row is, ``header integrity`` for its
    header where any row is, ``heading context`` for a paragraph's heading, ``resolved references`` for the
    text of the float that prose names.
    """
    e = elements
    line = lambda r: F.substring(norm(F.array_join(r, " ")), 1, 60)
    tables = e.filter("kind = 'table'").select("doc_id", "id", F.coalesce("grid", F.array().cast("array<array<string>>")).alias("grid"), line(F.coalesce("header_row", F.array().cast("array<string>"))).alias("header"))
    rows = F.filter(F.transform(F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0))), line), lambda p: F.length(p) > 15)
    t = tables.withColumn("rows", rows)
    caps = edges.filter("type = 'captions'").join(e.select("doc_id", F.col("id").alias("src"), F.col("text").alias("cap"), F.col("pos").alias("cp")), ["doc_id", "src"])
    caps = caps.groupBy("doc_id", F.col("dst").alias("id")).agg(F.substring(norm(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cp", "cap"))), lambda x: x["cap"]), " ")), 1, 60).alias("caption"))
    tc = t.join(caps, ["doc_id", "id"], "left")
    body = F.coalesce(F.get("rows", F.lit(0)), F.col("header"))
    caption = tc.filter((F.col("caption") != "") & (body != "")).select("doc_id", F.lit("caption integrity").alias("metric"), F.col("id").alias("probe_id"), body.alias("probe"), F.col("caption").alias("context"))
    header = t.filter((F.col("header") != "") & (F.size("rows") > 0)).select("doc_id", F.lit("header integrity").alias("metric"), F.col("id").alias("probe_id"), F.explode("rows").alias("probe"), F.col("header").alias("context"))
    heads = e.filter("kind = 'heading'").select("doc_id", F.col("id").alias("parent_id"), F.substring(norm(F.col("text")), 1, 60).alias("context"))
    heading = e.filter("kind = 'paragraph' AND length(text) >= 60").join(heads, ["doc_id", "parent_id"]).select("doc_id", F.lit("heading context").alias("metric"), F.col("id").alias("probe_id"), F.substring(norm(F.col("text")), 1, 80).alias("probe"), "context")
    said = edges.filter("type = 'references'").join(e.filter(F.col("kind").isin("paragraph", "list_item")).select("doc_id", F.col("id").alias("src"), F.substring(norm(F.col("text")), 1, 80).alias("probe")), ["doc_id", "src"])
    first = e.select("doc_id", F.col("id").alias("dst"), F.when(F.size("grid") > 0, line(F.get("grid", F.lit(0)))).alias("top"))
    refs = said.join(first, ["doc_id", "dst"]).join(caps.withColumnRenamed("id", "dst"), ["doc_id", "dst"], "left").withColumn("context", F.coalesce(F.nullif("top", F.lit("")), "caption"))
    refs = refs.filter("context <> ''").select("doc_id", F.lit("resolved references").alias("metric"), F.concat_ws(">", "src", "dst").alias("probe_id"), "probe", "context")
    return caption.unionByName(header).unionByName(heading).unionByName(refs)


def arm_tally(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """``metric, preserved, total`` of an arm, whose ``chunks`` are ``doc_id, chunk, text`` and optional ``context_text``, ``has_reference``.

    A probe is held against the chunks of its own document. A header must be in every chunk that bears a
    row, other context in one that has the probe.
    """
    c = chunks.select("doc_id", "chunk", norm(F.col("text")).alias("n"), (norm(F.col("context_text")) if "context_text" in chunks.columns else F.lit("")).alias("around"), (F.col("has_reference") if "has_reference" in chunks.columns else F.lit(False)).alias("ref"))
    met = asked.join(c, "doc_id", "left").withColumn("bears", F.coalesce((F.col("probe") != "") & F.col("n").contains(F.col("probe")), F.lit(False)))
    ok = F.col("n").contains(F.col("context")) | (F.col("metric").isin("heading context") & F.col("around").contains(F.col("context"))) | ((F.col("metric") == "resolved references") & F.col("ref"))
    each = met.groupBy("metric", "doc_id", "probe_id").agg(F.bool_or("bears").alias("found"), F.bool_or(F.col("bears") & ok).alias("some"), F.bool_and(~F.col("bears") | ok).alias("every"))
    kept = F.col("found") & F.when(F.col("metric") == "header integrity", F.col("every")).otherwise(F.col("some"))
    return each.groupBy("metric").agg(F.count_if(kept).alias("preserved"), F.count("*").alias("total"))


def context_score(tally: DataFrame) -> DataFrame:
    """The mean of the metrics' shares in percent; null if nothing was measured."""
    return tally.agg(F.round(100 * F.avg(F.when(F.col("total") > 0, F.col("preserved") / F.col("total"))), 1).alias("cps_pct"))


def unit_metrics(units: DataFrame, least: int = 40) -> DataFrame:
    """Coherence, completeness, fragmentation and size deviation of all units in one pass."""
    sig = lambda k: F.coalesce(F.element_at("signals", F.lit(k)), F.lit(0.0))
    coherent = F.col("strategy").isin(*SOUND) | (sig("semantic_shift") > 0.3) | (sig("speaker_change") > 0.5) | F.coalesce(F.col("element_kind").isin("table", "figure", "schema_card", "section"), F.lit(False)) | (F.coalesce(F.size("vetoed_cuts"), F.lit(0)) > 0)
    small = (F.col("token_count") < least) & ~F.coalesce(F.col("element_kind").isin("figure", "caption"), F.lit(False))
    return units.agg(
        F.count("*").alias("n_units"), F.when(F.count("*") <= 1, 1.0).otherwise(F.round(F.avg(coherent.cast("double")), 3)).alias("coherence"), F.coalesce(F.round(F.avg(F.coalesce("context_completeness", F.lit(1.0))), 3), F.lit(0.0)).alias("completeness"),
        F.coalesce(F.round(F.avg(small.cast("double")), 3), F.lit(0.0)).alias("fragmentation"), F.when(F.count("*") <= 1, 0.0).otherwise(F.round(F.stddev_pop("token_count"), 2)).alias("size_deviation"),
    )


def preservation(elements: DataFrame, edges: DataFrame, units: DataFrame) -> DataFrame:
    """The share of critical edges whose ends share a unit, lie in linked units, or weren't both found."""
    start = elements.filter("text <> ''").select("doc_id", "id", F.substring("text", 1, 50).alias("start"))
    at = start.join(units.select("doc_id", "seq", F.col("id").alias("unit"), "content"), "doc_id").filter(F.col("content").contains(F.col("start"))).groupBy("doc_id", "id").agg(F.min_by("unit", "seq").alias("unit"))
    linked = units.select("doc_id", F.col("id").alias("su"), F.explode("relationships").alias("r")).select("doc_id", "su", F.col("r.target_id").alias("du")).distinct().withColumn("linked", F.lit(True))
    c = edges.filter(F.col("type").isin(*CRITICAL)).join(at.toDF("doc_id", "src", "su"), ["doc_id", "src"], "left").join(at.toDF("doc_id", "dst", "du"), ["doc_id", "dst"], "left").join(linked, ["doc_id", "su", "du"], "left")
    ok = F.col("su").isNull() | F.col("du").isNull() | (F.col("su") == F.col("du")) | F.coalesce("linked", F.lit(False))
    return c.agg(F.coalesce(F.round(F.avg(ok.cast("double")), 3), F.lit(1.0)).alias("preservation"), F.count("*").alias("n_edges"))


def retrieval(units: DataFrame, queries: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, hits, recall, precision, reciprocal_rank`` by shared words.

    ``units`` is ``unit_id, seq, text``, ``queries`` ``query_id, text``, ``relevant`` ``query_id, unit_id``. Both
    sides are filed under their distinct words, so a query meets the units that share a word with it; those
    that share none rank behind all others and are counted, not listed.
    """
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(norm(c), " ", -1), lambda w: w != "")))
    u = units.select("unit_id", "seq", words(F.col("text")).alias("word"))
    q = queries.select("query_id", words(F.col("text")).alias("word"))
    scores = q.join(u, "word").groupBy("query_id", "unit_id", "seq").agg(F.count("*").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    # a query's first k may need units that share no word: the first of all units in order fill up
    filled = queries.select("query_id").join(F.broadcast(units.select("unit_id", "seq").orderBy("seq").limit(2 * k)))
    rest = filled.join(scores.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_anti").join(scores.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    rest = rest.withColumn("rank", F.coalesce("n", F.lit(0)) + F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))).filter(F.col("rank") <= k)
    top = ranked.filter(F.col("rank") <= k).select("query_id", "unit_id").unionByName(rest.select("query_id", "unit_id"))
    hits = top.join(relevant, ["query_id", "unit_id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    best = ranked.join(relevant, ["query_id", "unit_id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    n = relevant.groupBy("query_id").agg(F.count_distinct("unit_id").alias("n_relevant"))
    out = queries.select("query_id").join(hits, "query_id", "left").join(best, "query_id", "left").join(n, "query_id", "left")
    hit = F.coalesce("hits", F.lit(0))
    return out.select("query_id", hit.alias("hits"), (hit / F.greatest(F.coalesce("n_relevant", F.lit(0)), F.lit(1))).alias("recall"), (hit / F.lit(max(1, k))).alias("precision"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_summary(each: DataFrame) -> DataFrame:
    return each.agg(*[F.coalesce(F.round(F.avg(c), 3), F.lit(0.0)).alias(n) for c, n in (("recall", "recall_at_k"), ("precision", "precision_at_k"), ("reciprocal_rank", "mrr"))])
