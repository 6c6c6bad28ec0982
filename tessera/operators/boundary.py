"""Boundary candidates between neighbouring elements: signals, vetoes and their score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import count_tokens, is_question
from tessera.operators.graph import reading, separation


@dataclass(frozen=True)
class Weights:
    """What each signal counts for; the defaults are fixed values."""

    structure: float = 1.2
    semantic: float = 1.0
    temporal: float = 1.0
    visual: float = 0.9
    ocr: float = 0.8
    graph: float = 0.8
    consensus: float = 1.1
    loss: float = 1.5
    fragmentation: float = 0.6
    shot: float = 0.35
    speaker_boundary: float = 0.55


SIGNALS = ("structural_strength", "list_continuation", "temporal_gap", "speaker_change", "pause_strength", "visual_change", "scene_change", "ocr_change", "qa_transition", "graph_separation", "semantic_shift", "multimodal_consensus")


def candidates(elements: DataFrame, edges: DataFrame, weights: Weights = Weights(), counter=count_tokens, shifts: DataFrame | None = None) -> DataFrame:
    """A row for every element but a document's first: the boundary before it.

    ``doc_id, pos, left_id, right_id``, the SIGNALS (null where absent), ``tokens_before``, ``vetoes``,
    ``reason``, ``is_hard``, ``is_soft`` and ``base_score``, which leaves out what depends on the region (the
    loss and the distance from the target). Neighbours come from windows over the document; edges are joined.
    """
    before = ["id", "kind", "text", "t0", "t1", "speaker", "visual_summary", "scene", "visual_change_type", "ocr_text", "asks"]
    # what is wanted of a text, so that no whole one is shuffled
    e = elements.withColumns({"tokens": counter(F.col("text")), "asks": is_question(F.col("text")), "text": F.substring("text", 1, 60)})
    e = e.select("doc_id", "pos", "tokens", "level", *before, *[F.lag(c).over(reading()).alias(f"b_{c}") for c in before], F.sum("tokens").over(reading().rowsBetween(Window.unboundedPreceding, -1)).alias("tokens_before")).filter("b_id IS NOT NULL")
    capped = edges.filter("type = 'captions'").select("doc_id", F.col("src").alias("b_id"), F.col("dst").alias("id"))
    capped = capped.unionByName(capped.select("doc_id", F.col("id").alias("b_id"), F.col("b_id").alias("id"))).withColumn("capped", F.lit(True))
    e = e.join(capped.distinct(), ["doc_id", "b_id", "id"], "left").join(separation(elements, edges), ["doc_id", "pos"], "left")
    if shifts is not None:
        e = e.join(shifts.select("doc_id", "pos", "semantic_shift"), ["doc_id", "pos"], "left")
    else:
        e = e.withColumn("semantic_shift", F.lit(None).cast("double"))

    c = F.col
    heading, was_heading = c("kind") == "heading", c("b_kind") == "heading"
    level = F.coalesce(F.when(c("level") > 0, c("level")), F.lit(1))
    timed = c("b_t1").isNotNull() & c("t0").isNotNull()
    gap = F.greatest(F.lit(0.0), c("t0") - c("b_t1"))
    other_voice = timed & c("b_speaker").isNotNull() & c("speaker").isNotNull() & (c("b_speaker") != c("speaker"))
    change = F.coalesce(F.when(c("visual_change_type") != "", c("visual_change_type")), F.when(c("b_visual_change_type") != "", c("b_visual_change_type")))
    sight = lambda p: F.coalesce(F.when(c(f"{p}visual_summary") != "", c(f"{p}visual_summary")), F.when(c(f"{p}scene") != "", c(f"{p}scene")))
    visual = F.when(change == "shot", weights.shot).when(change.isin("scene", "slide", "event"), 0.85).when(sight("b_").isNotNull() & sight("").isNotNull() & (sight("b_") != sight("")), 0.85)
    e = e.withColumns({
        "structural_strength": F.when(heading, F.greatest(F.lit(0.6), 1.0 - (level - 1) * 0.15)),
        "list_continuation": F.when((c("kind") == "list_item") & (c("b_kind") == "list_item"), 1.0),
        "temporal_gap": F.when(timed, F.least(F.lit(1.0), gap / 3.0)),
        "speaker_change": F.when(other_voice, 1.0),
        "pause_strength": F.when(timed & ~other_voice & (gap >= 2.0), F.least(F.lit(1.0), gap / 5.0)),
        "visual_change": visual,
        "scene_change": F.when(c("kind") == "visual_event", 0.95),
        "ocr_change": F.when((c("b_ocr_text") != "") & (c("ocr_text") != "") & (c("b_ocr_text") != c("ocr_text")), 0.80),
        "qa_transition": F.when(c("b_asks"), 0.90),
        "is_hard": F.coalesce(heading & (level <= 2), F.lit(False)),
        "gap": gap,
    })
    seen = F.when(F.coalesce(c("visual_change"), F.lit(0.0)) != 0, c("visual_change")).otherwise(c("scene_change"))
    strong = lambda x: F.coalesce((x > 0.5).cast("int"), F.lit(0))
    agree = strong(c("speaker_change")) + strong(seen) + strong(c("temporal_gap")) + strong(c("ocr_change")) + strong(c("structural_strength")) + strong(c("semantic_shift")) + strong(c("pause_strength"))
    e = e.withColumn("multimodal_consensus", F.when(agree >= 2, F.least(F.lit(1.0), 0.4 + agree * 0.2)))
    z = lambda name: F.coalesce(c(name), F.lit(0.0))
    score = (
        weights.structure * z("structural_strength") + weights.semantic * z("semantic_shift") + weights.temporal * (z("speaker_change") + z("temporal_gap") + z("pause_strength"))
        + weights.visual * (z("visual_change") + z("scene_change")) + weights.ocr * z("ocr_change") + weights.graph * F.coalesce(c("graph_separation"), F.lit(0.5))
        + weights.consensus * z("multimodal_consensus") - F.when(z("list_continuation") > 0, 0.5).otherwise(0.0)
    )
    strands = F.when(was_heading & ~heading, F.concat(F.lit("would strand heading '"), F.substring("b_text", 1, 60), F.lit("' at chunk boundary")))
    pair = F.when(c("capped") & (((c("b_kind") == "caption") & c("kind").isin("table", "figure")) | ((c("kind") == "caption") & c("b_kind").isin("table", "figure"))), F.concat(F.lit("would sever caption pair: CAPTIONS "), F.when(c("b_kind") == "caption", c("b_id")).otherwise(c("id")), F.lit(" ↔ "), F.when(c("b_kind") == "caption", c("id")).otherwise(c("b_id"))))
    reasons = F.array_compact(F.array(
        F.when(heading, F.concat(F.lit("heading transition to '"), F.substring("text", 1, 40), F.lit("' (level "), level.cast("string"), F.lit(")"))),
        F.when(other_voice, F.concat(F.lit("speaker change ("), "b_speaker", F.lit(" → "), "speaker", F.lit(")"))),
        F.when(c("pause_strength").isNotNull(), F.format_string("pause duration %.1fs", "gap")),
        F.when(change == "shot", F.lit(f"shot change (camera cut only, weight={weights.shot})")).when(change.isin("scene", "slide", "event"), F.concat(F.lit("visual "), change, F.lit(" transition"))).when(c("visual_change").isNotNull(), F.concat(F.lit("visual scene transition ('"), F.substring(sight("b_"), 1, 30), F.lit("' → '"), F.substring(sight(""), 1, 30), F.lit("')"))),
        F.when(c("scene_change").isNotNull(), F.lit("visual event boundary")),
        F.when(c("ocr_change").isNotNull(), F.lit("OCR slide text change")),
        F.when(c("qa_transition").isNotNull(), F.lit("question-answer transition")),
        F.when(agree >= 2, F.concat(F.lit("multimodal agreement ("), agree.cast("string"), F.lit(" independent signals)"))),
    ))
    soft = (heading & (level > 2)) | c("list_continuation").isNotNull() | other_voice | c("pause_strength").isNotNull() | c("scene_change").isNotNull()
    return e.select(
        "doc_id", "pos", F.col("b_id").alias("left_id"), F.col("id").alias("right_id"), F.col("t0").alias("timestamp"), "tokens", "tokens_before", *SIGNALS,
        F.array_compact(F.array(strands, pair)).alias("vetoes"), F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("paragraph boundary").alias("reason"),
        "is_hard", F.coalesce(soft, F.lit(False)).alias("is_soft"), score.alias("base_score"),
    )


def signals_map(places: int = 4) -> Column:
    """The signals that are there, rounded, as a map."""
    return F.map_filter(F.create_map(*[x for s in SIGNALS for x in (F.lit(s), F.round(F.col(s).cast("double"), places))]), lambda _, v: v.isNotNull())


def best_cuts(regions: DataFrame, cands: DataFrame, losses: DataFrame, target: int = 500, weights: Weights = Weights()) -> DataFrame:
    """The best first cut of every region that has a legal one: ``doc_id, region, pos, score, loss``.

    ``regions`` maps elements (``doc_id, pos, tokens``) to a ``region``; ``losses`` are those of the whole
    region, as they are when it is first cut. A cut that a veto or a loss of 1 or more forbids is out; of the
    best scores the earliest wins.
    """
    inside = Window.partitionBy("doc_id", "region").orderBy("pos")
    r = regions.select("doc_id", "pos", "region", F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("dist"), F.row_number().over(inside).alias("k"))
    scored = r.filter("k > 1").join(cands.select("doc_id", "pos", "base_score", "vetoes"), ["doc_id", "pos"]).join(losses, ["doc_id", "pos"], "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))
    scored = scored.withColumn("score", F.col("base_score") - weights.loss * F.col("loss") - weights.fragmentation * F.abs(F.col("dist") - target) / F.lit(float(max(1, target))))
    legal = scored.filter((F.size("vetoes") == 0) & (F.col("loss") < 1.0))
    return legal.groupBy("doc_id", "region").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("pos")).alias("p"), "loss")).alias("b")).select("doc_id", "region", (-F.col("b.p")).alias("pos"), "b.score", "b.loss")
