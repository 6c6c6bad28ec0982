"""Timed elements: speaker turns, event windows, fusion of speech and visuals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import QUESTION, count_tokens
from tessera.operators.boundary import SIGNALS, Weights, candidates

MICRO_TURN, LONG_TURN = 3.0, 120.0
# What is said when something is assigned, decided or asked.
ACTION = r"(?i)\b(action item|to-?do|will follow up|assign(ed)? to|take the lead on|action point)\b"
DECISION = r"(?i)\b(we (agreed|decided|concluded)|decision (is|was)|let's (go with|move forward with|adopt)|consensus is|approved)\b"
VISUAL_KINDS = ("visual_event", "figure", "slide")


def by_time() -> Window:
    return Window.partitionBy("doc_id").orderBy("t0", "t1", "pos")


def speaker_runs(timed: DataFrame, order: Window | None = None) -> DataFrame:
    """``timed`` with ``run``: a new one at every change of speaker, unknown being equal to unknown."""
    order = order or Window.partitionBy("doc_id").orderBy("pos")
    new = F.coalesce(~F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) & F.lag("pos").over(order).isNotNull(), F.lit(False))
    return timed.withColumn("run", F.sum(new.cast("int")).over(order).cast("int"))


def run_spans(runs: DataFrame) -> DataFrame:
    """One row a run: ``doc_id, run, first_pos, last_pos, speaker, t0, t1, n``."""
    return runs.groupBy("doc_id", "run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("speaker", "pos").alias("speaker"), F.coalesce(F.min_by("t0", "pos"), F.lit(0.0)).alias("t0"), F.coalesce(F.max_by(F.coalesce("t1", F.lit(0.0)), "pos"), F.lit(0.0)).alias("t1"), F.count("*").alias("n"))


def merge_micro_turns(runs: DataFrame, micro: float = MICRO_TURN) -> DataFrame:
    """``runs`` with ``turn``: a short run joins the turn before if it is unattributed or of the last voice heard there.

    Each decision depends on the ones before, so the runs of a document (not its elements) are walked once,
    with one speaker carried along.
    """
    spans = run_spans(runs).select("doc_id", "run", "speaker", (F.col("t1") - F.col("t0")).alias("dur"))
    listed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("run", "speaker", "dur"))).alias("l"))

    def walk(batches):
        for pdf in batches:
            out = []
            for doc, rows in zip(pdf["doc_id"], pdf["l"]):
                turn, voice = -1, None
                for r in rows:
                    if turn < 0 or not (r["dur"] < micro and (r["speaker"] is None or r["speaker"] == voice)):
                        turn += 1
                    voice = r["speaker"]
                    out.append((doc, r["run"], turn))
            yield pd.DataFrame(out, columns=["doc_id", "run", "turn"])

    turns = listed.mapInPandas(walk, "doc_id long, run int, turn int")
    return runs.join(turns, ["doc_id", "run"])


def split_points(pos: list[int], t0: list[float], t1: list[float], most: float) -> list[int]:
    """Places where a long turn is cut: at its largest gap, the latest of equals, and so on within both sides."""
    cuts, todo = [], [(0, len(pos))]
    while todo:
        a, b = todo.pop()
        if b - a < 2 or (t1[b - 1] or 0) - (t0[a] or 0) <= most:
            continue
        cut = max(range(a + 1, b), key=lambda k: ((t0[k] or 0) - (t1[k - 1] or 0), k))
        cuts.append(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(cuts)


def split_long_turns(turns: DataFrame, most: float = LONG_TURN) -> DataFrame:
    """``turns`` with ``span``: turns of more than ``most`` seconds are cut at pauses."""
    listed = turns.groupBy("doc_id", "turn").agg(F.sort_array(F.collect_list(F.struct("pos", "t0", "t1"))).alias("l"))

    def walk(batches):
        for pdf in batches:
            out = []
            for doc, turn, rows in zip(pdf["doc_id"], pdf["turn"], pdf["l"]):
                cuts = split_points([r["pos"] for r in rows], [r["t0"] for r in rows], [r["t1"] for r in rows], most)
                part = 0
                for k, r in enumerate(rows):
                    part += k in cuts
                    out.append((doc, turn, r["pos"], part))
            yield pd.DataFrame(out, columns=["doc_id", "turn", "pos", "span"])

    spans = listed.mapInPandas(walk, "doc_id long, turn int, pos int, span int")
    return turns.join(spans, ["doc_id", "turn", "pos"])


def largest_pause(turns: DataFrame) -> DataFrame:
    """The first cut of each turn: ``doc_id, turn, pos, gap``, the latest of the largest gaps."""
    w = Window.partitionBy("doc_id", "turn").orderBy("pos")
    gaps = turns.select("doc_id", "turn", "pos", (F.coalesce("t0", F.lit(0.0)) - F.lag(F.coalesce("t1", F.lit(0.0))).over(w)).alias("gap")).filter("gap IS NOT NULL")
    return gaps.groupBy("doc_id", "turn").agg(F.max(F.struct("gap", "pos")).alias("b")).select("doc_id", "turn", "b.pos", "b.gap")


def classify(members: Column) -> Column:
    """The type of a dialogue from its elements in order (``array<struct<pos,text,speaker>>``)."""
    text = F.array_join(F.transform(members, lambda m: m["text"]), " ")
    voices = F.array_distinct(F.filter(F.transform(members, lambda m: m["speaker"]), lambda s: s.isNotNull() & (s != "")))
    but_last = F.slice(members, 1, F.greatest(F.size(members) - 1, F.lit(0)))
    asked = F.exists(but_last, lambda m: m["text"].rlike(QUESTION) | m["text"].rlike(r"(?md)\?$"))
    return (
        F.when(text.rlike(ACTION), "action_item").when(text.rlike(DECISION), "decision").when(asked & (F.size(voices) > 1), "question_answer")
        .when(F.size(voices) > 1, "discussion").when(F.size(voices) > 0, "speaker_turn").otherwise("narrative")
    )


def in_order(*fields: str, by: str = "pos") -> Column:
    return F.sort_array(F.collect_list(F.struct(by, *[f for f in fields if f != by])))


def classify_dialogues(timed: DataFrame, key: list[str]) -> DataFrame:
    """``key, unit_type, participants, n_turns`` of each group of elements."""
    grouped = timed.groupBy(*key).agg(in_order("text", "speaker").alias("m"))
    voices = F.array_distinct(F.filter(F.transform("m", lambda x: x["speaker"]), lambda s: s.isNotNull() & (s != "")))
    return grouped.select(*key, classify(F.col("m")).alias("unit_type"), voices.alias("participants"), F.size("m").alias("n_turns"))


def temporal_units(elements: DataFrame, micro: float = MICRO_TURN, most: float = LONG_TURN, counter=count_tokens) -> DataFrame:
    """Speaker turns of timed elements as units: ``doc_id, turn, span, content, speaker, t_start, t_end, unit_type, visual_summary, ...``."""
    timed = elements.filter("t0 IS NOT NULL")
    spans = split_long_turns(merge_micro_turns(speaker_runs(timed), micro), most)
    out = spans.groupBy("doc_id", "turn", "span").agg(
        in_order("text", "speaker").alias("m"), in_order("id").alias("ids"), F.min("pos").alias("first_pos"), F.min_by("speaker", "pos").alias("speaker"),
        F.coalesce(F.min_by("t0", "pos"), F.lit(0.0)).alias("t_start"), F.coalesce(F.max_by(F.coalesce("t1", F.lit(0.0)), "pos"), F.lit(0.0)).alias("t_end"),
        F.array_distinct(F.filter(F.transform(in_order("visual_summary"), lambda x: x["visual_summary"]), lambda v: v.isNotNull() & (v != ""))).alias("visuals"),
        F.max_by("scene", F.when(F.col("scene").isNotNull(), F.col("pos"))).alias("scene"), F.max_by("ocr_text", F.when(F.col("ocr_text").isNotNull(), F.col("pos"))).alias("ocr_text"),
    )
    content = F.array_join(F.transform("m", lambda x: x["text"]), " ")
    reason = F.format_string("speaker turn (%s), %.0fs — turn boundaries are chunk boundaries", F.coalesce("speaker", F.lit("unknown")), F.col("t_end") - F.col("t_start"))
    out = out.select("doc_id", "turn", "span", "first_pos", content.alias("content"), "speaker", "t_start", "t_end", classify(F.col("m")).alias("unit_type"), F.when(F.size("visuals") > 0, F.array_join("visuals", " · ")).alias("visual_summary"), "scene", "ocr_text", F.transform("ids", lambda x: x["id"]).alias("member_ids"), reason.alias("reason"))
    return out.withColumn("token_count", counter(F.col("content")))


def semantic_shifts(timed: DataFrame, vectors: DataFrame) -> DataFrame:
    """``doc_id, pos, semantic_shift`` where the cosine of neighbouring speech falls below mean less one deviation."""
    speech = timed.filter("kind = 'speech_segment' AND trim(text) <> ''").join(vectors.select("doc_id", "pos", "vector"), ["doc_id", "pos"])
    dot = F.aggregate(F.zip_with("vector", F.lag("vector").over(by_time()), lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    whole = Window.partitionBy("doc_id")
    s = speech.select("doc_id", "pos", dot.alias("sim")).withColumns({"mu": F.avg("sim").over(whole), "sd": F.coalesce(F.stddev_pop("sim").over(whole), F.lit(0.0))})
    low = F.col("mu") - F.col("sd")
    return s.filter(F.col("sim") < low).select("doc_id", "pos", F.least(F.lit(1.0), (low - F.col("sim")) / F.greatest("sd", F.lit(0.05))).alias("semantic_shift"))


def on_timeline(elements: DataFrame) -> DataFrame:
    """Timed elements in order of time, ``pos`` counted anew and the old one kept as ``at``."""
    timed = elements.filter("t0 IS NOT NULL")
    return timed.withColumn("at", F.col("pos")).withColumn("pos", (F.row_number().over(by_time()) - 1).cast("int"))


def event_windows(timeline: DataFrame, edges: DataFrame, target: int = 500, weights: Weights = Weights(), counter=count_tokens, vectors: DataFrame | None = None) -> DataFrame:
    """``timeline`` with ``window`` and the boundary before each element (``confidence``, ``is_cut``, signals).

    Each boundary is decided by itself, so windows are a running count of cuts. A boundary cuts if its
    confidence reaches the threshold, or if little is severed and several signals agree; vetoed ones never do.
    """
    from tessera.operators.graph import relationship_loss

    shifts = semantic_shifts(timeline, vectors) if vectors is not None else None
    c = candidates(timeline, edges, weights, counter, shifts).join(relationship_loss(timeline, edges), ["doc_id", "pos"], "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))
    score = F.col("base_score") - weights.loss * F.col("loss") - weights.fragmentation * F.abs(F.col("tokens_before") - target) / F.lit(float(max(1, target)))
    c = c.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.round(score, 9) * 0.15)))
    agreed = F.coalesce(F.col("multimodal_consensus") > 0.6, F.lit(False))
    c = c.withColumn("is_cut", (F.size("vetoes") == 0) & ((F.col("confidence") >= weights.speaker_boundary) | ((F.col("loss") < 0.5) & agreed)))
    strong = F.array_compact(F.array(*[F.when(F.col(s) > 0.3, F.lit(s)) for s in SIGNALS]))
    marks = c.select("doc_id", "pos", "confidence", "is_cut", strong.alias("signals"))
    out = timeline.join(marks, ["doc_id", "pos"], "left").withColumn("is_cut", F.coalesce("is_cut", F.lit(False)))
    order = Window.partitionBy("doc_id").orderBy("pos")
    return out.withColumn("window", F.sum(F.col("is_cut").cast("int")).over(order).cast("int"))


def fusion(speech: tuple[Column, Column, Column], visual: tuple[Column, Column, Column]) -> Column:
    """How strongly speech belongs to visuals, each given as (t0, t1, entities); null times: none there."""
    s0, s1, se = speech
    v0, v1, ve = visual
    overlap = F.greatest(F.lit(0.0), F.least(s1, v1) - F.greatest(s0, v0))
    span = F.greatest(F.greatest(s1, v1) - F.least(s0, v0), F.lit(1e-6))
    low = lambda a: F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(x)))
    union = F.size(F.array_union(low(se), low(ve)))
    shared = F.when(union > 0, F.size(F.array_intersect(low(se), low(ve))) / union).otherwise(0.5)
    return F.when(s0.isNull() & v0.isNull(), 0.0).when(s0.isNull() | v0.isNull(), 0.3).otherwise(F.round(0.6 * overlap / span + 0.4 * shared, 4))


def fusion_label(score: Column) -> Column:
    return F.when(score > 0.7, "strong").when(score > 0.4, "medium").otherwise("weak")


def multimodal_units(elements: DataFrame, edges: DataFrame, target: int = 500, weights: Weights = Weights(), counter=count_tokens, vectors: DataFrame | None = None) -> DataFrame:
    """Event windows of documents with visuals as units, each situated by the one before it."""
    w = event_windows(on_timeline(elements), edges, target, weights, counter, vectors)
    seen, said = F.col("kind").isin(*VISUAL_KINDS), F.col("kind") == "speech_segment"
    member = F.struct("pos", "text", "speaker", "id")
    gather = lambda test: F.sort_array(F.collect_list(F.when(test, member)))
    end = F.coalesce("t1", "t0", F.lit(0.0))
    ents = lambda test: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("pos", F.coalesce("entities", F.array().cast("array<string>")).alias("e"))))), lambda x: x["e"]))
    g = w.groupBy("doc_id", "window").agg(
        F.min("pos").alias("k"), F.min("at").alias("first_pos"), F.min("t0").alias("t_start"), F.max(end).alias("t_end"), gather(seen).alias("v"), gather(said).alias("s"), gather(F.lit(True)).alias("all"),
        F.min(F.when(said, F.col("t0"))).alias("s0"), F.max(F.when(said, end)).alias("s1"), F.min(F.when(seen, F.col("t0"))).alias("v0"), F.max(F.when(seen, end)).alias("v1"), ents(said).alias("se"), ents(seen).alias("ve"),
        F.coalesce(F.bool_or("synthetic"), F.lit(False)).alias("synthetic"), F.sort_array(F.collect_set("extraction_mode")).alias("modes"), F.min_by("confidence", "pos").alias("opening"), F.min_by("signals", "pos").alias("opened_by"),
    )
    order = Window.partitionBy("doc_id").orderBy("window")
    g = g.withColumns({
        "start_confidence": F.when(F.col("window") > 0, F.round("opening", 4)).otherwise(0.0), "end_confidence": F.coalesce(F.round(F.lead("opening").over(order), 4), F.lit(0.0)),
        "contributing_signals": F.array_distinct(F.concat(F.when(F.col("window") > 0, F.coalesce("opened_by", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), F.coalesce(F.lead("opened_by").over(order), F.array().cast("array<string>")))),
        "fusion_score": fusion((F.col("s0"), F.col("s1"), F.col("se")), (F.col("v0"), F.col("v1"), F.col("ve"))),
    })
    g = g.withColumn("fusion_label", fusion_label(F.col("fusion_score")))
    plain = classify(F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("all")))
    kind = F.when((F.size("v") > 0) & plain.isin("narrative", "speaker_turn", "discussion", "generic"), "video_event").otherwise(plain)
    shown = F.array_join(F.transform(F.filter("v", lambda x: x["text"] != ""), lambda x: x["text"]), " | ")
    spoken = F.array_join(F.transform("s", lambda x: F.when(x["speaker"].isNotNull() & (x["speaker"] != ""), F.concat(F.lit("["), x["speaker"], F.lit("] "), x["text"])).otherwise(x["text"])), " ")
    content = F.concat_ws("\n\n", F.when(shown != "", F.concat(F.format_string("Visual [%.1fs–%.1fs]: ", "t_start", "t_end"), shown)), F.when(F.size("s") > 0, F.concat(F.lit("Spoken: "), spoken)), F.when((F.col("fusion_label") == "weak") & (F.size("v") > 0) & (F.size("s") > 0), F.lit("[Note: speech and visual have low semantic overlap in this window]")))
    content = F.when(content == "", F.format_string("[empty window %.1fs–%.1fs]", "t_start", "t_end")).otherwise(content)
    voices = F.array_distinct(F.filter(F.transform("s", lambda x: x["speaker"]), lambda x: x.isNotNull() & (x != "")))
    g = g.withColumns({"content": content, "unit_type": kind, "voices": voices}).withColumn("speaker", F.when(F.size("voices") > 0, F.array_join("voices", ", ")))
    sentences = F.filter(F.transform(F.split(F.rtrim("content"), r"\.", -1), lambda s: F.trim(s)), lambda s: s != "")
    last = F.get(sentences, F.size(sentences) - 1)
    hint = F.concat_ws("; ", F.when(F.col("speaker").isNotNull(), F.concat(F.lit("Last speaker: "), "speaker")), F.when(F.size("ve") > 0, F.concat(F.lit("Entities in prior context: "), F.array_join(F.slice("ve", F.greatest(F.size("ve") - 3, F.lit(1)), 4), ", "))), F.when(F.length(last) > 10, F.concat(F.lit('Preceding: "'), last, F.lit('"'))))
    g = g.withColumn("hint", F.when(hint != "", hint)).withColumn("leading", F.lag("hint").over(order))
    signals = F.when(F.size("contributing_signals") > 0, F.array_join("contributing_signals", ", ")).otherwise("temporal continuity")
    reason = F.concat(F.format_string("Universal boundary event [%.1fs–%.1fs]: %d speech + %d visual elements fused (%s confidence, signals: ", "t_start", "t_end", F.size("s"), F.size("v"), "fusion_label"), signals, F.lit(")"))
    return g.select("doc_id", "window", "first_pos", "content", "unit_type", "speaker", F.size("voices").alias("speaker_count"), "t_start", "t_end", F.col("ve").alias("entities"), "fusion_score", "fusion_label", "start_confidence", "end_confidence", "contributing_signals", "leading", "synthetic", F.when(F.col("synthetic"), "synthetic_fallback").otherwise(F.get("modes", F.lit(0))).alias("extraction_mode"), F.when(F.col("synthetic"), 0.0).alias("data_confidence"), F.size("s").alias("n_speech"), F.size("v").alias("n_visual"), F.transform("all", lambda x: x["id"]).alias("member_ids"), reason.alias("reason")).withColumn("token_count", counter(F.col("content")))
