"""The context graph: one typed edge for each ordered pair of elements of a document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clip, is_question
from tessera.schema import DEFAULT_IMPORTANCE, IMPORTANCE

#: Largest gap in points between a float and a caption beside it.
CAPTION_GAP = 60.0
#: Seconds of a bucket in which speech and visuals are looked for together.
TIME_BUCKET = 60.0
# How a text names a float, and how a caption labels one.
REFERENCE = r"(?i)\b(Table|Figure|Fig\.?)\s+(\d+)"
TABLE_LABEL = r"(?i)\bTable\s+(\d+)\b"
FIGURE_LABEL = r"(?i)\bFig(?:ure)?\.?\s+(\d+)\b"
def reading() -> Window:
    return Window.partitionBy("doc_id").orderBy("pos")



def _edge(src: Column | str, dst: Column | str, kind: str, confidence: float, evidence: Column | str, rank: float, importance: float | None = None) -> list[Column]:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return [F.col("doc_id"), as_col(src).alias("src"), as_col(dst).alias("dst"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"),
            (F.lit(evidence) if isinstance(evidence, str) else evidence).alias("evidence"), F.lit(importance if importance is not None else IMPORTANCE.get(kind, DEFAULT_IMPORTANCE)).alias("importance"), F.lit(rank).alias("rank")]


def vertical_gap(a: Column, b: Column) -> Column:
    """The distance between two boxes up and down, 0 if they overlap, whichever way the axis points."""
    low = lambda x: F.least(x["y0"], x["y1"])
    high = lambda x: F.greatest(x["y0"], x["y1"])
    return F.greatest(F.lit(0.0), F.greatest(low(a), low(b)) - F.least(high(a), high(b)))


def horizontal_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.greatest(a["x0"], a["x1"]), F.greatest(b["x0"], b["x1"])) - F.greatest(F.least(a["x0"], a["x1"]), F.least(b["x0"], b["x1"])))


def hierarchy(e: DataFrame) -> DataFrame:
    children = e.filter("parent_id IS NOT NULL").select("doc_id", "id", "parent_id")
    parents = e.select("doc_id", F.col("id").alias("parent_id")).distinct()
    return children.join(parents, ["doc_id", "parent_id"]).select(*_edge("parent_id", "id", "parent", 1.0, "heading ancestry", 1.0))


def declared_captions(e: DataFrame) -> DataFrame:
    """``doc_id, caption, float, float_pos, k``: captions that floats name and that exist."""
    named = e.filter(F.col("kind").isin("table", "figure")).select("doc_id", F.col("id").alias("float"), F.col("pos").alias("float_pos"), F.posexplode("caption_ids").alias("k", "caption"))
    return named.join(e.select("doc_id", F.col("id").alias("caption")), ["doc_id", "caption"])


def adjacent_captions(e: DataFrame, declared: DataFrame) -> DataFrame:
    """Captions of floats that name none: the nearest unclaimed one on the page, floats taken in reading order.

    The candidates of a page are a theta join within it; who gets which is settled page by page.
    """
    free_floats = e.filter(F.col("kind").isin("table", "figure") & F.col("bbox").isNotNull()).join(declared.select("doc_id", F.col("float").alias("id")), ["doc_id", "id"], "left_anti")
    free = e.filter((F.col("kind") == "caption") & F.col("bbox").isNotNull()).join(declared.select("doc_id", F.col("caption").alias("id")), ["doc_id", "id"], "left_anti")
    left = free_floats.select("doc_id", "page", F.col("id").alias("float"), F.col("pos").alias("float_pos"), F.col("kind").alias("float_kind"), F.col("bbox").alias("fb"))
    right = free.select("doc_id", "page", F.col("id").alias("caption"), F.col("pos").alias("caption_pos"), F.col("bbox").alias("cb"))
    pairs = left.join(right, ["doc_id", "page"]).withColumn("gap", vertical_gap(F.col("fb"), F.col("cb"))).filter((F.col("gap") <= CAPTION_GAP) & (horizontal_overlap(F.col("fb"), F.col("cb")) > 0))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        keep = []
        for _, options in pdf.sort_values(["float_pos", "gap", "caption_pos"]).groupby("float_pos", sort=True):
            for row in options.itertuples():
                if row.caption not in taken:
                    taken.add(row.caption)
                    keep.append(row.Index)
                    break
        return pdf.loc[keep]

    schema = "doc_id long, page int, float string, float_pos int, float_kind string, caption string, caption_pos int, gap double"
    return pairs.select("doc_id", "page", "float", "float_pos", "float_kind", "caption", "caption_pos", "gap").groupBy("doc_id", "page").applyInPandas(settle, schema)


def references(e: DataFrame, captions: DataFrame) -> DataFrame:
    """Mentions of tables and figures to the float whose caption has the label first, else to the n-th one."""
    floats = e.filter(F.col("kind").isin("table", "figure")).select("doc_id", F.col("id").alias("float"), F.col("pos").alias("float_pos"), F.col("kind").alias("what"))
    nth = floats.withColumn("num", F.row_number().over(Window.partitionBy("doc_id", "what").orderBy("float_pos")).cast("bigint")).select("doc_id", "what", "num", F.col("float").alias("by_order"))
    labelled = captions.select("doc_id", "caption", "float", "k").join(floats, ["doc_id", "float"]).join(e.select("doc_id", F.col("id").alias("caption"), F.col("text").alias("label")), ["doc_id", "caption"])
    numbers = F.when(F.col("what") == "table", F.regexp_extract_all("label", F.lit(TABLE_LABEL), F.lit(1))).otherwise(F.regexp_extract_all("label", F.lit(FIGURE_LABEL), F.lit(1)))
    indexed = labelled.select("doc_id", "what", "float", "float_pos", "k", F.explode(numbers).alias("num")).withColumn("num", F.col("num").try_cast("bigint"))
    by_label = indexed.groupBy("doc_id", "what", "num").agg(F.min_by("float", F.struct("float_pos", "k")).alias("by_label"))
    said = e.filter(F.col("kind").isin("paragraph", "list_item", "caption")).select("doc_id", F.col("id").alias("src"), "pos", F.posexplode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0))).alias("k", "said"))
    said = said.withColumn("what", F.when(F.lower("said").startswith("t"), "table").otherwise("figure")).withColumn("num", F.regexp_extract("said", r"(\d+)$", 1).try_cast("bigint"))
    hit = said.join(by_label, ["doc_id", "what", "num"], "left").join(nth, ["doc_id", "what", "num"], "left").withColumn("dst", F.coalesce("by_label", "by_order")).filter("dst IS NOT NULL AND dst <> src")
    first = hit.groupBy("doc_id", "src", "dst").agg(F.min_by("said", "k").alias("said"))
    return first.select(*_edge("src", "dst", "references", 0.9, F.concat(F.lit("text mentions '"), "said", F.lit("'")), 0.5))


def explains(e: DataFrame) -> DataFrame:
    """``doc_id, prose, float, kind``: floats and the prose right before them."""
    lagged = e.select("doc_id", "pos", "id", "kind", F.lag("id").over(reading()).alias("prose"), F.lag("kind").over(reading()).alias("prose_kind"), F.lag(F.length("text")).over(reading()).alias("n"))
    return lagged.filter(F.col("kind").isin("table", "figure") & F.col("prose_kind").isin("paragraph", "list_item") & (F.col("n") > 20)).select("doc_id", "prose", F.col("id").alias("float"), "kind")


def answers(e: DataFrame) -> DataFrame:
    """``doc_id, asks, tells``: questions and what follows them."""
    led = e.select("doc_id", "pos", F.col("id").alias("asks"), "text", F.lead("id").over(reading()).alias("tells"), F.lead("kind").over(reading()).alias("next_kind"))
    return led.filter(is_question(F.col("text")) & F.col("next_kind").isin("speech_segment", "paragraph")).select("doc_id", "asks", "tells")


def overlaps(e: DataFrame, bucket: float = TIME_BUCKET) -> DataFrame:
    """``doc_id, speech, visual`` that overlap in time. Both are filed under the buckets they touch, so that the join has an equal key."""
    timed = e.filter("t0 IS NOT NULL AND t1 IS NOT NULL AND t1 > t0")
    filed = timed.select("doc_id", "kind", "id", "t0", "t1", F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(F.col("t1") / bucket))).alias("bucket"))
    s = filed.filter("kind = 'speech_segment'").select("doc_id", "bucket", F.col("id").alias("speech"), F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    v = filed.filter("kind = 'visual_event'").select("doc_id", "bucket", F.col("id").alias("visual"), F.col("t0").alias("v0"), F.col("t1").alias("v1"))
    met = s.join(v, ["doc_id", "bucket"]).filter("least(s1, v1) > greatest(s0, v0)")
    # a pair meets in several buckets; the first it shares is where it counts
    return met.filter(F.col("bucket") == F.floor(F.greatest("s0", "v0") / bucket)).drop("bucket")


def neighbour_edges(e: DataFrame) -> DataFrame:
    """Edges between neighbours in one pass over the reading order: order itself, prose before a float, questions and what follows."""
    seen = e.select("doc_id", "pos", "id", "kind", F.length("text").alias("n"), is_question(F.col("text")).alias("asks"))
    near = seen.select("doc_id", "id", "kind", "n", "asks", F.lead("id").over(reading()).alias("next_id"), F.lead("kind").over(reading()).alias("next_kind")).filter("next_id IS NOT NULL")

    def edge(src: str, dst: str, kind: str, confidence: float, evidence: Column, rank: float) -> Column:
        return F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"), F.lit(IMPORTANCE[kind]).alias("importance"), F.lit(rank).alias("rank"))

    told = F.col("next_kind").isin("table", "figure") & F.col("kind").isin("paragraph", "list_item") & (F.col("n") > 20)
    answered = F.col("asks") & F.col("next_kind").isin("speech_segment", "paragraph")
    found = F.array_compact(F.array(
        edge("id", "next_id", "next", 1.0, F.lit("reading order"), 0.1),
        F.when(told, edge("id", "next_id", "explains", 0.85, F.concat(F.lit("prose introduces adjacent "), "next_kind"), 4.0)),
        F.when(told, edge("next_id", "id", "illustrated_by", 0.85, F.concat("next_kind", F.lit(" illustrated by preceding prose")), 4.0)),
        F.when(answered, edge("id", "next_id", "answered_by", 0.90, F.lit("question answered by following element"), 5.0)),
        F.when(answered, edge("next_id", "id", "question_for", 0.90, F.lit("answer directly addresses question"), 5.0)),
    ))
    return near.select("doc_id", F.inline_outer(found))


def build_edges(elements: DataFrame) -> DataFrame:
    """All edges ``doc_id, src, dst, type, confidence, evidence, importance``.

    Where builders give an ordered pair several edges one stays: those of a higher rank overwrite, mentions
    and the reading order only fill what is free, and prose explains a float only where nothing links the
    two yet. Both directions of a pair are settled together, in one aggregation over all builders' edges.
    """
    e = elements
    declared = declared_captions(e)
    beside = adjacent_captions(e, declared)
    caps = declared.select("doc_id", "caption", "float", "k").unionByName(beside.select("doc_id", "caption", "float", F.lit(0).alias("k")))
    text = F.format_string("bbox adjacency: caption %.0fpt from %s on page %d", "gap", "float_kind", "page")
    during = F.format_string("speech span (%.1fs–%.1fs) overlaps visual event (%.1fs–%.1fs)", "s0", "s1", "v0", "v1")
    every = (
        hierarchy(e)
        .unionByName(declared.select(*_edge("caption", "float", "captions", 1.0, "declared caption", 2.0)))
        .unionByName(declared.select(*_edge("float", "caption", "captioned_by", 1.0, "declared caption", 2.0)))
        .unionByName(beside.select(*_edge("caption", "float", "captions", 0.8, text, 3.0)))
        .unionByName(beside.select(*_edge("float", "caption", "captioned_by", 0.8, text, 3.0)))
        .unionByName(references(e, caps))
        .unionByName(overlaps(e).select(*_edge("speech", "visual", "occurs_during", 0.85, during, 6.0, 0.80)))
        .unionByName(neighbour_edges(e))
    )
    value = F.struct("rank", "type", "confidence", "evidence", "importance", "src", "dst")
    pairs = every.groupBy("doc_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.collect_list(value).alias("all"))
    explaining = F.get(F.filter("all", lambda x: x["type"] == "explains"), F.lit(0))
    linked = F.exists("all", lambda x: (x["src"] == explaining["src"]) & (x["rank"] < 4) & (x["rank"] > 0.1))
    pairs = pairs.select("doc_id", "a", "b", F.when(F.coalesce(linked, F.lit(False)), F.filter("all", lambda x: ~x["type"].isin("explains", "illustrated_by"))).otherwise(F.col("all")).alias("all"))
    ahead = F.array_max(F.filter("all", lambda x: x["src"] == F.col("a")))
    back = F.array_max(F.filter("all", lambda x: (x["src"] == F.col("b")) & (F.col("a") != F.col("b"))))
    settled = pairs.select("doc_id", F.inline_outer(F.array_compact(F.array(ahead, back)))).filter("src IS NOT NULL")
    return settled.select("doc_id", "src", "dst", "type", "confidence", "evidence", "importance")


def heading_paths(elements: DataFrame) -> DataFrame:
    """``doc_id, id, path``: texts of all ancestors from the top, for every element that has one.

    Only elements that are somebody's parent, a document's outline, are gathered and walked; the others
    meet their parent's path by a join. An ancestor met before ends the walk.
    """
    children = elements.filter("parent_id IS NOT NULL").select("doc_id", "id", "parent_id")
    parents = elements.select("doc_id", "id", F.col("parent_id").alias("up"), "text").join(children.select("doc_id", F.col("parent_id").alias("id")).distinct(), ["doc_id", "id"], "left_semi")
    outline = parents.groupBy("doc_id").agg(F.collect_list(F.struct("id", "up", "text")).alias("l"))

    def walk(frames):
        for pdf in frames:
            out = []
            for doc, rows in zip(pdf["doc_id"], pdf["l"]):
                held = {r["id"]: (r["up"], r["text"]) for r in rows}
                for start in held:
                    path, at, seen = [], start, set()
                    while at in held and at not in seen:
                        seen.add(at)
                        path.append(held[at][1])
                        at = held[at][0]
                    out.append((doc, start, path[::-1]))
            yield pd.DataFrame(out, columns=["doc_id", "parent_id", "path"])

    paths = outline.mapInPandas(walk, "doc_id long, parent_id string, path array<string>")
    return children.join(paths, ["doc_id", "parent_id"]).select("doc_id", "id", "path")


def surrounding_text(elements: DataFrame, chars: int = 320) -> DataFrame:
    """``doc_id, id, leading, trailing``: the nearest prose of more than 40 characters either way, up to a heading."""
    prose = F.when(F.col("kind").isin("paragraph", "list_item") & (F.length("text") > 40), F.substring("text", 1, chars))
    heading = (F.col("kind") == "heading").cast("int")
    # a heading ends the search from either side: it opens a block for what follows and closes the one before
    e = elements.select("doc_id", "pos", "id", prose.alias("prose"), F.coalesce(F.sum(heading).over(reading().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"), F.sum(heading).over(reading()).alias("upto"))
    back = Window.partitionBy("doc_id", "above").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("doc_id", "upto").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    return e.select("doc_id", "id", F.last("prose", ignorenulls=True).over(back).alias("leading"), F.first("prose", ignorenulls=True).over(ahead).alias("trailing"))


def separation(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, pos, graph_separation`` of each element from the one before: 0.1 linked, 0.95 under other headings, else 0.5."""
    if "path" in elements.columns:
        at = elements.select("doc_id", "pos", "id", F.array_join("path", "\x1f").alias("path"))
    else:
        at = elements.select("doc_id", "pos", "id").join(heading_paths(elements).select("doc_id", "id", F.array_join("path", "\x1f").alias("path")), ["doc_id", "id"], "left")
    e = at.select("doc_id", "pos", "id", F.coalesce("path", F.lit("")).alias("path")).select("doc_id", "pos", "id", "path", F.lag("id").over(reading()).alias("prev"), F.lag("path").over(reading()).alias("prev_path"))
    strong = edges.filter("type NOT IN ('next', 'previous')")
    linked = strong.select("doc_id", F.col("src").alias("prev"), F.col("dst").alias("id")).unionByName(strong.select("doc_id", F.col("dst").alias("prev"), F.col("src").alias("id"))).distinct().withColumn("linked", F.lit(True))
    out = e.filter("prev IS NOT NULL").join(linked, ["doc_id", "prev", "id"], "left")
    return out.select("doc_id", "pos", F.when(F.col("linked"), 0.1).when(F.col("path") != F.col("prev_path"), 0.95).otherwise(0.5).alias("graph_separation"))


def relationship_loss(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, pos, loss``: what cutting before each element severs, by a running sum over where edges begin and end."""
    at = elements.select("doc_id", "pos", "id")
    strong = edges.filter("type NOT IN ('next', 'previous')").join(at.toDF("doc_id", "a", "src"), ["doc_id", "src"]).join(at.toDF("doc_id", "b", "dst"), ["doc_id", "dst"])
    span = strong.select("doc_id", "importance", (F.least("a", "b") + 1).alias("first"), (F.greatest("a", "b") + 1).alias("after"))
    change = span.select("doc_id", F.col("first").alias("pos"), F.col("importance").alias("d")).unionByName(span.select("doc_id", F.col("after").alias("pos"), (-F.col("importance")).alias("d"))).groupBy("doc_id", "pos").agg(F.sum("d").alias("d"))
    return at.join(change, ["doc_id", "pos"], "left").select("doc_id", "pos", F.round(F.sum(F.coalesce("d", F.lit(0.0))).over(reading()), 6).alias("loss")).filter("pos > 0")


def graph_rows(elements: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as they are written: node texts cut at 120 characters, numbers rounded."""
    nodes = elements.select("doc_id", "id", "kind", "page", clip(F.col("text"), 120).alias("text"))
    return nodes, edges.select("doc_id", F.col("src").alias("source"), F.col("dst").alias("target"), "type", F.round("confidence", 3).alias("confidence"), "evidence", F.round("importance", 2).alias("importance"))
