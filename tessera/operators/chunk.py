"""Chunkers over prose: atomic floats, sections, packed streams, and the cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import body_rows, count_tokens, header_markdown, row_markdown
from tessera.operators.boundary import Weights, candidates
from tessera.operators.graph import reading
from tessera.operators.tabular import greedy_groups

TARGET_TOKENS, MAX_TOKENS = 500, 700


def carve_floats(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(floats and their captions, the rest): tables and figures leave the stream together with the captions they name."""
    floats = elements.filter(F.col("kind").isin("table", "figure"))
    named = floats.select("doc_id", F.explode("caption_ids").alias("id"))
    gone = floats.select("doc_id", "id").unionByName(named).distinct()
    return elements.join(gone, ["doc_id", "id"], "left_semi"), elements.join(gone, ["doc_id", "id"], "left_anti")


def atomic_floats(elements: DataFrame, counter=count_tokens, target: int = TARGET_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """Units of tables and figures: ``doc_id, id, pos, kind, page, part, content, token_count, caption, has_caption, reason``.

    A float stays whole with its captions up to ``most`` tokens or without a grid; a larger table is parted
    by rows, each part with caption and header. A figure's own text is not used.
    """
    floats = elements.filter(F.col("kind").isin("table", "figure"))
    caps = floats.select("doc_id", F.col("id").alias("float"), F.posexplode("caption_ids").alias("k", "id")).join(elements.select("doc_id", "id", F.col("text").alias("caption")), ["doc_id", "id"])
    joined = caps.groupBy("doc_id", "float").agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "caption"))), lambda x: x["caption"]), " ")).alias("caption"))
    f = floats.join(joined.withColumnRenamed("float", "id"), ["doc_id", "id"], "left").withColumn("caption", F.coalesce("caption", F.lit("")))
    body = F.when(F.col("kind") == "table", F.col("text")).otherwise("")
    full = F.concat_ws("\n\n", F.when(F.col("caption") != "", F.col("caption")), F.when(body != "", body))
    full = F.when(full == "", F.concat(F.lit("[uncaptioned "), "kind", F.lit(" on page "), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit("]"))).otherwise(full)
    f = f.withColumn("full", full).withColumn("whole", (counter(F.col("full")) <= most) | (F.coalesce(F.size("grid"), F.lit(0)) <= 0))
    keep = ["doc_id", "id", "pos", "kind", "page", "caption", F.coalesce(F.size("caption_ids") > 0, F.lit(False)).alias("has_caption")]
    kept = F.when(F.col("caption") != "", F.concat("kind", F.lit(" kept whole with its caption — severing the pair is vetoed"))).otherwise(F.concat("kind", F.lit(" kept as one unit")))
    whole = f.filter("whole").select(*keep, F.lit(None).cast("int").alias("part"), F.col("full").alias("content"), kept.alias("reason"))

    large = f.filter("NOT whole").withColumn("header", F.coalesce("header_row", F.get("grid", F.lit(0))))
    head = header_markdown(F.col("header"))
    rows = large.select("doc_id", "id", (counter(head) + counter(F.col("caption"))).alias("budget"), F.posexplode(body_rows(F.col("grid"), F.col("header"))).alias("pos", "row")).select("doc_id", "id", "pos", row_markdown(F.col("row")).alias("line"), "budget").withColumn("cost", counter(F.col("line")))
    packed = greedy_groups(rows, ["doc_id", "id"], "cost", "budget", target)
    parts = packed.groupBy("doc_id", "id", "grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    content = F.concat_ws("\n", F.when(F.col("caption") != "", F.col("caption")), head, "lines")
    split = large.join(parts, ["doc_id", "id"]).select(*keep, (F.col("grp") + 1).alias("part"), content.alias("content"), F.lit(f"table exceeds {most} tokens — split by rows; cutting through the header is vetoed, so it repeats on every part").alias("reason"))
    return whole.unionByName(split).withColumn("token_count", counter(F.col("content")))


def sections(stream: DataFrame) -> DataFrame:
    """``stream`` with ``region``: a new one begins at every heading."""
    return stream.withColumn("region", F.sum((F.col("kind") == "heading").cast("int")).over(reading()).cast("int"))


def semantic_groups(stream: DataFrame, vectors: DataFrame, least: int = 4) -> DataFrame:
    """``stream`` with ``region``: a new one where the cosine of neighbours falls below the document's mean less one deviation.

    ``vectors`` has ``doc_id, pos, vector`` (unit length). Documents of fewer than ``least`` elements, and
    those without drift, are one region. Everything is a window over the document.
    """
    dot = F.aggregate(F.zip_with("vector", F.lag("vector").over(reading()), lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    whole = Window.partitionBy("doc_id")
    s = stream.join(vectors.select("doc_id", "pos", "vector"), ["doc_id", "pos"], "left").withColumn("sim", dot).drop("vector")
    s = s.withColumns({"mu": F.avg("sim").over(whole), "sd": F.stddev_pop("sim").over(whole), "n": F.count("*").over(whole)})
    starts = (F.col("n") >= least) & (F.col("sim") < F.col("mu") - F.col("sd"))
    return s.withColumn("region", F.coalesce(F.sum(starts.cast("int")).over(reading()), F.lit(0)).cast("int")).drop("sim", "mu", "sd", "n")


def cut_regions(stream: DataFrame, edges: DataFrame, weights: Weights = Weights(), target: int = TARGET_TOKENS, most: int = MAX_TOKENS, rebalance: bool = False, counter=count_tokens) -> DataFrame:
    """Units of a stream with regions: ``doc_id, pos, region, unit, overflow, was_cut, region_tokens, vetoes``.

    A region of more than ``most`` tokens is cut at its best legal boundary: the left part is a unit as it is,
    the right part is looked at again, with only the edges inside of it. Without a legal boundary the region
    stays whole and overflows. ``rebalance`` looks at the left part again too.

    What cutting costs depends on the cuts before it, so each document is walked once; signals and vetoes
    are columns made before, and losses within a region come from one running sum of where edges begin and
    end. A task holds one document's numbers, none of its text.
    """
    cands = candidates(stream, edges, weights, counter).select("doc_id", "pos", "base_score", F.array_join("vetoes", "; ").alias("veto"))
    at = stream.select("doc_id", "pos", "id")
    spans = edges.filter("type NOT IN ('next', 'previous')").join(at.toDF("doc_id", "a", "src"), ["doc_id", "src"]).join(at.toDF("doc_id", "b", "dst"), ["doc_id", "dst"])
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "importance")).alias("spans"))
    rows = stream.select("doc_id", "pos", "region", counter(F.col("text")).alias("tokens")).join(cands, ["doc_id", "pos"], "left")
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "region", "tokens", F.coalesce("base_score", F.lit(0.0)).alias("score"), F.coalesce("veto", F.lit("")).alias("veto")))).alias("rows")).join(spans, "doc_id", "left")

    def walk(batches):
        for pdf in batches:
            out = []
            for doc, rows_, spans_ in zip(pdf["doc_id"], pdf["rows"], pdf["spans"]):
                out += cut_document(doc, rows_, spans_ if spans_ is not None else [], weights, target, most, rebalance)
            yield pd.DataFrame(out, columns=["doc_id", "pos", "region", "unit", "overflow", "was_cut", "region_tokens", "vetoes"])

    return docs.select("doc_id", "rows", "spans").mapInPandas(walk, "doc_id long, pos int, region int, unit int, overflow boolean, was_cut boolean, region_tokens int, vetoes array<string>")


def cut_document(doc, rows, spans, weights: Weights, target: int, most: int, rebalance: bool) -> list[tuple]:
    pos = np.array([r["pos"] for r in rows])
    region = np.array([r["region"] for r in rows])
    tokens = np.array([r["tokens"] for r in rows])
    base = np.array([r["score"] for r in rows])
    veto = [r["veto"] for r in rows]
    where = {p: k for k, p in enumerate(pos.tolist())}
    a = np.array([where[s["a"]] for s in spans if s["a"] in where and s["b"] in where], int)
    b = np.array([where[s["b"]] for s in spans if s["a"] in where and s["b"] in where], int)
    w = np.array([s["importance"] for s in spans if s["a"] in where and s["b"] in where], float)
    out, unit = [], 0
    edge = np.flatnonzero(np.r_[True, region[1:] != region[:-1], True])
    todo = [(int(x), int(y)) for x, y in zip(edge[:-1], edge[1:])][::-1]

    def emit(lo: int, hi: int, overflow: bool, was_cut: bool, total: int, vetoes: list[str]) -> None:
        nonlocal unit
        for k in range(lo, hi):
            out.append((doc, int(pos[k]), int(region[k]), unit, overflow, was_cut, total, vetoes if k == lo else []))
        unit += 1

    while todo:
        lo, hi = todo.pop()
        total = int(tokens[lo:hi].sum())
        if total <= most:
            emit(lo, hi, False, False, total, [])
            continue
        inside = (a >= lo) & (b < hi)
        change = np.zeros(hi - lo + 1)
        np.add.at(change, a[inside] + 1 - lo, w[inside])
        np.add.at(change, b[inside] + 1 - lo, -w[inside])
        loss = np.cumsum(change)[1 : hi - lo].round(9)
        dist = np.cumsum(tokens[lo : hi - 1])
        score = (base[lo + 1 : hi] - weights.loss * loss - weights.fragmentation * np.abs(dist - target) / max(1, target)).round(9)
        vetoed = [f"cut before element {k}: {veto[lo + k]}" for k in range(1, hi - lo) if veto[lo + k]] + [f"cut before element {k + 1}: severs relationships worth {x:.2f}" for k, x in enumerate(loss) if x >= 1.0 and not veto[lo + k + 1]]
        legal = np.array([not veto[lo + k] for k in range(1, hi - lo)], bool) & (loss < 1.0)
        if not legal.any():
            emit(lo, hi, True, False, total, vetoed)
            continue
        cut = lo + 1 + int(np.where(legal, score, -np.inf).argmax())
        todo.append((cut, hi))
        if rebalance:
            todo.append((lo, cut))
        else:
            emit(lo, cut, False, True, total, vetoed)
    return out


def text_units(stream: DataFrame, cuts: DataFrame, counter=count_tokens) -> DataFrame:
    """The text of each unit of :func:`cut_regions`: ``doc_id, unit, content, token_count, anchor_id, anchor_kind, n_elements, overflow, member_ids``."""
    e = stream.select("doc_id", "pos", "id", "kind", "text").join(cuts, ["doc_id", "pos"])
    some = F.collect_list(F.struct("pos", "text"))
    out = e.groupBy("doc_id", "unit").agg(
        F.array_join(F.transform(F.filter(F.sort_array(some), lambda x: x["text"] != ""), lambda x: x["text"]), "\n\n").alias("content"),
        F.min_by("id", "pos").alias("anchor_id"), F.min_by("kind", "pos").alias("anchor_kind"), F.min("pos").alias("first_pos"), F.count("*").alias("n_elements"),
        F.first("overflow").alias("overflow"), F.first("was_cut").alias("was_cut"), F.first("region_tokens").alias("region_tokens"), F.max_by("vetoes", F.size("vetoes")).alias("vetoes"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("member_ids"),
    )
    return out.withColumn("token_count", counter(F.col("content")))


def packed_elements(elements: DataFrame, target: int = MAX_TOKENS, counter=count_tokens) -> DataFrame:
    """``elements`` with ``grp``: packed in reading order up to ``target`` tokens, whatever stands between them."""
    rows = elements.select("doc_id", "pos", counter(F.col("text")).alias("cost"), F.lit(0).alias("budget"))
    return greedy_groups(rows, ["doc_id"], "cost", "budget", target)


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 64, counter=count_tokens) -> DataFrame:
    """The plain baseline: windows of ``size`` tokens every ``size - overlap``: ``doc_id, chunk, first_token, n_tokens``."""
    n = docs.select("doc_id", counter(F.col("text")).alias("n")).filter("n > 0")
    starts = n.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(size - overlap))).alias("chunk", "first_token"))
    return starts.select("doc_id", "chunk", "first_token", F.least(F.lit(size), F.col("n") - F.col("first_token")).alias("n_tokens"))
