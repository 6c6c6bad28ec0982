"""Flat text and markdown as elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import HEADING_NUMBER


def text_elements(docs: DataFrame, split: str = "\n") -> DataFrame:
    """One paragraph for every piece of text between ``split`` that isn't blank."""
    pieces = docs.select("doc_id", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), split, -1)).alias("k", "text")).filter(F.trim("text") != "")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1
    return pieces.select("doc_id", pos.cast("int").alias("pos"), F.lit("paragraph").alias("kind"), "text").withColumn("id", F.concat(F.lit("el_"), F.col("pos").cast("string")))


def markdown_elements(docs: DataFrame) -> DataFrame:
    """Blocks between blank lines: ``#`` headings, list items, fenced code, pipe tables, else paragraphs; with parents."""
    marked = F.regexp_replace("text", r"(?m)^(#{1,6} .*)$", "\n$1\n")
    blocks = docs.select("doc_id", F.posexplode_outer(F.split(marked, r"\n\s*\n", -1)).alias("k", "b")).withColumn("b", F.btrim("b", F.lit(" \n\t\r"))).filter("b <> ''")
    lines = blocks.withColumn("list", F.col("b").rlike(r"^([-*+]|\d+[.)])\s+")).select("doc_id", "k", F.posexplode_outer(F.when(F.col("list"), F.split("b", r"\n(?=([-*+]|\d+[.)])\s+)", -1)).otherwise(F.array("b"))).alias("j", "b"))
    kind = F.when(F.col("b").rlike(r"^#{1,6} "), "heading").when(F.col("b").startswith("```"), "code").when(F.col("b").rlike(r"^([-*+]|\d+[.)])\s+"), "list_item").when(F.col("b").rlike(r"^\|.*\|\s*\n\|[\s:|-]+\|"), "table").otherwise("paragraph")
    cell_rows = F.filter(F.split("b", "\n", -1), lambda r: ~r.rlike(r"^\|[\s:|-]+\|?\s*$"))
    grid = F.transform(cell_rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\s*\||\|\s*$", ""), r"\|", -1), lambda c: F.trim(c)))
    text = F.when(F.col("kind") == "heading", F.regexp_replace("b", r"^#+\s*", "")).when(F.col("kind") == "list_item", F.regexp_replace("b", r"^([-*+]|\d+[.)])\s+", "")).otherwise(F.col("b"))
    pos = (F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "j")) - 1).cast("int")
    out = lines.withColumn("kind", kind).select("doc_id", pos.alias("pos"), "kind", text.alias("text"), F.when(F.col("kind") == "heading", F.length(F.regexp_extract("b", "^(#+)", 1))).alias("level"), F.when(F.col("kind") == "table", grid).alias("grid"))
    out = out.withColumn("header_row", F.get("grid", F.lit(0))).withColumn("id", F.concat(F.lit("el_"), F.col("pos").cast("string")))
    return with_parents(out)


def with_parents(elements: DataFrame, depth: int = 6) -> DataFrame:
    """``parent_id`` from heading levels: the last heading of a smaller level, for other elements the last heading."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.col("kind") == "heading"
    out = elements
    for k in range(1, depth + 1):
        out = out.withColumn(f"__h{k}", F.last(F.when(heading & (F.col("level") == k), F.struct("pos", "id")), ignorenulls=True).over(order))
    # the nearest heading above whose level is smaller; a heading in between of a still smaller one ends its reach
    above = F.array_compact(F.array(*[F.when(~heading | (F.col("level") > k), F.col(f"__h{k}")) for k in range(1, depth + 1)]))
    return out.withColumn("parent_id", F.array_max(above)["id"]).drop(*[f"__h{k}" for k in range(1, depth + 1)])


def numbered_levels(headings: DataFrame) -> DataFrame:
    """Levels of numbered headings: the dots of the number and two; others none."""
    number = F.regexp_extract("text", HEADING_NUMBER, 1)
    return headings.withColumn("number", F.when(number != "", number)).withColumn("level", F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 2).otherwise(F.col("level") if "level" in headings.columns else F.lit(None).cast("int")))


def heading_stack(elements: DataFrame) -> DataFrame:
    """``level`` and ``parent_id`` of layout elements whose headings carry numbers or none (``is_title`` marks titles).

    A title clears the stack. A numbered heading closes all headings, the title included, down to one whose
    number is a dotted prefix of its own, and goes under that. An unnumbered one closes the unnumbered ones on
    top, the title included, and joins the stack only if that is empty then. The stack depends on all
    headings before, so the headings of a document, and nothing else, are walked once.
    """
    import pandas as pd

    named = numbered_levels(elements.filter("kind = 'heading'"))
    title = F.col("is_title") if "is_title" in elements.columns else F.lit(False)
    listed = named.select("doc_id", "pos", "id", "number", F.coalesce(title, F.lit(False)).alias("title")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "number", "title"))).alias("l"))

    def walk(frames):
        for pdf in frames:
            out = []
            for doc, rows in zip(pdf["doc_id"], pdf["l"]):
                stack: list[tuple[str, str | None, int]] = []
                for r in rows:
                    number = r["number"]
                    if r["title"]:
                        stack, level, parent = [], 1, None
                        stack.append((r["id"], None, 1))
                    elif number:
                        while stack and not number.startswith(f"{stack[-1][1]}."):
                            stack.pop()
                        parent, level = (stack[-1][0] if stack else None), number.count(".") + 2
                        stack.append((r["id"], number, level))
                    else:
                        while stack and stack[-1][1] is None:
                            stack.pop()
                        parent, level = (stack[-1][0], stack[-1][2] + 1) if stack else (None, 2)
                        if not stack:
                            stack.append((r["id"], None, level))
                    out.append((doc, r["pos"], level, parent, stack[-1][0] if stack else None))
            yield pd.DataFrame(out, columns=["doc_id", "pos", "__level", "__parent", "__top"])

    walked = listed.mapInPandas(walk, "doc_id long, pos int, __level int, __parent string, __top string")
    out = elements.join(walked, ["doc_id", "pos"], "left")
    top = F.last("__top", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    heading = F.col("kind") == "heading"
    keep = [c for c in elements.columns if c not in ("level", "parent_id")]
    return out.select(*keep, F.when(heading, F.col("__level")).alias("level"), F.when(heading, F.col("__parent")).otherwise(top).alias("parent_id"))
