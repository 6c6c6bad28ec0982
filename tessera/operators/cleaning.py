"""Text cleaning: rules in a fixed order, each counting what it changed."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import table_markdown

# The debris that each rule takes out, in the order in which the rules apply.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
INVISIBLE = "[­​‌‍⁠﻿]"
BLANKS = "[   ]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CITATION = r"(?U)【?\s*\d+\s*†\s*L?[\d\s\-–L]{0,24}】?"
CITATION_REMNANT = r"(?U)【[\s\d\-–L]{1,24}】"
LONE_OPEN, LONE_CLOSE = r"(?U)【\s*", r"(?U)\s*】"
#: (counter, pattern, replacement) of the rules that code is spared.
PROSE_RULES = (
    ("hyphen_line_breaks", r"(?U)(\w)[-‐‑]\s*\n\s*([a-z])", "$1$2"),
    ("dot_leaders", r"\.{4,}", " "),
    ("trailing_bullets", r"(?md)[ \t]*[·•▪●○◦]+[ \t]*$", ""),
    ("space_before_punctuation", r"[ \t]+([,.;:!?%)\]])", "$1"),
    ("space_after_bracket", r"([(\[])[ \t]+", "$1"),
    ("repeated_spaces", r"[ \t]{2,}", " "),
    ("repeated_blank_lines", r"\n{3,}", "\n\n"),
)
ANY_RULES = (
    ("control_chars", CONTROL, ""),
    ("invisible_chars", INVISIBLE, ""),
    ("non_breaking_spaces", BLANKS, " "),
    ("citation_markers", CITATION, ""),
    ("citation_markers", CITATION_REMNANT, ""),
)
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$(?![\s\S])"
COUNTERS = ("unicode_normalised", "ligatures", "control_chars", "invisible_chars", "non_breaking_spaces", "citation_markers", "orphaned_citation_brackets", *(r[0] for r in PROSE_RULES), "surrounding_whitespace")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for. Texts that are ASCII come back as they are."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _apply(state: DataFrame, counter: str, pattern: str, to: str, when: Column | None = None) -> DataFrame:
    n = F.regexp_count("__t", F.lit(pattern))
    new = F.regexp_replace("__t", pattern, to)
    if when is not None:
        n, new = F.when(when, n).otherwise(0), F.when(when, new).otherwise(F.col("__t"))
    return state.withColumns({f"__{counter}": F.coalesce(F.col(f"__{counter}") if f"__{counter}" in state.columns else F.lit(0), F.lit(0)) + F.coalesce(n, F.lit(0)), "__t": new})


def clean_text(df: DataFrame, text: str = "text", verbatim: Column | None = None, normalise: bool = True) -> DataFrame:
    """``df`` with ``text`` cleaned and a map column ``fixes`` of rule counts above zero.

    ``verbatim`` rows (code) keep their inner spacing. ``normalise=False`` leaves NFKC out, and then no
    Python runs. The rules are a chain of projections that Catalyst keeps in one stage.
    """
    prose = ~(verbatim if verbatim is not None else F.lit(False))
    state = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    if normalise:
        state = state.withColumn("__n", nfkc("__t"))
        state = state.withColumns({"__unicode_normalised": (F.col("__n") != F.col("__t")).cast("int"), "__t": F.col("__n")}).drop("__n")
    ligature = "[" + "".join(LIGATURES) + "]"
    state = state.withColumns({"__ligatures": F.regexp_count("__t", F.lit(ligature)), "__t": reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), F.col("__t"))})
    for rule in ANY_RULES:
        state = _apply(state, *rule)
    opened, closed = F.regexp_count("__t", F.lit("【")), F.regexp_count("__t", F.lit("】"))
    state = state.withColumn("__odd", opened != closed)
    state = _apply(state, "orphaned_citation_brackets", LONE_OPEN, "", F.col("__odd"))
    state = _apply(state, "orphaned_citation_brackets", LONE_CLOSE, "", F.col("__odd"))
    for rule in PROSE_RULES:
        state = _apply(state, *rule, prose)
    bare = F.regexp_replace("__t", STRIP, "")
    state = state.withColumn("__bare", bare).withColumns({"__surrounding_whitespace": (F.col("__bare") != F.col("__t")).cast("int"), "__t": F.col("__bare")})
    have = [c for c in COUNTERS if f"__{c}" in state.columns]
    fixes = F.map_filter(F.create_map(*[x for c in have for x in (F.lit(c), F.col(f"__{c}").cast("bigint"))]), lambda _, n: n > 0)
    rest = [c for c in df.columns if c not in (text, "fixes")]
    return state.select(*[F.col("__t").alias(text) if c == text else F.col(c) for c in df.columns if c in (text, *rest)], fixes.alias("fixes"))


def clean_cells(df: DataFrame, grid: str = "grid") -> DataFrame:
    """Cells cleaned by the same rules (short ones are left alone), by exploding the grid and putting it back."""
    keyed = df.withColumn("__row", F.monotonically_increasing_id())
    cells = keyed.select("__row", F.posexplode(grid).alias("r", "cells")).select("__row", "r", F.posexplode("cells").alias("c", "text"))
    long_enough = cells.filter(F.length("text") >= 3)
    cleaned = clean_text(long_enough).drop("fixes").unionByName(cells.filter(F.coalesce(F.length("text"), F.lit(0)) < 3))
    rows = cleaned.groupBy("__row", "r").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]).alias("cells"))
    grids = rows.groupBy("__row").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "cells"))), lambda x: x["cells"]).alias("__grid"))
    return keyed.join(grids, "__row", "left").withColumn(grid, F.coalesce("__grid", F.col(grid))).drop("__row", "__grid")


def clean_elements(elements: DataFrame, normalise: bool = True) -> DataFrame:
    """Elements with text and grids cleaned; a table's text is its grid again. Adds ``fixes`` and ``changed``."""
    before = elements.withColumn("__before", F.col("text"))
    out = clean_text(before, verbatim=F.col("kind") == "code", normalise=normalise)
    out = out.withColumn("changed", F.col("text") != F.col("__before"))
    tables = clean_cells(out.filter((F.col("kind") == "table") & F.col("grid").isNotNull()))
    tables = tables.withColumn("text", table_markdown(F.col("grid")))
    others = out.filter(~((F.col("kind") == "table") & F.col("grid").isNotNull()))
    return others.unionByName(tables).withColumn("removed_chars", F.greatest(F.length("__before") - F.length("text"), F.lit(0))).drop("__before")


def cleaning_report(cleaned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Fixes by rule, largest first."""
    return cleaned.select(*by, F.explode_outer("fixes").alias("rule", "n")).filter("rule IS NOT NULL").groupBy(*by, "rule").agg(F.sum("n").alias("n")).orderBy(*by, F.desc("n"), "rule")


def cleaning_summary(cleaned: DataFrame, top: int = 3) -> DataFrame:
    """Total fixes and the ``top`` rules in one row; none if nothing was fixed."""
    report = cleaning_report(cleaned)
    ranked = report.groupBy().agg(F.sum("n").alias("total"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "rule", "n"))), 1, top).alias("t"))
    return ranked.filter("total > 0").select("total", F.array_join(F.transform("t", lambda x: F.concat(x["n"].cast("string"), F.lit(" "), F.replace(x["rule"], F.lit("_"), F.lit(" ")))), ", ").alias("summary"))
