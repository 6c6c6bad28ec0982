"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide which text leans on context outside of it.
ANAPHORA = r"(?imd)\bas (shown|described|noted|mentioned|discussed) (above|earlier|previously|below)\b|\bthis (table|figure|section|chart|diagram|approach|result)\b|\bthe (former|latter)\b|^(This|These|It|They)\b"
SENTENCE_END = r"(?<=[.!?])\s+"
QUESTION = r"(?i)^(who|what|where|when|why|how|can|could|would|should|is|are|do|does|did)\b.*\?"
HEADING_NUMBER = r"^(\d+(?:\.\d+)*)\.?\s+\S"
#: A token stand-in that every engine counts alike: runs of letters and digits, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def count_tokens(text: Column | str) -> Column:
    """Tokens by the default pattern. ``functions.tokens`` has counters over vocabulary files."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def norm(text: Column) -> Column:
    """Lower case with every run of other characters than a-z and 0-9 one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END, -1), lambda s: F.trim(s) != "")


def anaphora_rate(text: Column) -> Column:
    """The share of sentences that lean on context elsewhere; 0 without sentences."""
    found = sentences(text)
    n = F.size(found)
    return F.when(n > 0, F.size(F.filter(found, lambda s: s.rlike(ANAPHORA))) / n).otherwise(F.lit(0.0))


def is_question(text: Column) -> Column:
    bare = F.trim(text)
    return bare.endswith("?") | bare.rlike(QUESTION)


def row_markdown(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))


def rule_markdown(width: Column) -> Column:
    return F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))


def table_markdown(grid: Column) -> Column:
    """A grid as markdown: the rule follows the first row if there are more."""
    rows = F.transform(grid, row_markdown)
    first, rest = F.slice(rows, 1, 1), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    ruled = F.concat(first, F.array(rule_markdown(F.size(F.get(grid, F.lit(0))))), rest)
    return F.when(F.size(grid) > 1, F.array_join(ruled, "\n")).otherwise(F.array_join(rows, "\n"))


def header_markdown(header: Column) -> Column:
    return F.concat(row_markdown(header), F.lit("\n"), rule_markdown(F.size(header)))


def body_rows(grid: Column, header: Column) -> Column:
    """The rows of a grid without a first one that is its header."""
    return F.when((F.size(grid) > 0) & (F.get(grid, F.lit(0)) == header), F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0)))).otherwise(grid)


def as_number(text: Column) -> Column:
    """Text to double without thousands commas and trailing percent signs; null where it is no number."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), ",", ""), "%+$", "").try_cast("double")


def format_number(value: Column, decimals: Column | bool = False) -> Column:
    """Thousands commas; two decimals unless whole, or always with ``decimals``; ``?`` for null."""
    forced = F.lit(decimals) if isinstance(decimals, bool) else decimals
    whole = ~forced & (F.abs(value - F.bround(value)) < 1e-9) & (F.abs(value) < 1e15)
    return F.when(value.isNull(), "?").when(whole, F.format_number(F.bround(value), 0)).otherwise(F.format_number(value, 2))


def embed_text(heading_path: Column, summary: Column, leading: Column, content: Column, trailing: Column) -> Column:
    """What is embedded: path, summary and surroundings about the content; empty parts dropped."""
    some = lambda c: F.when(c != "", c)
    path = F.when(F.size(heading_path) > 0, F.array_join(heading_path, " > "))
    before = F.when(leading != "", F.concat(F.lit("[before] "), leading))
    after = F.when(trailing != "", F.concat(F.lit("[after] "), trailing))
    return F.concat_ws("\n\n", path, some(summary), before, some(content), after)


def clip(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def display_name(names: Column) -> Column:
    """The first three names, and how many more."""
    shown = F.array_join(F.slice(names, 1, 3), ", ")
    return F.when(F.size(names) > 3, F.concat(shown, F.lit(" +"), (F.size(names) - 3).cast("string"), F.lit(" more"))).otherwise(shown)


def fence(text: Column) -> Column:
    """Prompt delimiters inside a document made harmless by a zero-width space."""
    out = text
    for mark in ("</document>", "</chunk>", "<chunk"):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "​" + mark[1:]))
    return out
