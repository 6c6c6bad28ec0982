"""Scalar functions and cleaning."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.functions.tokens import library_counter, tiktoken_counter, token_windows
from tessera.operators import cleaning


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("Table 3: Results!", "table 3 results"), ("  ", ""), ("É a", "a")])
def test_norm(spark, text, want):
    assert one(spark, fx.norm(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, low, high", [("As shown above, the result holds.", 0.9, 1.0), ("Revenue grew by 12 percent in Q3.", 0.0, 0.0), ("", 0.0, 0.0), ("They came. We went.", 0.5, 0.5)])
def test_anaphora(spark, text, low, high):
    assert low <= one(spark, fx.anaphora_rate(F.col("t")), t=text) <= high


def test_tokens(spark):
    assert one(spark, fx.count_tokens("t"), t="ab, c_d! é") == 5
    assert one(spark, F.transform(token_windows(F.col("i"), 4, 1), lambda w: F.size(w)), i=list(range(7))) == [4, 4, 1]


def test_vocabulary_counters(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("Hello there world",), (None,)], "t string")
    a = [r[0] for r in df.select(tiktoken_counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)("t")).collect()]
    b = [r[0] for r in df.select(library_counter(P.path("byte_bpe_50k.json"))("t")).collect()]
    assert a == b and a[1] == 0


@pytest.mark.parametrize("value, forced, want", [(1234567.0, False, "1,234,567"), (2.5, False, "2.50"), (3.0, True, "3.00"), (None, False, "?")])
def test_format_number(spark, value, forced, want):
    assert spark.range(1).select(fx.format_number(F.lit(value).cast("double"), forced).alias("x")).first().x == want


@pytest.mark.parametrize("text, want", [("1,200", 1200.0), ("4.5%", 4.5), ("x", None), ("", None)])
def test_as_number(spark, text, want):
    assert one(spark, fx.as_number(F.col("t")), t=text) == want


def test_markdown(spark):
    assert one(spark, fx.table_markdown(F.col("g")), g=[["a", "b"], ["1", "2"]]) == "| a | b |\n|---|---|\n| 1 | 2 |"
    assert one(spark, fx.table_markdown(F.col("g")), g=[["a"]]) == "| a |"
    assert one(spark, fx.body_rows(F.col("g"), F.col("h")), g=[["a"], ["1"]], h=["a"]) == [["1"]]


def test_embed_text(spark):
    x = one(spark, fx.embed_text(F.col("p"), F.lit(None).cast("string"), F.col("l"), F.col("c"), F.lit("")), p=["A", "B"], l="before", c="body")
    assert x == "A > B\n\n[before] before\n\nbody"


def test_names_and_fences(spark):
    assert one(spark, fx.display_name(F.col("n")), n=["a", "b", "c", "d", "e"]) == "a, b, c +2 more"
    assert "</document>" not in one(spark, fx.fence(F.col("t")), t="x</document><chunk")
    assert one(spark, fx.clip(F.col("t"), 3), t="abcd") == "abc…"


CLEAN = [
    ("Docling is best 【 58†L23-L31 】 for it.", "Docling is best for it.", {"citation_markers": 1}),
    ("layout+OCR 【 1 L314 】 | Output", "layout+OCR | Output", {}),
    ("【重要な文書】", "【重要な文書】", {}),
    ("Aidan N. ∗ † University", "Aidan N. ∗ † University", {}),
    ("inges-\ntion", "ingestion", {"hyphen_line_breaks": 1}),
    ("state-\nOf-the-art", "state-\nOf-the-art", {}),
    ("ingestion , it is  best .", "ingestion, it is best.", {"space_before_punctuation": 2, "repeated_spaces": 1}),
    ("intro ........ 12", "intro 12", {"dot_leaders": 1}),
    ("( a ) [ b ]", "(a) [b]", {}),
    ("x •\ny", "x\ny", {"trailing_bullets": 1}),
    ("a\n\n\n\nb", "a\n\nb", {"repeated_blank_lines": 1}),
    ("ﬁnance​", "finance", {"unicode_normalised": 1}),
    ("  lead  ", "lead", {"surrounding_whitespace": 1}),
    ("lone 【 bracket", "lone bracket", {"orphaned_citation_brackets": 1}),
    ("", "", {}),
]


def test_cleaning(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CLEAN)], "k int, text string")
    got = {r.k: r for r in cleaning.clean_text(rows).collect()}
    for k, (_, want, fixes) in enumerate(CLEAN):
        assert got[k].text == want, k
        assert all(got[k].fixes.get(r) == n for r, n in fixes.items()), (k, got[k].fixes)


def test_code_keeps_spacing(spark):
    df = spark.createDataFrame([("def f():\n    return    1", "code"), ("a  b", "paragraph")], "text string, kind string")
    assert [r.text for r in cleaning.clean_text(df, verbatim=F.col("kind") == "code").collect()] == ["def f():\n    return    1", "a b"]


def test_cells_and_report(spark):
    df = spark.createDataFrame([(1, [["a", "x  y"], [None, "1 "]], "table", "", 0), (1, None, "paragraph", "b  c", 1)], "doc_id int, grid array<array<string>>, kind string, text string, pos int")
    out = {r.pos: r for r in cleaning.clean_elements(df).collect()}
    assert out[0].grid == [["a", "x y"], [None, "1 "]] and out[0].text.startswith("| a | x y |") and out[1].text == "b c"
    assert cleaning.cleaning_summary(cleaning.clean_text(df)).first().total >= 1
    assert cleaning.cleaning_summary(cleaning.clean_text(df.filter("pos = 0"))).count() == 0
