"""Graph, boundaries, chunkers, temporal units, quality, evaluation, sources and sinks."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import boundary, chunk, enrich, evaluate, links, profile, quality, tabular, temporal, usage
from tessera.operators import graph as g
from tessera.plans.engine import Config, process
from tessera.schema import ELEMENTS, ddl, elements as as_elements, units as as_units
from tessera.sinks import tables as sinks
from tessera.sources import contract, files, html, media, text
from tessera.streaming import events


def make(spark, rows, doc=1):
    full = [{**{c: None for c in ELEMENTS}, "doc_id": doc, "pos": k, "id": f"e{k}", "kind": "paragraph", "text": "", **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in ELEMENTS) for r in full], ddl(ELEMENTS))


def edges_of(df):
    return {(r.src, r.dst): r.type for r in g.build_edges(df).collect()}


LONG = "A paragraph of prose that is long enough to count as context for what stands near it."


def test_hierarchy_and_captions(spark):
    e = make(spark, [{"kind": "heading", "text": "H", "level": 1}, {"text": LONG, "parent_id": "e0"}, {"kind": "caption", "text": "Table 4: x"}, {"kind": "table", "text": "t", "grid": [["a"]], "caption_ids": ["e2", "gone"]}, {"text": "See table 4 and Table 1, Figure 9."}])
    got = edges_of(e)
    assert got[("e0", "e1")] == "parent" and got[("e2", "e3")] == "captions" and got[("e3", "e2")] == "captioned_by" and got[("e4", "e3")] == "references"
    assert got[("e1", "e2")] == "next" and ("e2", "e4") not in got


def test_explains_unless_linked(spark):
    e = make(spark, [{"text": LONG}, {"kind": "table", "text": "t"}, {"text": "Table 1 " + LONG}, {"kind": "figure"}, {"text": "short"}, {"kind": "figure"}])
    got = edges_of(e)
    assert got[("e0", "e1")] == "explains" and got[("e1", "e0")] == "illustrated_by" and got[("e2", "e3")] == "explains" and got[("e4", "e5")] == "next"


def test_question_overwrites_parent(spark):
    got = edges_of(make(spark, [{"kind": "heading", "text": "What is it?"}, {"text": "That.", "parent_id": "e0"}]))
    assert got == {("e0", "e1"): "answered_by", ("e1", "e0"): "question_for"}


def test_box_captions(spark):
    box = lambda y: (0.0, float(y), 100.0, float(y) + 10)
    e = make(spark, [{"kind": "figure", "page": 1, "bbox": box(0)}, {"kind": "figure", "page": 1, "bbox": box(60)}, {"kind": "caption", "text": "A", "page": 1, "bbox": box(15)}, {"kind": "caption", "text": "B", "page": 1, "bbox": box(90)}, {"kind": "caption", "text": "far", "page": 2, "bbox": box(0)}])
    got = {k: v for k, v in edges_of(e).items() if v == "captions"}
    assert got == {("e2", "e0"): "captions", ("e3", "e1"): "captions"}


def test_overlap(spark):
    e = make(spark, [{"kind": "speech_segment", "t0": 0.0, "t1": 130.0}, {"kind": "visual_event", "t0": 5.0, "t1": 125.0}, {"kind": "visual_event", "t0": 130.0, "t1": 140.0}])
    assert [(r.speech, r.visual) for r in g.overlaps(e).collect()] == [("e0", "e1")]


def test_paths_and_surroundings(spark):
    e = make(spark, [{"kind": "heading", "text": "A"}, {"kind": "heading", "text": "B", "parent_id": "e0"}, {"text": LONG, "parent_id": "e1"}, {"kind": "figure", "parent_id": "e1"}, {"text": "tiny"}, {"text": LONG + "!"}, {"text": "c", "parent_id": "e7"}, {"text": "d", "parent_id": "e6"}])
    paths = {r.id: r.path for r in g.heading_paths(e).collect()}
    assert paths["e2"] == ["A", "B"] and paths["e1"] == ["A"] and len(paths["e6"]) == 2
    around = {r.id: (r.leading, r.trailing) for r in g.surrounding_text(e).collect()}
    assert around["e3"] == (LONG, LONG + "!") and around["e0"] == (None, None) and around["e1"][1] == LONG


def signals(df):
    edges = g.build_edges(df)
    return {r.pos: r for r in boundary.candidates(df, edges).collect()}


def test_signals(spark):
    c = signals(make(spark, [{"text": "p"}, {"kind": "heading", "text": "H", "level": 2}, {"text": "q"}, {"kind": "list_item"}, {"kind": "list_item"}]))
    assert c[1].structural_strength == pytest.approx(0.85) and c[1].is_hard and c[2].vetoes[0].startswith("would strand heading") and c[4].list_continuation == 1.0
    c = signals(make(spark, [{"kind": "speech_segment", "t0": 0.0, "t1": 10.0, "speaker": "A", "visual_summary": "x", "ocr_text": "o"}, {"kind": "speech_segment", "t0": 12.5, "t1": 22.0, "speaker": "B", "visual_summary": "y", "ocr_text": "p"}]))[1]
    assert (c.speaker_change, c.visual_change, c.ocr_change, c.pause_strength) == (1.0, 0.85, 0.8, None) and c.multimodal_consensus >= 0.8
    c = signals(make(spark, [{"kind": "visual_event", "visual_change_type": "shot"}, {"kind": "speech_segment"}]))[1]
    assert c.visual_change == 0.35
    cap = signals(make(spark, [{"text": "p"}, {"kind": "caption", "text": "c"}, {"kind": "figure", "caption_ids": ["e1"]}]))
    assert "caption pair" in cap[2].vetoes[0]


def test_separation(spark):
    e = make(spark, [{"kind": "heading", "text": "A"}, {"text": "x", "parent_id": "e0"}, {"kind": "heading", "text": "B"}, {"text": "y", "parent_id": "e2"}])
    s = {r.pos: r.graph_separation for r in g.separation(e, g.build_edges(e)).collect()}
    assert s == {1: 0.1, 2: 0.95, 3: 0.1}


def test_section_is_cut_before_its_last_paragraph(spark):
    para = " ".join(["word"] * 300)
    e = make(spark, [{"kind": "heading", "text": "H"}, *[{"text": para, "parent_id": "e0"} for _ in range(4)]])
    cuts = chunk.cut_regions(chunk.sections(e), g.build_edges(e))
    units = {r.unit: r for r in chunk.text_units(e, cuts).collect()}
    assert [units[k].n_elements for k in sorted(units)] == [4, 1] and units[0].was_cut and not units[0].overflow
    whole = chunk.cut_regions(chunk.sections(make(spark, [{"kind": "heading", "text": "H"}, {"text": " ".join(["w"] * 900), "parent_id": "e0"}])), g.build_edges(e)).collect()
    assert {r.unit for r in whole} == {0} and all(r.overflow for r in whole)


def cuts_by_hand(tokens, target=500, most=700):
    """Prose without headings: the cut nearest to the target, the earliest of equals, again and again."""
    out, todo = [], [(0, len(tokens))]
    while todo:
        a, b = todo.pop()
        if sum(tokens[a:b]) <= most or b - a < 2:
            out.append((a, b))
            continue
        score = [round(0.4 - 0.6 * abs(sum(tokens[a:k]) - target) / target, 9) for k in range(a + 1, b)]
        k = a + 1 + score.index(max(score))
        out.append((a, k))
        todo.append((k, b))
    return out


def test_adaptive_cut_against_plain_walk(spark):
    r = random.Random(1)
    for doc in range(4):
        sizes = [r.randrange(1, 400) for _ in range(30)]
        e = make(spark, [{"text": " ".join(["w"] * n)} for n in sizes], doc)
        got = {}
        for x in chunk.cut_regions(e.withColumn("region", F.lit(0)), g.build_edges(e)).collect():
            got.setdefault(x.unit, []).append(x.pos)
        assert [(min(p), max(p) + 1) for _, p in sorted(got.items())] == cuts_by_hand(sizes)


def test_large_table_repeats_header(spark):
    grid = [["name", "value"], *[[f"row {k}", "x " * 10] for k in range(80)]]
    e = make(spark, [{"kind": "caption", "text": "Table 1: all"}, {"kind": "table", "text": "word " * 900, "grid": grid, "header_row": grid[0], "caption_ids": ["e0"]}, {"kind": "figure", "page": 3}])
    u = chunk.atomic_floats(e).orderBy("pos", "part").collect()
    parts = [x for x in u if x.kind == "table"]
    assert len(parts) > 1 and all("| name | value |" in x.content and "Table 1: all" in x.content for x in parts)
    assert sum(x.content.count("| row ") for x in parts) == 80 and u[-1].content == "[uncaptioned figure on page 3]"


VALUES = [
    (["17", "-4", "0", "993", "12"], "integer"),
    (["0.25", "17", "-3.5", "88.125"], "decimal"),
    (["1999-07-21", "2003-02-08", "2011-10-30"], "date"),
    (["teal", "ochre", "teal", "teal", "ochre"], "categorical"),
    (["7%", "31.25%", "100%"], "percentage"),
    ([f"lot/{7 * k}" for k in range(35)], "identifier"),
    (["false", "true", "true"], "boolean"),
    (["", "", "n/a"], "empty"),
    ([f"{k} remarks " + "of some length " * 7 for k in range(4)] * 6, "text"),
]


@pytest.mark.parametrize("values, dtype", VALUES)
def test_dtypes(spark, values, dtype):
    cells = spark.createDataFrame([(k, "c", 0, v) for k, v in enumerate(values)], "pos long, column string, position int, value string")
    assert tabular.profile_columns(cells).first().dtype == dtype


def test_column_numbers(spark):
    cells = spark.createDataFrame([(k, "c", 0, v) for k, v in enumerate(["10", "", "30", "n/a", "20", "10"])], "pos long, column string, position int, value string")
    p = tabular.profile_columns(cells).first()
    assert (p.nulls, p.non_null, p.n_distinct, p.minimum, p.maximum, p.mean, p.examples) == (2, 4, 3, 10.0, 30.0, 17.5, ["10", "30"])


def test_row_groups(spark):
    grid = [["a", "b"], *[[str(k), "v" * 3] for k in range(200)]]
    e = make(spark, [{"kind": "table", "grid": grid, "header_row": grid[0]}])
    rows = tabular.row_groups(e, 200).orderBy("grp").collect()
    assert len(rows) > 1 and sum(x.n_rows for x in rows) == 200 and rows[0].first_row == 2 and rows[-1].last_row == 201 and all(x.content.startswith("| a | b |\n|---|---|\n") for x in rows)


def seg(t0, t1, speaker, text="words", **more):
    return {"kind": "speech_segment", "t0": float(t0), "t1": float(t1), "speaker": speaker, "text": text, **more}


def test_turns(spark):
    u = temporal.temporal_units(make(spark, [seg(0, 9, "A", "Long opening"), seg(9.2, 11, "B", "Agreed.")])).orderBy("turn").collect()
    assert [x.speaker for x in u] == ["A", "B"]
    assert temporal.temporal_units(make(spark, [seg(0, 9, "A"), seg(9.1, 9.6, None, "Mm.")])).count() == 1
    u = temporal.temporal_units(make(spark, [seg(0, 4, "A", visual_summary="title slide"), seg(4, 9, "A", visual_summary="bar chart")])).first()
    assert u.visual_summary == "title slide · bar chart"


def test_long_turns_against_recursion(spark):
    def by_hand(s):
        if len(s) < 2 or s[-1][1] - s[0][0] <= 120:
            return [s]
        _, k = max((s[i][0] - s[i - 1][1], i) for i in range(1, len(s)))
        return by_hand(s[:k]) + by_hand(s[k:])

    r, at, segs = random.Random(2), 0.0, []
    for _ in range(60):
        at += r.choice([1, 1, 5, 9])
        segs.append((at, at + r.randrange(1, 30)))
        at = segs[-1][1]
    want = [len(x) for x in by_hand(segs)]
    u = temporal.temporal_units(make(spark, [seg(a, b, "A", "w") for a, b in segs])).orderBy("first_pos").collect()
    assert [len(x.member_ids) for x in u] == want


@pytest.mark.parametrize("lines, want", [([("A", "What is the plan?"), ("B", "This one.")], "question_answer"), ([("A", "So we agreed to go."), ("B", "Yes")], "decision"), ([("A", "New action item for Bob")], "action_item"), ([("A", "hi"), ("B", "ho")], "discussion"), ([("A", "hi")], "speaker_turn"), ([(None, "hi")], "narrative")])
def test_dialogues(spark, lines, want):
    df = spark.createDataFrame([(1, k, s, t) for k, (s, t) in enumerate(lines)], "doc_id int, pos int, speaker string, text string")
    assert temporal.classify_dialogues(df, ["doc_id"]).first().unit_type == want


def test_event_windows(spark):
    vis = lambda t0, t1, **m: {"kind": "visual_event", "t0": float(t0), "t1": float(t1), "text": "seen", **m}
    e = make(spark, [vis(0, 15, visual_summary="a", visual_change_type="scene", entities=["Chart"]), seg(1, 8, "A", "hello", entities=["chart"]), seg(9, 14, "A", "more"), vis(15, 30, visual_summary="b", visual_change_type="scene"), seg(18, 30, "B", "reply", ocr_text="z")])
    u = temporal.multimodal_units(e, g.build_edges(e)).orderBy("t_start").collect()
    assert [x.t_start for x in u] == sorted(x.t_start for x in u) and u[0].leading is None and "Last speaker: A" in u[-1].leading
    assert u[0].fusion_label in ("medium", "strong") and u[0].content.startswith("Visual [") and all(x.unit_type in ("video_event", "question_answer") for x in u)


def test_completeness(spark):
    base = {"doc_id": 1, "seq": 0, "id": "u", "modality": "document", "element_kind": "prose", "heading_path": [], "metadata": {}, "signals": {}, "relationships": []}
    make_unit = lambda **m: as_units(spark.createDataFrame([{**base, **m}], "doc_id long, seq int, id string, modality string, element_kind string, heading_path array<string>, metadata map<string,string>, signals map<string,double>, relationships array<struct<type:string,target_id:string,confidence:double,evidence:string>>, content string, leading string, t_start double, speaker string"))
    assert quality.completeness(make_unit(content="As shown above, it holds.")).first().context_completeness == 0.0
    assert quality.completeness(make_unit(content="As shown above, it holds.", heading_path=["A"], leading="before")).first().context_completeness == 1.0
    x = quality.completeness(make_unit(content="hi", modality="audio", t_start=0.0)).first()
    assert x.context_completeness == 0.5 and x.missing_context == ["unattributed speaker in speech segment"]


def test_routes(spark):
    head = [{"kind": "heading", "text": "H"}] * 3
    for rows, want in (([seg(0, 1, "A")], "temporal"), ([{"kind": "table", "text": "a " * 40, "grid": [["a"]]}, {"text": "b"}], "tabular"), ([*head, {"text": "p"}], "structural"), ([{"text": "p"}], "paragraph_fallback")):
        assert profile.route(profile.build_profile(make(spark, rows))).first().route == want
    assert profile.route(profile.build_profile(make(spark, [{"text": "p"}])), embedder=True).first().route == "semantic"


def test_engine_over_every_route(spark):
    grid = [["id", "share"], *[[str(k), f"{k}%"] for k in range(60)]]
    e = make(spark, [{"kind": "heading", "text": "T", "level": 1}, {"text": LONG, "parent_id": "e0"}, {"kind": "heading", "text": "S", "level": 2, "parent_id": "e0"}, {"text": "See Table 1. " + LONG, "parent_id": "e2"}, {"kind": "table", "text": "x", "grid": [["a"], ["1"]], "parent_id": "e2"}, {"kind": "heading", "text": "U", "level": 2, "parent_id": "e0"}, {"text": LONG, "parent_id": "e5"}], 1)
    e = e.unionByName(make(spark, [{"kind": "table", "text": "cell " * 50, "grid": grid, "sheet": "Q1"}], 2)).unionByName(make(spark, [seg(0, 4, "A"), seg(5, 9, "B")], 3)).unionByName(make(spark, [{"kind": "visual_event", "t0": 0.0, "t1": 9.0, "text": "v"}, seg(1, 4, "A")], 4)).unionByName(make(spark, [{"text": LONG}], 5))
    docs = spark.createDataFrame([(2, "Sales", "/data/sales.csv", "00")], "doc_id long, title string, source_uri string, sha256 string")
    r = process(e, docs)
    u = r.units.collect()
    by = {d: sorted((x for x in u if x.doc_id == d), key=lambda x: x.seq) for d in range(1, 6)}
    assert {x.strategy for x in by[1]} == {"structural", "atomic"} and by[2][0].unit_type == "schema_card" and by[2][0].document_title == "Sales" and "sheet “Q1”" in by[2][0].content
    assert {x.strategy for x in by[3]} == {"temporal"} and {x.strategy for x in by[4]} == {"universal_boundary"} and by[5][0].strategy == "paragraph_fallback"
    assert any(l.type == "references" for x in by[1] for l in x.relationships) and any(l.type == "has_schema" for l in by[2][1].relationships)
    assert by[2][0].child_ids and by[2][1].parent_id == by[2][0].id and len({x.id for x in u}) == len(u)
    assert {x.route_actual for x in r.profile.collect()} >= {"temporal", "tabular", "structural"}
    with pytest.raises(ValueError):
        Config(target_tokens=900, max_tokens=700)


def test_scorecard(spark):
    t = lambda rows: evaluate.context_score(spark.createDataFrame(rows, "metric string, preserved int, total int")).first().cps_pct
    assert t([("a", 1, 1), ("b", 1, 100)]) == 50.5 and t([("a", 0, 0)]) is None


def test_retrieval(spark):
    units = spark.createDataFrame([("u0", 0, "alpha beta"), ("u1", 1, "gamma"), ("u2", 2, "beta gamma delta")], "unit_id string, seq int, text string")
    q = spark.createDataFrame([(0, "beta gamma"), (1, "none of it")], "query_id int, text string")
    rel = spark.createDataFrame([(0, "u2"), (1, "u1")], "query_id int, unit_id string")
    got = {r.query_id: r for r in evaluate.retrieval(units, q, rel, 2).collect()}
    assert (got[0].recall, got[0].precision, got[0].reciprocal_rank) == (1.0, 0.5, 1.0) and (got[1].hits, got[1].reciprocal_rank) == (1, 0.0)


def test_costs(spark):
    calls = spark.createDataFrame([("gemini-2.5-flash", 10**6, 10**6, 0), ("ollama/x", 5, 5, 0), ("gemini-2.5-flash-lite", 10**6, 0, 0), ("new", 10**6, 0, 0)], "model string, in_tokens long, out_tokens long, cached_tokens long")
    got = {r.model: r for r in usage.ledger(calls).collect()}
    assert got["gemini-2.5-flash"].cost_usd == 2.8 and got["ollama/x"].cost_usd == 0 and got["gemini-2.5-flash-lite"].cost_usd == 0.3 and got["new"].estimated
    assert usage.totals(usage.ledger(calls)).first().calls == 4


def test_enrichment(spark):
    rows = [(1, k, f"u{k}", f"text {k}", ["flag"], 50) for k in range(12)]
    u = as_units(spark.createDataFrame(rows, "doc_id long, seq int, id string, content string, escalation_flags array<string>, token_count int"))
    flagged = enrich.batches_of_flagged(u)
    asked = enrich.prompts(flagged, spark.createDataFrame([(1, "whole text")], "doc_id long, text string"))

    def provider(prompt):
        import re

        ids = re.findall(r'id="(\w+)"', prompt)
        if "u6" in ids:
            raise RuntimeError("down")
        return json.dumps([{"id": i, "summary": f"about {i}", "entities": ["E"] * 9} for i in ids]), 100, 10, 0

    answers, calls = enrich.ask(asked, provider, "gemini-2.5-flash")
    out = enrich.apply_answers(u, answers, "gemini-2.5-flash").collect()
    done = [x for x in out if x.situating_summary]
    assert len(done) == 6 and all(x.tier == 2 and len(x.entities) == 8 for x in done)
    s = enrich.summary_row(enrich.apply_answers(u, answers, "gemini-2.5-flash"), calls).first()
    assert (s.flagged, s.enriched, s.calls, s.failed, s.calls_saved) == (12, 6, 2, 1, 10)
    assert enrich.choose_provider("auto", {"gemini": provider, "ollama/x": provider})[0] == "ollama/x" and enrich.choose_provider("no", {})[0] == "none"
    answers = iter([(500, {}, ""), (429, {"Retry-After": "99"}, ""), (200, {}, "ok")])
    waits = []
    assert enrich.with_retries(lambda: next(answers), sleep=waits.append) == "ok" and waits[1] == 20.0
    named = spark.createDataFrame([(1, "u1", ["X"])], "doc_id long, id string, found array<string>")
    assert enrich.merge_entities(u, named).filter("id = 'u1'").first().entities == ["X"] and enrich.parse_json("```json\n[1]\n```") == [1] and enrich.parse_json("no") is None


def test_links(spark):
    u = as_units(spark.createDataFrame([(1, 0, "a", ["H"], "text", "section"), (1, 1, "b", ["H"], "see report.pdf now", "narrative"), (2, 0, "c", [], "x", "narrative")], "doc_id long, seq int, id string, heading_path array<string>, content string, unit_type string"))
    assert [(r.parent, r.child) for r in links.hierarchy_links(u).collect()] == [("a", "b")]
    f = spark.createDataFrame([(1, "mine.txt"), (2, "report.pdf")], "doc_id long, name string")
    assert [(r.src, r.dst) for r in links.mentions(u, f).collect()] == [("b", "c")]
    odd = as_units(spark.createDataFrame([(1, 0, "a", "MyReports and abc.txt", "narrative"), (1, 1, "b", None, "narrative"), (2, 0, "c", "", "narrative"), (2, 1, "d", "x", "section"), (3, 0, "e", "report", "narrative")], "doc_id long, seq int, id string, content string, unit_type string"))
    g = spark.createDataFrame([(1, None), (2, "Report.PDF"), (3, "abc.txt")], "doc_id long, name string")
    # within a longer word and in either case; a name of three letters before its extension counts for nothing
    assert sorted((r.src, r.dst) for r in links.mentions(odd, g).collect()) == [("a", "d"), ("e", "d")]
    assert links.mentions(odd, g.limit(0)).count() == 0


@pytest.mark.parametrize("span", [7, 1 << 18])
def test_mentions_equal_brute_force_and_only_names_leave_the_texts(spark, monkeypatch, span):
    monkeypatch.setattr(links, "SPAN", span)
    r = random.Random(5)
    names = [(d, "".join(r.choice("aé😀1") for _ in range(r.randrange(3, 8))) + r.choice(["", ".txt", ".a.B"])) for d in range(60)]
    texts = [(d, f"u{d}", "".join(r.choice("aÉ😀1") for _ in range(r.randrange(60))) + r.choice([n for _, n in names])[: r.randrange(4, 12)]) for d in range(120)]
    u = as_units(spark.createDataFrame([(*x, 0, "narrative") for x in texts], "doc_id long, id string, content string, seq int, unit_type string"))
    got = {(x.src_doc, x.dst_doc) for x in links.mentions(u, spark.createDataFrame(names, "doc_id long, name string")).collect()}
    keys = {(d, k) for d, n in names for k in (n.lower(), n.lower().rsplit(".", 1)[0]) if len(n.rsplit(".", 1)[0]) > 3}
    want = {(s, d) for s, _, t in texts for d, k in keys if s != d and k in t.lower()}
    assert got == want and len(want) > 100
    # two texts beside each other name nothing that neither does, and prose leaves no row
    said = spark.createDataFrame([(1, "a", "the end of no"), (1, "b", "te77 " + "and more of it " * 50), (2, "c", "my_note77.txt")], "src_doc long, src string, content string").coalesce(1)
    keys = spark.createDataFrame([(9, "note77"), (9, "note77.txt")], "dst_doc long, key string")
    assert sorted(tuple(x) for x in links._named(said, keys).collect()) == [(2, "c", "note77"), (2, "c", "note77.txt")]


def test_a_run_leaves_no_shuffled_texts_behind(spark):
    """What a run holds on disk at its end: the tables that its results read, no shuffle of whole texts."""
    r = random.Random(3)
    rows = [(d, p, "paragraph", " ".join(f"{r.randrange(10**9):x}" for _ in range(300))) for d in range(40) for p in range(8)]
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {f.getPath(): f.length() for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle_")}

    before = shuffled()
    e = as_elements(spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string"))
    out = process(e)
    left = sum(n for path, n in shuffled().items() if path not in before)
    assert left < 0.2 * sum(len(x[3]) for x in rows)
    run = os.path.dirname(out.elements.inputFiles()[0].removeprefix("file://")) + "/.."
    assert set(os.listdir(run)) == {"edges", "elements", "profile", "units"}
    assert out.units.filter("strategy = 'paragraph_fallback'").count() == out.units.count() > 40


CONTRACT = {"contract": 1, "source_uri": "v.mp4", "elements": [{"id": "s0", "kind": "speech_segment", "text": " hi ", "t0": 0.0, "t1": 4.2, "speaker": "P", "meta": {"visual_summary": "slide"}}, {"kind": "paragrahp", "text": "x", "parent_id": "s0"}]}


def test_contract(spark):
    rows = [(1, "video_long_name.json", json.dumps(CONTRACT)), (2, "b.json", json.dumps({"contract": 99, "elements": [{}]})), (3, "c.json", "nope"), (4, "d.json", json.dumps({"contract": 1})), (5, "e.json", json.dumps({"contract": 1, "units": [{"content": "c d", "relationships": [{"type": "odd", "target_id": "z"}, {"type": "next", "target_id": "z"}]}]}))]
    f = spark.createDataFrame(rows, "doc_id long, name string, text string")
    e = contract.contract_elements(f).orderBy("pos").collect()
    assert [(x.id, x.kind, x.text, x.parent_id) for x in e] == [("video_long_n_s0", "speech_segment", "hi", None), ("video_long_n_1", "other", "x", "video_long_n_s0")] and e[0].visual_summary == "slide"
    u = contract.contract_units(f).first()
    assert (u.id, u.modality, u.token_count, [r.target_id for r in u.relationships], u.context_completeness) == ("e_0", "video", 2, ["e_z"], 1.0)
    assert {r.doc_id: r.problem for r in contract.parse(f).filter("problem IS NOT NULL").collect()} == {2: "unsupported contract version 99; this build speaks 1", 3: "c.json is not valid JSON", 4: "contract file contains neither 'units' nor 'elements'"}
    with pytest.raises(ValueError, match="unsupported contract version"):
        contract.check(f.filter("doc_id = 2"))


def test_files(spark, tmp_path):
    for name, body in {"a.md": "# T\n\ntext", "b.csv": 'x,y\n1,"a,b"\n', "c.html": "<nav><p>no</p></nav><h1>H</h1><p>p &amp; q</p><table><tr><th>k</th></tr><tr><td>1</td></tr></table>", "d.txt": "one\n\ntwo", "e.json": json.dumps(CONTRACT), "f.pdf": "%PDF"}.items():
        (tmp_path / name).write_text(body)
    f = files.read_files(spark, str(tmp_path))
    files.check_uploads(f)
    with pytest.raises(ValueError, match="at most 2 files"):
        files.check_uploads(f, max_files=2)
    e = files.file_elements(f)
    kinds = {(r.name, r.kind) for r in e.join(f.select("doc_id", "name"), "doc_id").select("name", "kind").collect()}
    assert {("a.md", "heading"), ("b.csv", "table"), ("c.html", "heading"), ("c.html", "table"), ("d.txt", "paragraph"), ("e.json", "speech_segment")} <= kinds
    assert [r.name for r in files.skipped(f, e).collect()] == ["f.pdf"]
    grid = e.filter("kind = 'table'").join(f.filter("name = 'b.csv'").select("doc_id"), "doc_id").first().grid
    assert grid == [["x", "y"], ["1", "a,b"]]
    again = spark.createDataFrame([("x.txt", "/a"), ("x.txt", "/b")], "name string, path string")
    assert sorted(r.name for r in files.unique_names(again).collect()) == ["x.txt", "x_1.txt"]


def test_headings(spark):
    rows = [("1 Intro", False), ("1.1 Part", False), ("Aside", False), ("2 More", False)]
    e = make(spark, [{"kind": "heading", "text": t} for t, _ in rows] + [{"text": "p"}])
    got = {r.pos: (r.level, r.parent_id) for r in text.heading_stack(e).collect()}
    assert got == {0: (2, None), 1: (3, "e0"), 2: (4, "e1"), 3: (2, None), 4: (None, "e3")}


def test_headings_under_a_title(spark):
    rows = [("The title", True), ("Plain section", False), ("1 Intro", False), ("1.1 Part", False), ("Aside", False), ("Next aside", False)]
    e = make(spark, [{"kind": "heading", "text": t} for t, _ in rows] + [{"text": "p"}])
    titles = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "pos int, is_title boolean")
    got = {r.pos: (r.level, r.parent_id) for r in text.heading_stack(e.join(titles, "pos", "left")).collect()}
    assert got == {0: (1, None), 1: (2, None), 2: (2, None), 3: (3, "e2"), 4: (4, "e3"), 5: (4, "e3"), 6: (None, "e3")}


def test_media(spark):
    f = spark.createDataFrame([(1, "my_talk.mp4", bytearray(b"x"))], "doc_id long, name string, content binary")
    answers = media.ask_worker(f, lambda name, content: json.dumps([{"text": "hi", "start": 0, "end": 1, "speaker": "S"}, {"text": " "}]))
    assert [r.text for r in media.speech_elements(answers).collect()] == ["hi"]
    down = media.ask_worker(f, lambda name, content: 1 / 0).first()
    assert down.answer is None and "division" in down.problem
    scenes = spark.createDataFrame([(1, json.dumps([{"t0": 0.0, "speech": "hello", "visual": "a room", "on_screen_text": "T"}]))], "doc_id long, answer string")
    s = media.scene_elements(scenes).orderBy("pos").collect()
    assert [x.kind for x in s] == ["speech_segment", "visual_event"] and s[1].text == "[Scene 1] a room | On-screen Text: T" and s[0].t1 == 5.0
    v = spark.createDataFrame([(1, json.dumps([{"text": "x", "visual_change_type": "shot", "t0": 1.0}]))], "doc_id long, answer string")
    assert media.video_elements(v).first().visual_change_type == "shot"
    assert media.image_elements(spark.createDataFrame([(1, "a.png", json.dumps({"description": "cat", "ocr_text": "meow"})), (2, "b.png", "{}")], "doc_id long, name string, answer string")).count() == 3
    assert media.stand_in_video(f, 7).filter("synthetic").count() == 7 and media.stand_in_speech(f, 3).count() == 3


def test_exports_and_sinks(spark, tmp_path):
    u = as_units(spark.createDataFrame([(1, 0, "a", "body", ["H", "I"], [("references", "b", 1.0, None), ("references", "c", 1.0, None)])], "doc_id long, seq int, id string, content string, heading_path array<string>, relationships array<struct<type:string,target_id:string,confidence:double,evidence:string>>"))
    assert sinks.export_units(u, "langchain").first().page_content == "H > I\n\nbody"
    assert sinks.export_units(u, "llamaindex").first().relationships == {"references": "c"}
    assert sinks.export_units(u, "qdrant").first().payload.raw_content == "body" and sinks.chroma_document(u).first().ids == ["a"]
    with pytest.raises(ValueError):
        sinks.export_units(u, "other")
    r = process(make(spark, [{"text": LONG}]))
    sinks.write_artifacts(r, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/units")).count() == 1
    nodes, edges = sinks.graph_tables(u)
    assert nodes.count() == 1 and edges.count() == 2
    sinks.append_usage(spark.createDataFrame([("m", 1, 1, 0)], "model string, in_tokens long, out_tokens long, cached_tokens long"), str(tmp_path / "usage"))
    assert spark.read.parquet(str(tmp_path / "usage")).count() == 1
    vec = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>")
    assert sinks.vector_rows(u, vec).first().payload.id == "a"


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k % 3, f"2026-01-01T{k % 24:02d}:{(7 * k) % 60:02d}:00", float(k)) for k in range(60)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text("\n".join(json.dumps({"user_id": u, "ts": t, "value": v, "event_type": "e"}) for u, t, v in rows))
    schema = "user_id long, ts timestamp, value double, event_type string"
    stream = events.file_events(spark, str(tmp_path / "in"), schema)
    q = events.sessions(stream, "2 hours", "0 seconds").writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = events.sessions(spark.read.schema(schema).json(str(tmp_path / "in")), "2 hours")
    assert sorted(map(tuple, spark.table("s").collect())) == sorted(map(tuple, batch.collect()))
    w = events.run_to(events.tumbling(stream, "1 hour", "0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    w.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_short_probes_are_all_found(spark):
    from tessera.operators.links import containments

    docs = spark.createDataFrame([(1, " ".join(f"x{k:04}y" for k in range(1500))), (2, "none")], "doc_id long, text string")
    probes = spark.createDataFrame([(k, f"{k:04}y") for k in range(1500)] + [(9000 + k, f"{k:04}y x{k + 1:04}") for k in range(20)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in containments(docs, probes).collect()}
    assert got == {(1, k) for k in [*range(1500), *range(9000, 9020)]}


def test_planted_edges_of_whole_documents(spark, tmp_path):
    from tessera.plans import prose

    text = "\n".join(f"Paragraph {k} has a few words of its own and no more." for k in range(60))
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    n = {x.type: x.n_edges for x in prose.graph_edges_planted(spark, str(tmp_path)).collect()}
    assert n["answered_by"] == 8, n
