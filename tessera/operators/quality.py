"""What a unit lacks to stand alone: escalation flags and context completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import anaphora_rate

# Phrases that point outside of a unit, in the order in which they are looked for.
POINTERS = (
    r"(?i)\bas (shown|described|noted|mentioned|discussed) (above|earlier|previously|below)\b",
    r"(?i)\bthis (table|figure|section|chart|diagram|approach|result|data)\b",
    r"(?i)\bthe (former|latter)\b",
    r"^(This|These|It|They)\b",
    r"(?i)\bsee (table|figure|fig\.?|section)\s+\d+\b",
)
ON_SCREEN = r"(?i)\b(as you can see (here|on (this|the) slide)|on the (left|right|top|bottom)|in this diagram)\b"


def escalation_flags(content: Column, heading_path: Column, strategy: Column, kind: Column | None = None, has_caption: Column | None = None) -> Column:
    rate = anaphora_rate(content)
    kind = kind if kind is not None else F.lit("text")
    has_caption = has_caption if has_caption is not None else F.lit(True)
    return F.array_compact(F.array(
        F.when(rate > 0.10, F.format_string("anaphora rate %.2f — meaning leans on context outside the chunk", rate)),
        F.when((F.coalesce(F.size(heading_path), F.lit(0)) <= 0) & ~strategy.isin("temporal", "atomic"), F.lit("orphan — no heading ancestry to situate it")),
        F.when(kind.isin("table", "figure") & ~has_caption, F.concat(F.lit("uncaptioned "), kind, F.lit(" — nothing states what it shows"))),
    ))


def completeness(units: DataFrame) -> DataFrame:
    """``units`` with ``context_completeness`` (share of checks passed, three decimals), ``missing_context`` and ``attached_context``."""
    c = F.col
    some = lambda name: F.coalesce(c(name) != "", F.lit(False))
    many = lambda name: F.coalesce(F.size(name), F.lit(0)) > 0
    kind = F.coalesce("element_kind", F.lit(""))
    meta = lambda key: F.coalesce(F.element_at("metadata", F.lit(key)), F.lit(""))
    prose = c("modality").isin("document", "text")
    headed = many("heading_path")
    group = kind == "row_group"
    schema = F.exists(F.coalesce("relationships", F.array().cast("array<struct<type:string,target_id:string,confidence:double,evidence:string>>")), lambda r: r["type"] == "has_schema") & (meta("columns") != "")
    is_float = kind.isin("table", "figure")
    captioned = (F.coalesce(F.element_at("signals", F.lit("caption_confidence")), F.lit(0.0)) > 0.5) | (meta("caption") != "")
    found = F.array_compact(F.array(*[F.nullif(F.regexp_extract("content", p, 0), F.lit("")) for p in POINTERS]))
    situated = some("leading") | some("situating_summary") | many("relationships")
    timed = c("t_start").isNotNull()
    audio = (c("modality") == "audio") | timed
    voiced = timed & some("speaker")
    video = (c("modality") == "video") | (timed & (meta("visual_summary") != ""))
    sight = (meta("visual_summary") != "") | (meta("scene") != "")
    pointing = F.col("content").rlike(ON_SCREEN)
    exempt = kind.isin("schema_card", "table")
    checks = [(prose, headed | exempt), (group, schema), (is_float, captioned), (F.lit(True), (F.size(found) == 0) | situated), (audio, voiced), (video, sight | ~pointing)]
    total = sum((F.when(a, 1).otherwise(0) for a, _ in checks), F.lit(0))
    passed = sum((F.when(a & b, 1).otherwise(0) for a, b in checks), F.lit(0))
    missing = F.array_compact(F.array(
        F.when(prose & ~headed & ~exempt, F.lit("missing heading ancestry or document section context")),
        F.when(group & ~schema, F.lit("missing dataset schema card or column headers")),
        F.when(is_float & ~captioned, F.concat(F.lit("uncaptioned "), kind)),
        F.when((F.size(found) > 0) & ~situated, F.concat(F.lit("dangling anaphoric references: "), F.array_join(F.transform(F.slice(found, 1, 3), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "))),
        F.when(audio & ~voiced, F.lit("unattributed speaker in speech segment")),
        F.when(video & ~sight & pointing, F.lit("speech refers to on-screen visual content, but visual metadata is missing")),
    ))
    attached = F.array_compact(F.array(
        F.when(prose & headed, F.concat(F.lit("heading path: "), F.array_join("heading_path", " > "))),
        F.when(group & schema, F.lit("schema card reference and column headers attached")),
        F.when(is_float & captioned, F.lit("caption attached to float")),
        F.when((F.size(found) > 0) & situated, F.concat(F.lit("anaphora situated via surrounding context ("), F.size(found).cast("string"), F.lit(" references)"))),
        F.when(audio & voiced, F.concat(F.lit("speaker attribution: "), "speaker")),
        F.when(video & sight, F.concat(F.lit("visual metadata: "), meta("visual_summary"))),
    ))
    return units.withColumns({"context_completeness": F.round(passed / F.greatest(total, F.lit(1)), 3), "missing_context": missing, "attached_context": attached})
