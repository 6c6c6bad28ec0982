"""Record types as Spark schemas, and the fixed names that they use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names that documents, units and edges carry.
MODALITIES = ("text", "document", "image", "audio", "video", "multimodal")
ELEMENT_KINDS = ("heading", "paragraph", "list_item", "table", "figure", "caption", "code", "speech_segment", "visual_event", "other")
TEXT_KINDS = ("paragraph", "list_item", "code", "caption")
UNIT_TYPES = ("section", "table", "figure", "schema_card", "row_group", "procedure", "question_answer", "discussion", "decision", "action_item", "speaker_turn", "visual_scene", "multimodal_event", "video_event", "narrative", "generic")
RELATIONS = ("captions", "captioned_by", "references", "next", "previous", "spoken_by", "schema_of", "has_schema", "parent_of", "child_of", "explains", "illustrated_by", "answered_by", "question_for", "produces_decision", "occurs_during", "performs_action", "occurs_in_scene", "slide_content_of")
#: What an edge of a type is worth when a cut would sever it; other types are worth DEFAULT_IMPORTANCE.
IMPORTANCE = {
    "captions": 1.0, "captioned_by": 1.0, "parent": 0.95, "has_schema": 0.90, "schema_of": 0.90, "answered_by": 0.90, "question_for": 0.90,
    "explains": 0.85, "illustrated_by": 0.85, "occurs_during": 0.80, "occurs_in_scene": 0.80, "slide_content_of": 0.80, "references": 0.75, "next": 0.05,
}
DEFAULT_IMPORTANCE = 0.5

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
#: One row an element; ``pos`` is the reading order within the document.
ELEMENTS = {
    "doc_id": "bigint", "pos": "int", "id": "string", "kind": "string", "text": "string", "level": "int", "parent_id": "string", "page": "int", "bbox": BBOX,
    "t0": "double", "t1": "double", "speaker": "string", "grid": "array<array<string>>", "header_row": "array<string>", "sheet": "string", "caption_ids": "array<string>",
    "visual_summary": "string", "scene": "string", "visual_change_type": "string", "ocr_text": "string", "entities": "array<string>",
    "synthetic": "boolean", "extraction_mode": "string", "data_confidence": "double",
}
RELATIONSHIP = "struct<type:string,target_id:string,confidence:double,evidence:string>"
#: One row a unit; ``seq`` is the order within the document.
UNITS = {
    "doc_id": "bigint", "seq": "int", "id": "string", "content": "string", "modality": "string", "unit_type": "string", "element_kind": "string", "strategy": "string", "reason": "string",
    "heading_path": "array<string>", "document_title": "string", "situating_summary": "string", "leading": "string", "trailing": "string", "tier": "int",
    "page": "int", "bbox": BBOX, "source_uri": "string", "sha256": "string", "t_start": "double", "t_end": "double", "speaker": "string",
    "signals": "map<string,double>", "vetoed_cuts": "array<string>", "escalation_flags": "array<string>", "llm_calls": "int", "cost_usd": "double",
    "relationships": f"array<{RELATIONSHIP}>", "entities": "array<string>", "metadata": "map<string,string>", "token_count": "int",
    "parent_id": "string", "child_ids": "array<string>", "unit_level": "int", "context_completeness": "double", "missing_context": "array<string>", "attached_context": "array<string>",
    "member_ids": "array<string>", "first_pos": "int",
}


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """All of ``columns`` in order with their types; those that ``df`` lacks are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def elements(df: DataFrame) -> DataFrame:
    """An element table: missing columns null, unknown kinds ``other``, missing ids made of the position."""
    out = conform(df, ELEMENTS)
    return out.withColumn("kind", F.when(F.col("kind").isin(*ELEMENT_KINDS), F.col("kind")).otherwise("other")).withColumn("id", F.coalesce("id", F.concat(F.lit("el_"), F.col("pos")))).withColumn("text", F.coalesce("text", F.lit("")))


def units(df: DataFrame) -> DataFrame:
    return conform(df, UNITS)


def ddl(columns: dict[str, str]) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in columns.items()))
