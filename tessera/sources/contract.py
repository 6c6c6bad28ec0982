"""The JSON wire format: elements to be chunked, or finished units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import count_tokens
from tessera.schema import ELEMENT_KINDS, RELATIONS, units as as_units

VERSION = 1
_META = "struct<visual_summary:string,scene:string,visual_change_type:string,ocr_text:string,entities:array<string>,grid:array<array<string>>,header_row:array<string>,sheet:string,caption_ids:array<string>,synthetic:boolean,extraction_mode:string,data_confidence:double>"
_ELEMENT = f"struct<id:string,kind:string,text:string,level:int,parent_id:string,page:int,bbox:array<double>,t0:double,t1:double,speaker:string,meta:{_META}>"
_UNIT = (
    "struct<id:string,content:string,modality:string,context:struct<document_title:string,heading_path:array<string>,situating_summary:string,leading:string,trailing:string,tier:int>,"
    "provenance:struct<source_uri:string,source_sha256:string,page:int>,decision:struct<strategy:string,reason:string,signals:map<string,double>,vetoed_cuts:array<string>,escalation_flags:array<string>,llm_calls:int,cost_usd:double>,"
    "relationships:array<struct<type:string,target_id:string,confidence:double,evidence:string>>,temporal:struct<start_s:double,end_s:double,speaker:string>,entities:array<string>,metadata:map<string,string>,token_count:int,"
    "knowledge_unit_type:string,parent_id:string,child_ids:array<string>,level:int,context_completeness:double,missing_context:array<string>>"
)
SCHEMA = f"struct<contract:int,source_uri:string,title:string,elements:array<{_ELEMENT}>,units:array<{_UNIT}>>"


def parse(files: DataFrame) -> DataFrame:
    """``files`` (``doc_id, name, text``) with the parsed ``c`` and ``problem``: why a file can't be used, null if it can."""
    out = files.withColumn("c", F.from_json("text", SCHEMA))
    bad = F.when(F.col("c").isNull() | (F.col("c.contract").isNull() & F.col("c.elements").isNull() & F.col("c.units").isNull()), F.concat("name", F.lit(" is not valid JSON")))
    bad = bad.when(F.coalesce(F.col("c.contract"), F.lit(-1)) != VERSION, F.concat(F.lit("unsupported contract version "), F.coalesce(F.col("c.contract").cast("string"), F.lit("None")), F.lit(f"; this build speaks {VERSION}")))
    bad = bad.when((F.coalesce(F.size("c.elements"), F.lit(0)) <= 0) & (F.coalesce(F.size("c.units"), F.lit(0)) <= 0), "contract file contains neither 'units' nor 'elements'")
    return out.withColumn("problem", bad)


def check(files: DataFrame) -> None:
    """Raise ``ValueError`` with the first problem."""
    r = parse(files).filter("problem IS NOT NULL").select(F.min("problem").alias("p")).first()
    if r.p is not None:
        raise ValueError(r.p)


def prefix(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"\.[^.]*$", ""), 1, 12)


def contract_elements(files: DataFrame) -> DataFrame:
    """Elements of contract files without units; ids are prefixed by the file's name, unknown kinds are ``other``."""
    ok = parse(files).filter((F.col("problem").isNull()) & (F.coalesce(F.size("c.units"), F.lit(0)) <= 0))
    e = ok.select("doc_id", prefix(F.col("name")).alias("p"), F.posexplode("c.elements").alias("pos", "e"))
    named = lambda c: F.concat("p", F.lit("_"), c)
    kind = F.when(F.col("e.kind").isin(*ELEMENT_KINDS), F.col("e.kind")).otherwise("other")
    box = F.when(F.size("e.bbox") == 4, F.struct(*[F.get("e.bbox", F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]))
    meta = ["visual_summary", "scene", "visual_change_type", "ocr_text", "entities", "grid", "header_row", "sheet", "synthetic", "extraction_mode", "data_confidence"]
    return e.select(
        "doc_id", "pos", named(F.coalesce(F.col("e.id"), F.col("pos").cast("string"))).alias("id"), kind.alias("kind"), F.trim(F.coalesce("e.text", F.lit(""))).alias("text"), "e.level", F.when(F.col("e.parent_id") != "", named(F.col("e.parent_id"))).alias("parent_id"),
        "e.page", box.alias("bbox"), "e.t0", "e.t1", "e.speaker", F.transform("e.meta.caption_ids", lambda c: named(c)).alias("caption_ids"), *[F.col(f"e.meta.{m}").alias(m) for m in meta],
    )


def contract_units(files: DataFrame) -> DataFrame:
    """Finished units of contract files; unknown relations are dropped, what is missing gets its default."""
    ok = parse(files).filter(F.col("problem").isNull() & (F.size("c.units") > 0))
    u = ok.select("doc_id", "path" if "path" in files.columns else F.col("name").alias("path"), F.col("c.source_uri").alias("uri"), prefix(F.col("name")).alias("p"), F.posexplode("c.units").alias("seq", "u"))
    named = lambda c: F.concat("p", F.lit("_"), c)
    none = F.array().cast("array<string>")
    rels = F.transform(F.filter("u.relationships", lambda r: r["type"].isin(*RELATIONS)), lambda r: F.struct(r["type"].alias("type"), named(r["target_id"]).alias("target_id"), F.coalesce(r["confidence"], F.lit(1.0)).alias("confidence"), r["evidence"].alias("evidence")))
    content = F.coalesce("u.content", F.lit(""))
    out = u.select(
        "doc_id", "seq", named(F.coalesce("u.id", F.col("seq").cast("string"))).alias("id"), content.alias("content"), F.coalesce("u.modality", F.lit("video")).alias("modality"), F.coalesce(F.nullif("u.knowledge_unit_type", F.lit("")), F.lit("generic")).alias("unit_type"),
        F.coalesce("u.decision.strategy", F.lit("imported")).alias("strategy"), F.coalesce("u.decision.reason", F.lit("produced by an external modality worker")).alias("reason"), F.coalesce("u.context.heading_path", none).alias("heading_path"), "u.context.document_title", "u.context.situating_summary", "u.context.leading", "u.context.trailing", F.coalesce("u.context.tier", F.lit(0)).alias("tier"),
        "u.provenance.page", F.coalesce("u.provenance.source_uri", "uri", "path").alias("source_uri"), F.col("u.provenance.source_sha256").alias("sha256"), F.col("u.temporal.start_s").alias("t_start"), F.col("u.temporal.end_s").alias("t_end"), "u.temporal.speaker", "u.decision.signals", F.coalesce("u.decision.vetoed_cuts", none).alias("vetoed_cuts"), F.coalesce("u.decision.escalation_flags", none).alias("escalation_flags"),
        F.coalesce("u.decision.llm_calls", F.lit(0)).alias("llm_calls"), F.coalesce("u.decision.cost_usd", F.lit(0.0)).alias("cost_usd"), rels.alias("relationships"), F.coalesce("u.entities", none).alias("entities"), "u.metadata",
        F.when(F.coalesce("u.token_count", F.lit(0)) > 0, F.col("u.token_count")).otherwise(count_tokens(content)).alias("token_count"), F.when(F.col("u.parent_id") != "", named(F.col("u.parent_id"))).alias("parent_id"), F.transform(F.coalesce("u.child_ids", none), lambda c: named(c)).alias("child_ids"), F.col("u.level").alias("unit_level"),
        F.coalesce("u.context_completeness", F.lit(1.0)).alias("context_completeness"), F.coalesce("u.missing_context", none).alias("missing_context"),
    )
    return as_units(out)
