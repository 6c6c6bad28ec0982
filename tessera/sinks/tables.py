"""Where results go: artifacts, exports, vectors, graphs, the ledger, events."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import embed_text
from tessera.operators.graph import graph_rows


def with_embed_text(units: DataFrame) -> DataFrame:
    return units.withColumn("embed_text", embed_text(F.coalesce("heading_path", F.array().cast("array<string>")), F.col("situating_summary"), F.col("leading"), F.col("content"), F.col("trailing")))


def _said() -> Column:
    return F.coalesce(F.nullif("embed_text", F.lit("")), "content")


def serialised(units: DataFrame) -> DataFrame:
    """Units as written: ``embed_text`` added; confidence, seconds and completeness to three decimals, signals to four, cost to six."""
    u = with_embed_text(units)
    rels = F.transform("relationships", lambda r: F.struct(r["type"].alias("type"), r["target_id"].alias("target_id"), F.round(r["confidence"], 3).alias("confidence"), r["evidence"].alias("evidence")))
    return u.withColumns({"relationships": rels, "signals": F.transform_values("signals", lambda _, v: F.round(v, 4)), "cost_usd": F.round("cost_usd", 6), "t_start": F.round("t_start", 3), "t_end": F.round("t_end", 3), "context_completeness": F.round("context_completeness", 3)})


def write_artifacts(result, path: str, by: str | None = None) -> None:
    """Units, graph and profile as tables below ``path``; the store is any that Spark reaches."""
    nodes, edges = graph_rows(result.elements, result.edges)
    for name, df in (("units", serialised(result.units)), ("nodes", nodes), ("edges", edges), ("profile", result.profile)):
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by and by in df.columns else w).parquet(f"{path}/{name}")


def export_units(units: DataFrame, form: str = "json") -> DataFrame:
    """Rows in the shape that a framework loads: ``json``, ``langchain``, ``llamaindex``, ``qdrant`` or ``chroma``."""
    u = with_embed_text(units).withColumn("said", _said())
    none = F.array().cast("array<string>")
    path = F.coalesce("heading_path", none)
    kind = F.coalesce("unit_type", F.lit("generic"))
    if form == "langchain":
        return u.select(F.col("said").alias("page_content"), F.struct("id", "modality", path.alias("heading_path"), "source_uri", "strategy", kind.alias("knowledge_unit_type"), F.coalesce("context_completeness", F.lit(1.0)).alias("context_completeness")).alias("metadata"))
    if form in ("llamaindex", "llama_index"):
        # of several relations of a type the last holds
        rels = F.coalesce("relationships", F.array().cast("array<struct<type:string,target_id:string,confidence:double,evidence:string>>"))
        last = F.map_from_entries(F.transform(F.array_distinct(F.transform(rels, lambda r: r["type"])), lambda t: F.struct(t.alias("k"), F.get(F.transform(F.reverse(F.filter(rels, lambda r: r["type"] == t)), lambda r: r["target_id"]), F.lit(0)).alias("v"))))
        return u.select(F.col("id").alias("id_"), F.col("said").alias("text"), F.struct("modality", F.col("document_title").alias("title"), path.alias("heading_path"), "source_uri", kind.alias("knowledge_unit_type"), F.coalesce("token_count", F.lit(0)).alias("token_count")).alias("extra_info"), last.alias("relationships"))
    if form == "qdrant":
        decision = F.struct("strategy", "reason", "signals", "vetoed_cuts", "escalation_flags", "llm_calls", "cost_usd")
        return u.select("id", F.struct(F.col("said").alias("document"), F.col("content").alias("raw_content"), "modality", path.alias("heading_path"), kind.alias("knowledge_unit_type"), decision.alias("decision"), "relationships").alias("payload"))
    if form == "chroma":
        meta = F.struct("modality", F.coalesce("source_uri", F.lit("")).alias("source"), kind.alias("type"), F.coalesce("strategy", F.lit("")).alias("strategy"))
        return u.select("doc_id", "seq", F.col("id").alias("ids"), F.col("said").alias("documents"), meta.alias("metadatas"))
    if form == "json":
        return serialised(units)
    raise ValueError(f"unknown export format: {form}")


def chroma_document(units: DataFrame) -> DataFrame:
    """The three parallel lists of one document at a time: ``doc_id, ids, documents, metadatas``."""
    rows = export_units(units, "chroma").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "ids", "documents", "metadatas"))).alias("l"))
    return rows.select("doc_id", *[F.col(f"l.{n}").alias(n) for n in ("ids", "documents", "metadatas")])


def vector_rows(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """``point_id, vector`` and a payload; ids are stable hashes."""
    return units.join(vectors.select("id", "vector"), "id").select(F.xxhash64("id").alias("point_id"), "vector", F.struct("id", "doc_id", "content", "modality", "unit_type").alias("payload"))


def graph_tables(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the unit graph, all of them."""
    nodes = units.select("id", "doc_id", "unit_type", "modality", "token_count")
    edges = units.select(F.col("id").alias("src"), F.explode("relationships").alias("r")).select("src", F.col("r.target_id").alias("dst"), F.upper("r.type").alias("type"), F.col("r.confidence").alias("confidence"))
    return nodes, edges


def send_rows(df: DataFrame, send: Callable[[Iterable], None], batch: int = 500) -> None:
    """Hand rows to an outside store from the executors, ``batch`` at a time; ``send`` must take a batch twice without harm."""

    def run(rows):
        held = []
        for r in rows:
            held.append(r.asDict(recursive=True))
            if len(held) == batch:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(run)


def append_usage(calls: DataFrame, path: str) -> None:
    """Add calls to the ledger table; its totals are a view (``operators.usage.ledger``)."""
    calls.write.mode("append").parquet(path)


def publish(events: DataFrame, topic: str, servers: str | None = None, callback: Callable[[list], None] | None = None) -> None:
    """Events as JSON to Kafka, or to a function where no broker is given."""
    out = events.select(F.to_json(F.struct(*events.columns)).alias("value"))
    if servers:
        out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    elif callback:
        send_rows(out, callback)
