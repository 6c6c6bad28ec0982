"""From elements to linked, self-describing units: one declarative plan over whole tables of documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import count_tokens
from tessera.operators import chunk, links, quality, tabular, temporal
from tessera.operators.boundary import Weights
from tessera.operators.cleaning import clean_elements
from tessera.operators.graph import build_edges, heading_paths, surrounding_text
from tessera.operators.profile import actual_route, build_profile, route, titles
from tessera.plans.scratch import Scratch
from tessera.schema import ELEMENTS, UNITS, conform
from tessera.schema import elements as as_elements
from tessera.schema import units as as_units


@dataclass(frozen=True)
class Config:
    """Budgets and weights. ``counter`` counts tokens of a column; ``vectors`` (``doc_id, pos, vector``) turn on topic drift."""

    target_tokens: int = chunk.TARGET_TOKENS
    max_tokens: int = chunk.MAX_TOKENS
    tabular_tokens: int = tabular.TARGET_TOKENS
    tabular_max: int = tabular.MAX_TOKENS
    micro_turn: float = temporal.MICRO_TURN
    long_turn: float = temporal.LONG_TURN
    weights: Weights = field(default_factory=Weights)
    counter: object = count_tokens
    normalise: bool = True
    rebalance: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.target_tokens <= self.max_tokens:
            raise ValueError("target_tokens must lie between 1 and max_tokens")
        if self.tabular_tokens <= 0 or self.micro_turn < 0 or self.long_turn <= 0:
            raise ValueError("budgets must be positive")


@dataclass
class Result:
    """What a run makes: all are lazy DataFrames over all documents."""

    elements: DataFrame
    edges: DataFrame
    profile: DataFrame
    units: DataFrame


def _map(**values: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def process(elements: DataFrame, documents: DataFrame | None = None, config: Config = Config(), vectors: DataFrame | None = None) -> Result:
    """Units of every document in ``elements``.

    ``documents`` may give ``doc_id, title, source_uri, sha256``. Each strategy is a branch over the documents
    that are routed to it; routes that no document takes are left out. What is known of an element besides
    its text is made without the text, and texts are shuffled in steps whose files go before the next.
    """
    scratch = Scratch(elements.sparkSession)
    none = F.array().cast("array<string>")
    e = scratch.cut(conform(clean_elements(as_elements(elements), config.normalise), ELEMENTS), "clean")
    edges = scratch.cut(build_edges(e), "edges")
    profile = scratch.cut(route(build_profile(e, config.counter), vectors is not None), "profile")
    routes = {r["route"] for r in profile.select("route").distinct().collect()}
    places = scratch.cut(_places(e, edges, profile, vectors), "places")
    placed = e.join(places, ["doc_id", "pos", "id"], "left").withColumn("path", F.coalesce("path", none))
    placed = scratch.cut(placed, "elements")
    scratch.drop("clean")
    scratch.drop("places")
    e = placed.select(*ELEMENTS)
    title = titles(e, documents)
    routed = placed.filter("route IS NOT NULL").drop("caption_ids").withColumnRenamed("captions", "caption_ids")

    whole = routed.filter("route <> 'tabular'")
    parts = [_atomic(whole.filter("floated"), config), scratch.cut(_prose(whole.filter("region IS NOT NULL"), edges, config, scratch), "prose")]
    scratch.drop("cuts")
    if "temporal" in routes:
        parts.append(_timed(whole.filter("route = 'temporal'"), edges, config))
    if "tabular" in routes:
        parts.append(_datasets(routed.filter("route = 'tabular'"), documents, config))
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p, allowMissingColumns=True)
    seq = Window.partitionBy("doc_id").orderBy("first_pos", "emit")
    raw = raw.withColumn("seq", (F.row_number().over(seq) - 1).cast("int")).withColumn("id", F.concat(F.lit("ku_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("seq").cast("string")))
    raw = raw.join(title.withColumnRenamed("title", "document_title"), "doc_id", "left")
    if documents is not None:
        raw = raw.join(conform(documents, {"doc_id": "bigint", "source_uri": "string", "sha256": "string"}), "doc_id", "left")
    units = scratch.cut(as_units(raw), "units")
    scratch.drop("prose")
    every = links.reference_links(units, edges).unionByName(links.order_links(units)).unionByName(links.schema_links(units))
    units = quality.completeness(links.attach(units, every, links.hierarchy_links(units)))
    return Result(e, edges, actual_route(profile, units.filter(F.col("strategy").isin("structural", "semantic", "paragraph_fallback"))), conform(units, UNITS))


def _places(e: DataFrame, edges: DataFrame, profile: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """What is known of each element besides its text: ``doc_id, pos, id, route, heading_density, captions, floated, path``
    and, of what stays in the stream of prose, ``region, strategy``. ``floated``: its document has tables or figures."""
    p = e.select("doc_id", "pos", "id", "kind", "caption_ids").join(profile.select("doc_id", "route", "heading_density"), "doc_id")
    captioned = edges.filter("type = 'captions'").groupBy("doc_id", F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("__caps"))
    p = p.join(captioned, ["doc_id", "id"], "left").withColumn("caption_ids", F.coalesce("__caps", "caption_ids")).drop("__caps")
    p = p.withColumn("floated", F.max(F.col("kind").isin("table", "figure")).over(Window.partitionBy("doc_id")))
    _, stream = chunk.carve_floats(p.filter("route NOT IN ('tabular', 'temporal')"))
    regions = chunk.sections(stream.filter("route = 'structural'")).withColumn("strategy", F.lit("structural"))
    flat = stream.filter("route <> 'structural'")
    if vectors is not None:
        grouped = chunk.semantic_groups(flat, vectors)
        some = F.max("region").over(Window.partitionBy("doc_id")) > 0
        flat = grouped.withColumn("strategy", F.when(some, "semantic").otherwise("paragraph_fallback"))
    else:
        flat = flat.withColumn("region", F.lit(0).cast("int")).withColumn("strategy", F.lit("paragraph_fallback"))
    regions = regions.unionByName(flat).select("doc_id", "pos", "id", "region", "strategy")
    p = p.withColumnRenamed("caption_ids", "captions").drop("kind").join(regions, ["doc_id", "pos", "id"], "left")
    return p.join(heading_paths(e), ["doc_id", "id"], "left")


def _atomic(e: DataFrame, config: Config) -> DataFrame:
    floats = chunk.atomic_floats(e, config.counter, config.target_tokens, config.max_tokens)
    around = surrounding_text(e).join(e.filter(F.col("kind").isin("table", "figure")).select("doc_id", "id", "path"), ["doc_id", "id"])
    out = floats.join(around, ["doc_id", "id"], "left")
    flags = quality.escalation_flags(F.col("content"), F.col("path"), F.lit("atomic"), F.col("kind"), F.col("caption") != "")
    return out.select(
        "doc_id", F.col("pos").alias("first_pos"), F.coalesce("part", F.lit(0)).alias("emit"), "content", F.lit("document").alias("modality"), F.col("kind").alias("unit_type"), F.col("kind").alias("element_kind"),
        F.lit("atomic").alias("strategy"), "reason", F.col("path").alias("heading_path"), "leading", "trailing", "page", "token_count", flags.alias("escalation_flags"), F.array("id").alias("member_ids"),
        F.create_map(F.lit("caption_confidence"), F.when(F.col("has_caption"), 1.0).when(F.col("caption") != "", 0.8).otherwise(0.0)).alias("signals"),
        F.when(F.col("part").isNotNull(), F.array(F.concat(F.lit("cut inside table "), "id", F.lit(" without header rejected: header repeated instead")))).otherwise(F.array().cast("array<string>")).alias("vetoed_cuts"),
        _map(part=F.col("part").cast("string"), granularity=F.lit("adaptive"), size_reason=F.lit("atomic_float_integrity")).alias("metadata"),
    )


def _prose(regions: DataFrame, edges: DataFrame, config: Config, scratch: Scratch) -> DataFrame:
    cuts = scratch.cut(chunk.cut_regions(regions, edges, config.weights, config.target_tokens, config.max_tokens, config.rebalance, config.counter), "cuts")
    # texts are dealt out once, by document, for the join with the cuts and for what is put together
    units = chunk.text_units(regions.repartition("doc_id"), cuts.repartition("doc_id"), config.counter)
    anchor = regions.select("doc_id", "pos", "id", F.when(F.col("kind") == "heading", F.col("text")).alias("anchor_text"), "strategy", "heading_density", "page", "path")
    anchor = cuts.groupBy("doc_id", "unit").agg(F.min("pos").alias("pos")).join(anchor, ["doc_id", "pos"]).drop("pos").repartition("doc_id")
    u = units.join(anchor, ["doc_id", "unit"]).filter("id = anchor_id").drop("id")
    headed = F.col("anchor_kind") == "heading"
    u = u.withColumn("heading_path", F.when(headed, F.concat("path", F.array("anchor_text"))).otherwise(F.col("path")))
    whole = (
        F.when((F.col("strategy") == "structural") & headed, F.format_string("section '%s' is %d tokens — under budget, kept whole", F.substring("anchor_text", 1, 60), "region_tokens"))
        .when(F.col("strategy") == "structural", F.format_string("section is %d tokens — under budget, kept whole", "region_tokens"))
        .when(F.col("strategy") == "semantic", F.format_string("topic-coherent run of %d paragraphs (%d tokens) — boundary where embedding similarity dips below mean − 1σ", "n_elements", "region_tokens"))
        .otherwise(F.format_string("%d paragraphs packed to %d tokens at paragraph boundaries", "n_elements", "region_tokens"))
    )
    reason = F.when(F.col("overflow"), F.format_string("%d tokens with no safe boundary — kept whole (overflow beats severing a relationship)", "region_tokens")).when(F.col("was_cut"), F.format_string(f"section of %d tokens split at the best boundary for {config.target_tokens} tokens", "region_tokens")).otherwise(whole)
    return u.select(
        "doc_id", "first_pos", F.lit(0).alias("emit"), "content", F.lit("document").alias("modality"), F.when(headed, "section").otherwise("narrative").alias("unit_type"), F.when(headed, "section").otherwise("prose").alias("element_kind"),
        "strategy", reason.alias("reason"), "heading_path", "page", "token_count", quality.escalation_flags(F.col("content"), F.col("heading_path"), F.col("strategy")).alias("escalation_flags"), "member_ids", F.col("vetoes").alias("vetoed_cuts"),
        F.create_map(F.lit("tokens"), F.col("region_tokens").cast("double"), F.lit("heading_density"), F.col("heading_density"), F.lit("overflow"), F.col("overflow").cast("double")).alias("signals"),
        _map(granularity=F.lit("adaptive"), size_reason=F.concat("strategy", F.lit("_cohesion"))).alias("metadata"),
    )


def _timed(e: DataFrame, edges: DataFrame, config: Config) -> DataFrame:
    sighted = e.groupBy("doc_id").agg(F.bool_or(F.col("kind").isin("visual_event", "slide")).alias("sighted"))
    _, stream = chunk.carve_floats(e.join(sighted, "doc_id"))
    turns = temporal.temporal_units(stream.filter("NOT sighted"), config.micro_turn, config.long_turn, config.counter)
    none = F.array().cast("array<string>")
    said = turns.select(
        "doc_id", "first_pos", F.col("span").alias("emit"), "content", F.lit("audio").alias("modality"), "unit_type", F.lit("speech").alias("element_kind"), F.lit("temporal").alias("strategy"), "reason", "t_start", "t_end", "speaker", "token_count", "member_ids",
        quality.escalation_flags(F.col("content"), none, F.lit("temporal")).alias("escalation_flags"), _map(visual_summary=F.col("visual_summary"), scene=F.col("scene"), ocr_text=F.col("ocr_text"), granularity=F.lit("adaptive"), size_reason=F.lit("speaker_turn_boundary,temporal_continuity")).alias("metadata"),
    )
    events = temporal.multimodal_units(stream.filter("sighted"), edges, config.target_tokens, config.weights, config.counter)
    shown = events.select(
        "doc_id", "first_pos", F.lit(0).alias("emit"), "content", F.lit("video").alias("modality"), "unit_type", F.lit("event").alias("element_kind"), F.lit("universal_boundary").alias("strategy"), "reason", "t_start", "t_end", "speaker", "entities", "leading", "token_count", "member_ids", none.alias("escalation_flags"),
        F.create_map(F.lit("fusion_confidence"), F.col("fusion_score"), F.lit("start_boundary_confidence"), F.col("start_confidence"), F.lit("end_boundary_confidence"), F.col("end_confidence"), F.lit("speaker_count"), F.col("speaker_count").cast("double"), F.lit("visual_element_count"), F.col("n_visual").cast("double"), F.lit("speech_element_count"), F.col("n_speech").cast("double")).alias("signals"),
        _map(fusion_label=F.col("fusion_label"), synthetic=F.when(F.col("synthetic"), "true"), extraction_mode=F.col("extraction_mode"), data_confidence=F.col("data_confidence").cast("string"), contributing_signals=F.array_join("contributing_signals", ","), granularity=F.lit("adaptive")).alias("metadata"),
    )
    return said.unionByName(shown, allowMissingColumns=True)


def _datasets(e: DataFrame, documents: DataFrame | None, config: Config) -> DataFrame:
    tables = e.filter("kind = 'table' AND size(grid) > 0")
    name = F.lit("dataset")
    if documents is not None and "source_uri" in documents.columns:
        tables = tables.join(documents.select("doc_id", F.regexp_extract("source_uri", r"([^/\\]+)$", 1).alias("source_name")), "doc_id", "left")
        name = F.coalesce("source_name", F.lit("dataset"))
    header = F.coalesce("header_row", F.get("grid", F.lit(0)))
    body = F.size("grid") - F.when(F.get("grid", F.lit(0)) == header, 1).otherwise(0)
    width = F.greatest(F.array_max(F.transform("grid", lambda r: F.size(r))), F.size(header))
    shapes = tables.select("doc_id", "id", "pos", "page", "sheet", name.alias("source_name"), body.alias("row_count"), width.alias("column_count"), F.array_join(header, "|").alias("columns"))
    cards = tabular.schema_cards(tabular.profile_columns(tabular.grid_cells(tables), ("doc_id", "id")), shapes, ("doc_id", "id"))
    where = F.filter(F.array("source_name", "sheet"), lambda x: x.isNotNull())
    label = F.when(F.col("sheet").isNotNull(), F.concat(F.lit("sheet '"), "sheet", F.lit("'"))).otherwise(F.lit("the dataset"))
    c = shapes.join(cards, ["doc_id", "id"]).select(
        "doc_id", F.col("pos").alias("first_pos"), F.lit(0).alias("emit"), "content", F.lit("document").alias("modality"), F.lit("schema_card").alias("unit_type"), F.lit("schema_card").alias("element_kind"), F.lit("tabular").alias("strategy"),
        F.concat(F.lit("schema card for "), label, F.format_string(" — %,d rows × %d columns profiled by type, range and cardinality so the dataset is searchable by shape", "row_count", "column_count")).alias("reason"), where.alias("heading_path"), "page",
        config.counter(F.col("content")).alias("token_count"), F.array("id").alias("member_ids"), F.array(F.lit("dataset summary — a one-line description of what these columns represent cannot be derived from structure alone")).alias("escalation_flags"),
        F.create_map(F.lit("rows"), F.col("row_count").cast("double"), F.lit("columns"), F.col("column_count").cast("double")).alias("signals"), _map(sheet=F.col("sheet"), row_count=F.col("row_count").cast("string"), column_count=F.col("column_count").cast("string"), granularity=F.lit("adaptive"), size_reason=F.lit("dataset_schema_profiling")).alias("metadata"),
    )
    groups = tabular.row_groups(tables, config.tabular_tokens, config.counter).join(shapes, ["doc_id", "id"])
    n = F.count("*").over(Window.partitionBy("doc_id", "id"))
    over = F.when(F.col("token_count") > config.tabular_max, F.create_map(F.lit("overflow"), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>"))
    g = groups.withColumn("n", n).select(
        "doc_id", F.col("pos").alias("first_pos"), (F.col("grp") + 1).alias("emit"), "content", F.lit("document").alias("modality"), F.lit("row_group").alias("unit_type"), F.lit("row_group").alias("element_kind"), F.lit("tabular").alias("strategy"),
        F.format_string("rows %,d–%,d of %s (%d of %d) — cut between rows, never through one", "first_row", "last_row", F.when(F.col("sheet").isNotNull(), label).otherwise(F.col("source_name")), F.col("grp") + 1, "n").alias("reason"), where.alias("heading_path"), "page", "token_count", F.array("id").alias("member_ids"),
        F.array().cast("array<string>").alias("escalation_flags"), F.array(F.lit("a row group without its header is data with no schema — header repeated instead of split away")).alias("vetoed_cuts"),
        F.map_concat(F.create_map(F.lit("rows_in_chunk"), F.col("n_rows").cast("double"), F.lit("first_row"), F.col("first_row").cast("double"), F.lit("last_row"), F.col("last_row").cast("double")), over).alias("signals"),
        _map(sheet=F.col("sheet"), first_row=F.col("first_row").cast("string"), last_row=F.col("last_row").cast("string"), columns=F.col("columns"), granularity=F.lit("adaptive"), size_reason=F.lit("row_boundary_integrity,header_repetition")).alias("metadata"),
    )
    return c.unionByName(g, allowMissingColumns=True)
