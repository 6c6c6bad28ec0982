"""Queries over datasets, timed elements, units, search and usage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.functions.text import count_tokens
from tessera.operators import chunk, evaluate, links, quality, search, tabular, temporal, usage
from tessera.operators.graph import overlaps
from tessera.plans.prose import ELEMENTS_SQL, GROUPED_SQL, PACK_SQL, documents, elements, page_elements, tok
from tessera.plans.registry import query, table
from tessera.schema import elements as as_elements
from tessera.schema import units as as_units
from tessera.sinks.tables import export_units
from tessera.streaming import events as streaming

PROFILED = {
    "customer": ("c_custkey", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "supplier": ("s_suppkey", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")),
    "part": ("p_partkey", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "nation": ("n_nationkey", ("n_nationkey", "n_name", "n_regionkey")),
    "region": ("r_regionkey", ("r_regionkey", "r_name")),
    "orders": ("o_orderkey", ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")),
    "lineitem": ("l_orderkey", ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")),
    "events": ("event_id", ("event_id", "ts", "user_id", "event_type", "value")),
}


def _profile_sql(name: str) -> str:
    key, columns = PROFILED[name]
    cells = "\nUNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", {key} AS k, coalesce(CAST({c} AS VARCHAR), '') AS v FROM {name}" for i, c in enumerate(columns))
    return f"""WITH cells AS ({cells}),
p AS (SELECT position, "column", CASE WHEN lower(trim(v)) IN ('', '-', 'n/a', 'na', 'null', 'none', 'nan') THEN NULL ELSE trim(v) END AS v FROM cells),
t AS (SELECT *, CASE WHEN regexp_matches(v, '^-?\\d+(\\.\\d+)?\\s*%$') THEN 'p' WHEN regexp_matches(v, '^(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}|\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}|\\d{{4}}-Q[1-4]|\\d{{4}}/\\d{{1,2}})([ T]\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?)?$') THEN 'd'
  WHEN regexp_matches(v, '^-?\\d{{1,3}}(,\\d{{3}})*$|^-?\\d+$') THEN 'i' WHEN regexp_matches(v, '^-?\\d*\\.\\d+$|^-?\\d{{1,3}}(,\\d{{3}})*\\.\\d+$') THEN 'f' END AS kind, try_cast(rtrim(replace(trim(v), ',', ''), '%') AS DOUBLE) AS num FROM p),
s AS (SELECT position, "column", count(v) AS n, count(*) - count(v) AS nulls, count(DISTINCT v) AS d, count(*) FILTER (WHERE kind = 'p') AS pc, count(*) FILTER (WHERE kind = 'd') AS dt, count(*) FILTER (WHERE kind = 'i') AS it, count(*) FILTER (WHERE kind = 'f') AS dc,
  avg(length(v)) AS len, bool_and(lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n', '0', '1')) AS b, min(num) AS lo, max(num) AS hi, avg(num) AS mu FROM t GROUP BY ALL),
x AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN pc >= 0.9 * n THEN 'percentage' WHEN dt >= 0.9 * n THEN 'date' WHEN it + dc >= 0.9 * n THEN CASE WHEN dc > 0 THEN 'decimal' ELSE 'integer' END
  WHEN b AND d <= 2 THEN 'boolean' WHEN d <= greatest(12, 0.1 * n) AND len <= 60 THEN 'categorical' WHEN d = n AND n > 1 THEN 'identifier' ELSE 'text' END AS dtype FROM s)
SELECT CAST(position AS INT) AS position, "column", dtype, CAST(n AS BIGINT) AS non_null, CAST(nulls AS BIGINT) AS nulls, CAST(d AS BIGINT) AS n_distinct,
  CASE WHEN dtype IN ('integer', 'decimal', 'percentage') THEN round(lo, 4) END AS minimum, CASE WHEN dtype IN ('integer', 'decimal', 'percentage') THEN round(hi, 4) END AS maximum, CASE WHEN dtype IN ('integer', 'decimal', 'percentage') THEN round(mu, 4) END AS mean FROM x"""


def _profile(name: str):
    key, columns = PROFILED[name]

    def run(spark, sf_dir):
        rows = table(spark, sf_dir, name).select(*columns)
        p = tabular.profile_columns(tabular.as_cells(rows, F.col(key)))
        return p.select("position", "column", "dtype", "non_null", "nulls", "n_distinct", *[F.round(c, 4).alias(c) for c in ("minimum", "maximum", "mean")])

    query(_profile_sql(name), f"column_profile_{name}")(run)


for _name in PROFILED:
    _profile(_name)


@query("""WITH l AS (SELECT string_agg('  - ' || line, chr(10) ORDER BY position) AS lines FROM (
  SELECT 0 AS position, 'r_regionkey (integer): ' || min(r_regionkey) || ' … ' || max(r_regionkey) || ', mean ' || CASE WHEN avg(r_regionkey) = round(avg(r_regionkey)) THEN CAST(CAST(avg(r_regionkey) AS INT) AS VARCHAR) ELSE printf('%.2f', avg(r_regionkey)) END AS line FROM region
  UNION ALL SELECT 1, 'r_name (categorical): ' || string_agg(r_name, ', ' ORDER BY r_regionkey) FROM region))
SELECT 'Dataset: region' || chr(10) || (SELECT count(*) FROM region) || ' rows × 2 columns' || chr(10) || chr(10) || 'Columns:' || chr(10) || lines AS content FROM l""")
def schema_card_text(spark, sf_dir):
    rows = table(spark, sf_dir, "region")
    p = tabular.profile_columns(tabular.as_cells(rows, F.col("r_regionkey"))).withColumn("t", F.lit(1))
    shape = rows.agg(F.lit(1).alias("t"), F.lit("region").alias("source_name"), F.lit(None).cast("string").alias("sheet"), F.count("*").alias("row_count"), F.lit(len(rows.columns)).alias("column_count"))
    return tabular.schema_cards(p, shape, ("t",)).select("content")


@query(f"""WITH RECURSIVE r AS (SELECT CAST(n_nationkey AS INT) AS pos, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation),
c AS (SELECT pos, line, {tok('line')} AS cost, {tok("'| n_nationkey | n_name | n_regionkey |'")} AS budget FROM r),
g AS (SELECT pos, line, cost, 0 AS grp, budget + cost AS used, budget FROM c WHERE pos = 0 UNION ALL
  SELECT c.pos, c.line, c.cost, CASE WHEN g.used + c.cost > 60 THEN g.grp + 1 ELSE g.grp END, CASE WHEN g.used + c.cost > 60 THEN c.budget + c.cost ELSE g.used + c.cost END, c.budget FROM g JOIN c ON c.pos = g.pos + 1)
SELECT CAST(grp AS INT) AS grp, CAST(count(*) AS BIGINT) AS n_rows, md5('| n_nationkey | n_name | n_regionkey |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY pos)) AS content_md5 FROM g GROUP BY grp""")
def row_groups(spark, sf_dir):
    g = tabular.wide_row_groups(table(spark, sf_dir, "nation"), F.lit(0), F.col("n_nationkey"), target=60)
    return g.select("grp", "n_rows", F.md5("content").alias("content_md5"))


@query(f"""WITH c AS (SELECT l_orderkey AS block, l_linenumber AS pos, {tok("'| ' || l_orderkey || ' | ' || l_linenumber || ' | ' || l_returnflag || ' |'")} AS cost FROM lineitem)
SELECT block, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(cost) AS BIGINT) AS n_tokens FROM c GROUP BY block""")
def row_groups_by_order(spark, sf_dir):
    """A large table packed order by order: each fits a group."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    line = fx.row_markdown(F.array(*[F.col(c).cast("string") for c in rows.columns]))
    packed = tabular.greedy_groups(rows.select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("pos"), count_tokens(line).alias("cost"), F.lit(0).alias("budget")), ["block"], "cost", "budget", 900)
    return packed.groupBy("block", "grp").agg(F.count("*").alias("n_rows"), F.sum("cost").cast("bigint").alias("n_tokens")).select("block", "n_rows", "n_tokens")


def timed(spark, sf_dir):
    """Events as timed elements: a user is a document, the event type the speaker, an event lasts ``value`` seconds."""
    e = table(spark, sf_dir, "events")
    t0 = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return as_elements(e.select(F.col("user_id").alias("doc_id"), pos.cast("int").alias("pos"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "view", "visual_event").otherwise("speech_segment").alias("kind"), F.col("event_type").alias("text"), t0.alias("t0"), (t0 + F.col("value")).alias("t1"), F.col("event_type").alias("speaker")))


TIMED_SQL = """tm AS (SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, event_id, event_type AS speaker, epoch_us(ts) / 1e6 AS t0, epoch_us(ts) / 1e6 + value AS t1 FROM events),
rn AS (SELECT *, sum(CASE WHEN speaker IS DISTINCT FROM prev AND prev_pos IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(speaker) OVER w AS prev, lag(pos) OVER w AS prev_pos FROM tm WINDOW w AS (PARTITION BY doc_id ORDER BY pos))),
sp AS (SELECT doc_id, CAST(run AS INT) AS run, min(pos) AS first_pos, arg_min(speaker, pos) AS speaker, arg_min(t0, pos) AS t0, arg_max(t1, pos) AS t1, count(*) AS n FROM rn GROUP BY doc_id, run)
"""


@query(f"WITH {TIMED_SQL} SELECT doc_id, run, first_pos, speaker, CAST(n AS BIGINT) AS n, round(t1 - t0, 2) AS seconds FROM sp")
def speaker_turns(spark, sf_dir):
    s = temporal.run_spans(temporal.speaker_runs(timed(spark, sf_dir)))
    return s.select("doc_id", "run", "first_pos", "speaker", "n", F.round(F.col("t1") - F.col("t0"), 2).alias("seconds"))


@query(f"""WITH RECURSIVE {TIMED_SQL}, u AS (SELECT doc_id, run, CASE WHEN speaker = 'click' THEN NULL ELSE speaker END AS voice, t1 - t0 AS dur FROM sp),
m AS (SELECT doc_id, run, voice, 0 AS turn FROM u WHERE run = 0 UNION ALL SELECT u.doc_id, u.run, u.voice, CASE WHEN u.dur < 300 AND (u.voice IS NULL OR u.voice = m.voice) THEN m.turn ELSE m.turn + 1 END FROM m JOIN u ON u.doc_id = m.doc_id AND u.run = m.run + 1)
SELECT doc_id, CAST(turn AS INT) AS turn, CAST(count(*) AS BIGINT) AS n_runs FROM m GROUP BY doc_id, turn""")
def micro_turn_merge(spark, sf_dir):
    """Clicks are unattributed; runs of less than five minutes join the turn before as the rule has it."""
    t = timed(spark, sf_dir).withColumn("speaker", F.when(F.col("speaker") != "click", F.col("speaker")))
    m = temporal.merge_micro_turns(temporal.speaker_runs(t), 300.0)
    return m.groupBy("doc_id", "turn").agg(F.count_distinct("run").alias("n_runs"))


@query(f"""WITH {TIMED_SQL}, g AS (SELECT doc_id, pos, t0 - lag(t1) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM tm)
SELECT doc_id, arg_max(pos, (gap, pos)) AS pos, round(max(gap), 2) AS gap FROM g WHERE gap IS NOT NULL GROUP BY doc_id""")
def longest_pause_split(spark, sf_dir):
    p = temporal.largest_pause(timed(spark, sf_dir).withColumn("turn", F.lit(0)))
    return p.select("doc_id", "pos", F.round("gap", 2).alias("gap"))


@query()
def long_turn_spans(spark, sf_dir):
    """All of a user's events as one turn, cut at pauses until no span is longer than ten days; tested against a plain recursion."""
    s = temporal.split_long_turns(timed(spark, sf_dir).withColumn("turn", F.lit(0)), 864_000.0)
    return s.groupBy("doc_id", "span").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


@query()
def event_windows(spark, sf_dir):
    """Windows of events with visuals by scored boundaries; tested on a small fixture."""
    t = temporal.on_timeline(timed(spark, sf_dir))
    none = spark.createDataFrame([], "doc_id long, src string, dst string, type string, confidence double, evidence string, importance double")
    w = temporal.event_windows(t, none)
    return w.groupBy("doc_id", "window").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 4).alias("confidence"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t0, epoch_us(ts) / 1e6 + value AS t1, event_type FROM events)
SELECT s.event_id AS speech, v.event_id AS visual FROM e s JOIN e v ON s.t0 < v.t1 AND v.t0 < s.t1 WHERE s.event_type <> 'view' AND v.event_type = 'view' AND least(s.t1, v.t1) > greatest(s.t0, v.t0)""")
def interval_overlap(spark, sf_dir):
    """All events on one timeline: speech against visuals that overlap it."""
    t = timed(spark, sf_dir).withColumn("doc_id", F.lit(0).cast("bigint"))
    return overlaps(t).select(F.col("speech").cast("bigint").alias("speech"), F.col("visual").cast("bigint").alias("visual"))


def _talk():
    said = F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit(" action item"))).when(F.col("conv_id") % 5 == 1, F.concat("text", F.lit(" we agreed"))).when(F.col("conv_id") % 5 == 2, F.concat("text", F.lit(" ok?")))
    return said.otherwise(F.col("text"))


@query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 THEN text || ' action item' WHEN conv_id % 5 = 1 THEN text || ' we agreed' WHEN conv_id % 5 = 2 THEN text || ' ok?' ELSE text END AS text FROM conversations),
g AS (SELECT conv_id, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS whole, count(DISTINCT role) FILTER (WHERE role <> '') AS voices, max(turn) AS last FROM t GROUP BY conv_id),
q AS (SELECT t.conv_id, bool_or(regexp_matches(t.text, '(?m)\\?$') OR regexp_matches(t.text, '(?i)^(who|what|where|when|why|how|can|could|would|should|is|are|do|does|did)\\b.*\\?')) AS asked FROM t JOIN g USING (conv_id) WHERE t.turn < g.last GROUP BY t.conv_id)
SELECT conv_id, CAST(n AS INT) AS n_turns, CASE WHEN regexp_matches(whole, '(?i)\\b(action item|to-?do|will follow up|assign(ed)? to|take the lead on|action point)\\b') THEN 'action_item'
  WHEN regexp_matches(whole, '(?i)\\b(we (agreed|decided|concluded)|decision (is|was)|let''s (go with|move forward with|adopt)|consensus is|approved)\\b') THEN 'decision'
  WHEN coalesce(asked, false) AND voices > 1 THEN 'question_answer' WHEN voices > 1 THEN 'discussion' WHEN voices > 0 THEN 'speaker_turn' ELSE 'narrative' END AS unit_type FROM g LEFT JOIN q USING (conv_id)""")
def conversation_class(spark, sf_dir):
    """Conversations with planted phrases, classified."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn").cast("int").alias("pos"), F.col("role").alias("speaker"), _talk().alias("text"))
    return temporal.classify_dialogues(c, ["conv_id"]).select("conv_id", "n_turns", "unit_type")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t0, epoch_us(ts) / 1e6 + value AS t1, event_type FROM events),
s AS (SELECT user_id, min(t0) FILTER (WHERE event_type <> 'view') AS s0, max(t1) FILTER (WHERE event_type <> 'view') AS s1, min(t0) FILTER (WHERE event_type = 'view') AS v0, max(t1) FILTER (WHERE event_type = 'view') AS v1 FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN s0 IS NULL AND v0 IS NULL THEN CAST(0 AS DOUBLE) WHEN s0 IS NULL OR v0 IS NULL THEN CAST(0.3 AS DOUBLE) ELSE round(0.6 * greatest(0, least(s1, v1) - greatest(s0, v0)) / greatest(greatest(s1, v1) - least(s0, v0), 1e-6) + 0.4 * 0.5, 4) END AS score FROM s""")
def fusion_confidence(spark, sf_dir):
    t = timed(spark, sf_dir)
    said, seen = F.col("kind") == "speech_segment", F.col("kind") == "visual_event"
    pick = lambda f, test, c: f(F.when(test, F.col(c)))
    g = t.groupBy(F.col("doc_id").alias("user_id")).agg(pick(F.min, said, "t0").alias("s0"), pick(F.max, said, "t1").alias("s1"), pick(F.min, seen, "t0").alias("v0"), pick(F.max, seen, "t1").alias("v1"))
    none = F.array().cast("array<string>")
    return g.select("user_id", temporal.fusion((F.col("s0"), F.col("s1"), none), (F.col("v0"), F.col("v1"), none)).alias("score"))


def packed(spark, sf_dir):
    """Packed documents as units."""
    e = elements(spark, sf_dir)
    p = chunk.packed_elements(e, 700).select("doc_id", "pos", "grp")
    u = e.select("doc_id", "pos", "id", "text").join(p, ["doc_id", "pos"]).groupBy("doc_id", "grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("content"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("member_ids"))
    none = F.array().cast("array<string>")
    u = u.withColumns({"seq": F.col("grp"), "id": F.concat("doc_id", F.lit("-"), "grp"), "modality": F.lit("document"), "unit_type": F.lit("narrative"), "element_kind": F.lit("prose"), "strategy": F.lit("paragraph_fallback"), "heading_path": none, "token_count": count_tokens("content"), "escalation_flags": quality.escalation_flags(F.col("content"), none, F.lit("paragraph_fallback"))})
    return as_units(u)


UNITS_SQL = f"WITH RECURSIVE {ELEMENTS_SQL}, {PACK_SQL}, un AS (SELECT doc_id, CAST(grp AS INT) AS seq, string_agg(text, chr(10) || chr(10) ORDER BY e.pos) AS content FROM packed JOIN el e USING (doc_id, pos) GROUP BY doc_id, grp)"
POINTERS_SQL = " OR ".join(f"regexp_matches(content, '{p}')" for p in (r"(?i)\bas (shown|described|noted|mentioned|discussed) (above|earlier|previously|below)\b", r"(?i)\bthis (table|figure|section|chart|diagram|approach|result|data)\b", r"(?i)\bthe (former|latter)\b", r"^(This|These|It|They)\b", r"(?i)\bsee (table|figure|fig\.?|section)\s+\d+\b"))


@query(UNITS_SQL + f" SELECT doc_id, seq, CAST(CASE WHEN {POINTERS_SQL} THEN 0.0 ELSE 0.5 END AS DOUBLE) AS context_completeness, CAST(CASE WHEN {POINTERS_SQL} THEN 2 ELSE 1 END AS INT) AS n_missing FROM un")
def completeness(spark, sf_dir):
    return quality.completeness(packed(spark, sf_dir)).select("doc_id", "seq", "context_completeness", F.size("missing_context").alias("n_missing"))


@query(UNITS_SQL + ", l AS (SELECT doc_id, seq, lead(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS nx FROM un) SELECT doc_id || '-' || seq AS src, doc_id || '-' || nx AS dst, 'next' AS type FROM l WHERE nx IS NOT NULL UNION ALL SELECT doc_id || '-' || nx, doc_id || '-' || seq, 'previous' FROM l WHERE nx IS NOT NULL")
def unit_links(spark, sf_dir):
    return links.order_links(packed(spark, sf_dir)).select("src", "dst", "type")


@query(UNITS_SQL + ", p AS (SELECT doc_id, seq, 'part ' || seq % 2 AS path FROM un), f AS (SELECT *, first_value(seq) OVER (PARTITION BY doc_id, path ORDER BY seq) AS par FROM p) SELECT doc_id || '-' || par AS parent, doc_id || '-' || seq AS child FROM f WHERE par <> seq")
def hierarchy_links(spark, sf_dir):
    """Units under two planted headings."""
    u = packed(spark, sf_dir).withColumn("heading_path", F.array(F.concat(F.lit("part "), (F.col("seq") % 2).cast("string"))))
    return links.hierarchy_links(u).select("parent", "child")


@query(UNITS_SQL + f", c AS (SELECT *, {tok('content')} AS n FROM un) SELECT CAST(count(*) AS BIGINT) AS n_units, CAST(0 AS DOUBLE) AS coherence, round(avg(CASE WHEN {POINTERS_SQL} THEN 0.0 ELSE 0.5 END), 3) AS completeness, round(avg(CASE WHEN n < 40 THEN 1.0 ELSE 0.0 END), 3) AS fragmentation, round(stddev_pop(n), 2) AS size_deviation FROM c")
def unit_metrics(spark, sf_dir):
    return evaluate.unit_metrics(quality.completeness(packed(spark, sf_dir)))


@query(f"""WITH {GROUPED_SQL}, h AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS par FROM gel),
nm AS (SELECT doc_id, pos, kind, par, length(text) AS n, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM h),
pr AS (SELECT a.doc_id, a.pos, trim(substr(a.t, 1, 80)) AS probe, substr(b.t, 1, 60) AS head, substr(a.t, 1, 80) AS p FROM nm a JOIN nm b ON b.doc_id = a.doc_id AND b.pos = a.par WHERE a.kind = 'paragraph' AND a.n >= 60),
ch AS (SELECT doc_id, pos // 8 AS c, trim(regexp_replace(lower(string_agg(text, chr(10) ORDER BY pos)), '[^a-z0-9]+', ' ', 'g')) AS t FROM gel GROUP BY ALL),
m AS (SELECT pr.doc_id, pr.pos, bool_or(p <> '' AND contains(ch.t, p)) AS found, bool_or(p <> '' AND contains(ch.t, p) AND contains(ch.t, head)) AS ok FROM pr JOIN ch USING (doc_id) GROUP BY ALL)
SELECT 'heading context' AS metric, CAST(count(*) FILTER (WHERE found AND ok) AS BIGINT) AS preserved, CAST(count(*) AS BIGINT) AS total FROM m""")
def scorecard_baseline(spark, sf_dir):
    """How often chunks of eight elements keep a paragraph's heading with it."""
    from tessera.operators.graph import hierarchy

    e = page_elements(spark, sf_dir, 5)
    asked = evaluate.probes(e, hierarchy(e))
    c = e.groupBy("doc_id", F.floor(F.col("pos") / 8).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return evaluate.arm_tally(asked, c)


@query("""WITH w AS (SELECT doc_id AS unit_id, row_number() OVER (ORDER BY doc_id) AS seq, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS u FROM documents),
q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS q FROM benchmark),
s AS (SELECT query_id, unit_id, seq, len(list_intersect(u, q)) AS score FROM q CROSS JOIN w), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM s),
rel AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id AS unit_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
h AS (SELECT query_id, count(*) FILTER (WHERE rank <= 5) AS hits, min(rank) FILTER (WHERE score > 0) AS best FROM r JOIN rel USING (query_id, unit_id) GROUP BY ALL)
SELECT q.query_id, CAST(coalesce(hits, 0) AS BIGINT) AS hits, round(coalesce(hits, 0) / greatest(coalesce(n, 0), 1), 6) AS recall, round(coalesce(hits, 0) / 5, 6) AS "precision", round(coalesce(1.0 / best, 0.0), 6) AS reciprocal_rank FROM q LEFT JOIN h USING (query_id) LEFT JOIN n USING (query_id)""")
def retrieval_eval(spark, sf_dir):
    """Benchmark items look for the documents that hold them."""
    d, b = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    rel = links.containments(d, b).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("unit_id"))
    r = evaluate.retrieval(d.select(F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("seq"), "text"), b.select(F.col("item_id").alias("query_id"), "text"), rel)
    return r.select("query_id", "hits", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")])


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, vec_id LIMIT 5")
def vector_topk(spark, sf_dir):
    """The five vectors nearest to the first one: a top-k report."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = v.filter("vec_id = 0").first().vector
    return search.search_units(v, list(asked), 5, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT label, vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(prev AS DOUBLE[])), 6) AS similarity FROM (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) WHERE prev IS NOT NULL")
def adjacent_drift(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector"))
    return search.adjacent_drift(v, "label", "vec_id").select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH s AS (SELECT label, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[])) AS sim FROM embeddings),
t AS (SELECT *, avg(sim) OVER (PARTITION BY label) AS mu, stddev_pop(sim) OVER (PARTITION BY label) AS sd FROM s), g AS (SELECT label, sum(CASE WHEN sim < mu - sd THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS region FROM t)
SELECT label, CAST(region AS INT) AS region, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL""")
def semantic_groups(spark, sf_dir):
    """Runs of vectors of a label without drift between neighbours."""
    v = table(spark, sf_dir, "embeddings").withColumn("pos", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int"))
    stream = v.select(F.col("label").cast("bigint").alias("doc_id"), "pos")
    g = chunk.semantic_groups(stream, v.select(F.col("label").cast("bigint").alias("doc_id"), "pos", F.col("embedding").alias("vector")))
    return g.groupBy(F.col("doc_id").cast("int").alias("label"), "region").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT CASE o_custkey % 4 WHEN 0 THEN 'gemini-2.5-flash' WHEN 1 THEN 'gemini-2.5-flash-lite' WHEN 2 THEN 'ollama/qwen3:4b' ELSE 'other-model' END AS model, CAST(o_orderkey AS BIGINT) AS i, CAST(o_custkey AS BIGINT) AS o, CAST(o_orderkey // 2 AS BIGINT) AS h FROM orders),
g AS (SELECT model, count(*) AS calls, sum(i) AS i, sum(o) AS o, sum(h) AS h FROM c GROUP BY model)
SELECT model, CAST(calls AS BIGINT) AS calls, CAST(i AS BIGINT) AS in_tokens, CAST(o AS BIGINT) AS out_tokens, CAST(h AS BIGINT) AS cached_tokens, CASE WHEN model LIKE 'ollama/%' THEN CAST(0 AS DOUBLE) ELSE round((greatest(0, i - h) * 0.30 + h * 0.075 + o * 2.50) / 1e6, 6) END AS cost_usd, model LIKE 'ollama/%' AS local, model = 'other-model' AS estimated, round(100.0 * h / i, 1) AS cache_hit_pct FROM g""")
def usage_ledger(spark, sf_dir):
    """Orders as model calls; the lite model is billed as the one that its name begins with."""
    m = F.col("o_custkey") % 4
    model = F.when(m == 0, "gemini-2.5-flash").when(m == 1, "gemini-2.5-flash-lite").when(m == 2, "ollama/qwen3:4b").otherwise("other-model")
    calls = table(spark, sf_dir, "orders").select(model.alias("model"), F.col("o_orderkey").alias("in_tokens"), F.col("o_custkey").alias("out_tokens"), F.floor(F.col("o_orderkey") / 2).cast("bigint").alias("cached_tokens"))
    return usage.ledger(calls)


@query(UNITS_SQL + " SELECT doc_id || '-' || seq AS id, md5(content) AS page_md5, 'document' AS modality, 'paragraph_fallback' AS strategy FROM un")
def export_langchain(spark, sf_dir):
    x = export_units(packed(spark, sf_dir), "langchain")
    return x.select("metadata.id", F.md5("page_content").alias("page_md5"), "metadata.modality", "metadata.strategy")


@query(UNITS_SQL + " SELECT doc_id || '-' || seq AS ids, md5(content) AS document_md5, '' AS source, 'narrative' AS type FROM un")
def export_chroma(spark, sf_dir):
    x = export_units(packed(spark, sf_dir), "chroma")
    return x.select("ids", F.md5("documents").alias("document_md5"), "metadatas.source", "metadatas.type")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_turns(spark, sf_dir):
    """Sessions of users, the plan that also runs as a stream."""
    return streaming.sessions(table(spark, sf_dir, "events"), "6 hours").select("user_id", "n_events", "total")


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    t = streaming.tumbling(table(spark, sf_dir, "events"), "1 day")
    return t.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n_events", "total")
