"""Queries over planted elements and units, which take the operators through cases that the tables lack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import cleaning, links, quality
from tessera.operators.boundary import SIGNALS, candidates
from tessera.plans.data import POINTERS_SQL
from tessera.plans.prose import RATE_SQL, SENTENCES_SQL, documents
from tessera.plans.registry import query, table

#: What is put into texts, in this order: ligatures, invisible characters, blanks that do not break,
#: remnants of citations, words broken at line ends, empty lines.
DEBRIS = (("e ", "eﬁ "), ("a ", "a​ "), ("i ", "i­ "), (", ", ", 【3-4】 "), ("o ", "o-\n "), (". ", ".\n\n\n\n"))
#: (name, pattern, replacement, condition) of the cleaning rules, as DuckDB writes them.
RULES = (
    ("ligatures", "[ﬁﬂﬀﬃﬄﬅﬆ]", None, None),
    ("control_chars", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", None),
    ("invisible_chars", "[­​‌‍⁠﻿]", "", None),
    ("non_breaking_spaces", "[   ]", " ", None),
    ("citation_markers", r"【?\s*\d+\s*†\s*L?[\d\s\-–L]{0,24}】?", "", None),
    ("citation_markers", r"【[\s\d\-–L]{1,24}】", "", None),
    ("orphaned_citation_brackets", r"【\s*", "", "odd"),
    ("orphaned_citation_brackets", r"\s*】", "", "odd"),
    ("hyphen_line_breaks", r"([\p{L}\p{N}_])[-‐‑]\s*\n\s*([a-z])", r"\1\2", None),
    ("dot_leaders", r"\.{4,}", " ", None),
    ("trailing_bullets", r"(?m)[ \t]*[·•▪●○◦]+[ \t]*$", "", None),
    ("space_before_punctuation", r"[ \t]+([,.;:!?%)\]])", r"\1", None),
    ("space_after_bracket", r"([(\[])[ \t]+", r"\1", None),
    ("repeated_spaces", r"[ \t]{2,}", " ", None),
    ("repeated_blank_lines", r"\n{3,}", "\n\n", None),
)
COUNTED = tuple(dict.fromkeys(name for name, *_ in RULES))


def _clean_sql() -> str:
    dirty = reduce(lambda t, x: f"replace({t}, '{x[0]}', '{x[1]}')", DEBRIS, "text")
    steps = [f"d AS (SELECT doc_id, {dirty} || CASE WHEN doc_id % 2 = 1 THEN ' 【 open' ELSE ' 【 5x 】' END AS t0 FROM documents)"]
    last = "d"
    for k, (name, pattern, to, condition) in enumerate(RULES):
        n, t = f"len(regexp_extract_all(t{k}, '{pattern}'))", f"regexp_replace(t{k}, '{pattern}', '{to}', 'g')"
        if to is None:
            t = f"replace(t{k}, 'ﬁ', 'fi')"
        if condition:
            n, t = f"CASE WHEN {condition} THEN {n} ELSE 0 END", f"CASE WHEN {condition} THEN {t} ELSE t{k} END"
        odd = f", len(t{k}) - len(replace(t{k}, '【', '')) <> len(t{k}) - len(replace(t{k}, '】', '')) AS odd" if condition and "odd" not in "".join(steps) else ""
        if odd:
            steps.append(f"o AS (SELECT *{odd} FROM {last})")
            last = "o"
        steps.append(f"s{k} AS (SELECT *, {n} AS n{k}, {t} AS t{k + 1} FROM {last})")
        last = f"s{k}"
    sums = [f"CAST({' + '.join(f'n{k}' for k, r in enumerate(RULES) if r[0] == name)} AS BIGINT) AS {name}" for name in COUNTED]
    bare = f"trim(t{len(RULES)}, ' ' || chr(9) || chr(10) || chr(13))"
    return f"WITH {', '.join(steps)} SELECT doc_id, md5({bare}) AS text_md5, CAST(length({bare}) AS BIGINT) AS n_chars, {', '.join(sums)} FROM {last}"


@query(_clean_sql())
def clean_every_rule(spark, sf_dir):
    """Documents with debris for the rules that ``clean_planted`` leaves untried; brackets are odd in every second one."""
    dirty = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), DEBRIS, F.col("text"))
    end = F.when(F.col("doc_id") % 2 == 1, " 【 open").otherwise(" 【 5x 】")
    c = cleaning.clean_text(documents(spark, sf_dir).select("doc_id", F.concat(dirty, end).alias("text")), normalise=False)
    n = [F.coalesce(F.element_at("fixes", F.lit(name)), F.lit(0)).alias(name) for name in COUNTED]
    return c.select("doc_id", F.md5(F.col("text")).alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"), *n)


#: Conversations as timed elements of all kinds, ten conversations a document; plain SQL for both engines.
TIMED = """SELECT doc_id, pos, concat('el_', pos) AS id,
  CASE pos % 9 WHEN 1 THEN 'paragraph' WHEN 2 THEN 'list_item' WHEN 3 THEN 'list_item' WHEN 4 THEN 'visual_event' WHEN 5 THEN 'speech_segment' WHEN 6 THEN 'table' WHEN 7 THEN 'caption' ELSE 'heading' END AS kind,
  CASE WHEN pos % 9 = 0 THEN 1 + CAST(floor(pos / 9) AS INT) % 3 WHEN pos % 9 = 8 AND pos % 2 = 1 THEN 4 END AS level,
  CASE pos % 4 WHEN 0 THEN concat('What is part ', n, '?') WHEN 1 THEN 'how would it go? Then on.' ELSE concat('Part ', n, ' is told.') END AS text,
  CASE WHEN pos % 9 <> 1 THEN CAST(pos * 5 + (pos % 4) * 0.5 AS DOUBLE) END AS t0, CAST(pos * 5 + (pos % 4) * 0.5 + 2 + n % 5 AS DOUBLE) AS t1,
  CASE WHEN pos % 9 IN (2, 4, 5, 6) THEN role END AS speaker, CASE WHEN pos % 5 < 3 THEN concat('view ', CAST(floor(pos / 3) AS INT)) ELSE '' END AS visual_summary,
  CASE WHEN pos % 2 = 0 THEN concat('scene ', CAST(floor(pos / 4) AS INT)) END AS scene, CASE pos % 7 WHEN 0 THEN 'shot' WHEN 1 THEN 'slide' WHEN 2 THEN 'event' WHEN 3 THEN '' END AS visual_change_type,
  CASE WHEN pos % 5 <> 4 THEN concat('slide ', CAST(floor(pos / 6) AS INT)) ELSE '' END AS ocr_text, concat('S', CAST(floor(pos / 6) AS INT)) AS section
FROM (SELECT CAST(floor(conv_id / 10) AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY floor(conv_id / 10) ORDER BY conv_id, turn) - 1 AS INT) AS pos, role, length(text) AS n FROM conversations)"""

SIGNALS_SQL = f"""WITH el AS ({TIMED}), l AS (SELECT *, lag(id) OVER w AS b_id, lag(kind) OVER w AS b_kind, lag(text) OVER w AS b_text, lag(t1) OVER w AS b_t1, lag(speaker) OVER w AS b_speaker, lag(visual_change_type) OVER w AS b_change,
  lag(coalesce(nullif(visual_summary, ''), nullif(scene, ''))) OVER w AS b_sight, coalesce(nullif(visual_summary, ''), nullif(scene, '')) AS sight, lag(ocr_text) OVER w AS b_ocr, lag(section) OVER w AS b_section FROM el WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
a AS (SELECT *, kind = 'heading' AS head, CASE WHEN level > 0 THEN level ELSE 1 END AS lev, b_t1 IS NOT NULL AND t0 IS NOT NULL AS timed, greatest(0.0, t0 - b_t1) AS gap, coalesce(nullif(visual_change_type, ''), nullif(b_change, '')) AS change FROM l WHERE b_id IS NOT NULL),
b AS (SELECT *, coalesce(timed AND speaker <> b_speaker, false) AS voice FROM a),
c AS (SELECT *, CASE WHEN head THEN greatest(0.6, 1.0 - (lev - 1) * 0.15) END AS structural_strength, CASE WHEN kind = 'list_item' AND b_kind = 'list_item' THEN 1.0 END AS list_continuation, CASE WHEN timed THEN least(1.0, gap / 3.0) END AS temporal_gap,
  CASE WHEN voice THEN 1.0 END AS speaker_change, CASE WHEN timed AND NOT voice AND gap >= 2 THEN least(1.0, gap / 5.0) END AS pause_strength, CASE WHEN change = 'shot' THEN 0.35 WHEN change IS NOT NULL OR sight <> b_sight THEN 0.85 END AS visual_change,
  CASE WHEN kind = 'visual_event' THEN 0.95 END AS scene_change, CASE WHEN b_ocr <> '' AND ocr_text <> '' AND b_ocr <> ocr_text THEN 0.8 END AS ocr_change,
  CASE WHEN b_text LIKE '%?' OR regexp_matches(b_text, '(?i)^(who|what|where|when|why|how|can|could|would|should|is|are|do|does|did)\\b.*\\?') THEN 0.9 END AS qa_transition,
  CASE WHEN kind = 'caption' THEN 0.1 WHEN section <> b_section THEN 0.95 ELSE 0.5 END AS graph_separation, CAST(NULL AS DOUBLE) AS semantic_shift FROM b),
d AS (SELECT *, CAST(coalesce(speaker_change > 0.5, false) AS INT) + CAST(coalesce(coalesce(visual_change, scene_change) > 0.5, false) AS INT) + CAST(coalesce(temporal_gap > 0.5, false) AS INT) + CAST(coalesce(ocr_change > 0.5, false) AS INT) + CAST(coalesce(structural_strength > 0.5, false) AS INT) + CAST(coalesce(pause_strength > 0.5, false) AS INT) AS agree FROM c),
e AS (SELECT *, CASE WHEN agree >= 2 THEN least(1.0, 0.4 + agree * 0.2) END AS multimodal_consensus FROM d)
SELECT doc_id, pos, {', '.join(f'round(CAST(coalesce({s}, -1) AS DOUBLE), 4) AS {s}' for s in SIGNALS)},
  concat_ws('|', CASE WHEN b_kind = 'heading' AND NOT head THEN 'would strand heading ''' || substr(b_text, 1, 60) || ''' at chunk boundary' END, CASE WHEN kind = 'caption' THEN 'would sever caption pair: CAPTIONS ' || id || ' ↔ ' || b_id END) AS vetoes,
  coalesce(nullif(concat_ws('; ', CASE WHEN head THEN 'heading transition to ''' || substr(text, 1, 40) || ''' (level ' || lev || ')' END, CASE WHEN voice THEN 'speaker change (' || b_speaker || ' → ' || speaker || ')' END, CASE WHEN pause_strength IS NOT NULL THEN printf('pause duration %.1fs', CAST(gap AS DOUBLE)) END,
    CASE WHEN change = 'shot' THEN 'shot change (camera cut only, weight=0.35)' WHEN change IS NOT NULL THEN 'visual ' || change || ' transition' WHEN visual_change IS NOT NULL THEN 'visual scene transition (''' || b_sight || ''' → ''' || sight || ''')' END,
    CASE WHEN scene_change IS NOT NULL THEN 'visual event boundary' END, CASE WHEN ocr_change IS NOT NULL THEN 'OCR slide text change' END, CASE WHEN qa_transition IS NOT NULL THEN 'question-answer transition' END, CASE WHEN agree >= 2 THEN 'multimodal agreement (' || agree || ' independent signals)' END), ''), 'paragraph boundary') AS reason,
  head AND lev <= 2 AS is_hard, (head AND lev > 2) OR list_continuation IS NOT NULL OR voice OR pause_strength IS NOT NULL OR scene_change IS NOT NULL AS is_soft,
  round(CAST(1.2 * coalesce(structural_strength, 0) + coalesce(speaker_change, 0) + coalesce(temporal_gap, 0) + coalesce(pause_strength, 0) + 0.9 * (coalesce(visual_change, 0) + coalesce(scene_change, 0)) + 0.8 * coalesce(ocr_change, 0) + 0.8 * graph_separation + 1.1 * coalesce(multimodal_consensus, 0) - CASE WHEN list_continuation > 0 THEN 0.5 ELSE 0 END AS DOUBLE), 4) + 0.0 AS score
FROM e"""


def timed_elements(spark, sf_dir):
    sql = TIMED.replace("FROM conversations", "FROM {conversations}")
    return spark.sql(sql, conversations=table(spark, sf_dir, "conversations")).withColumn("path", F.array("section"))


@query(SIGNALS_SQL)
def boundary_signals(spark, sf_dir):
    """Every signal, veto and reason of the boundaries between timed elements, and their score."""
    e = timed_elements(spark, sf_dir)
    before = Window.partitionBy("doc_id").orderBy("pos")
    pairs = e.select("doc_id", F.lag("id").over(before).alias("src"), F.col("id").alias("dst"), "kind").filter("kind = 'caption' AND src IS NOT NULL")
    found = candidates(e, pairs.select("doc_id", "src", "dst", F.lit("captions").alias("type")))
    signals = [F.round(F.coalesce(F.col(s).cast("double"), F.lit(-1.0)), 4).alias(s) for s in SIGNALS]
    return found.select("doc_id", "pos", *signals, F.array_join("vetoes", "|").alias("vetoes"), "reason", "is_hard", "is_soft", (F.round("base_score", 4) + F.lit(0.0)).alias("score"))


@query("""WITH u AS (SELECT doc_id, 'u' || doc_id || '-0' AS id, coalesce(text, '') || ' as told in my_note' || (doc_id * 7 % 1000) || '.txt' AS content FROM documents
  UNION ALL SELECT doc_id, 'u' || doc_id || '-1', 'the end of note' || (doc_id + 1) FROM documents),
k AS (SELECT doc_id AS dst_doc, 'note' || doc_id || '.txt' AS key FROM documents UNION ALL SELECT doc_id, 'note' || doc_id FROM documents)
SELECT DISTINCT u.doc_id AS src_doc, u.id AS src, dst_doc, 'u' || dst_doc || CASE WHEN dst_doc % 2 = 0 THEN '-1' ELSE '-0' END AS dst FROM u JOIN k ON contains(u.content, k.key) AND u.doc_id <> dst_doc""")
def file_mentions(spark, sf_dir):
    """Units that name files of other documents, whole or within longer words; sections are at every second document's end."""
    d = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = F.concat("text", F.lit(" as told in my_note"), (F.col("doc_id") * 7 % 1000).cast("string"), F.lit(".txt"))
    units = d.select("doc_id", F.lit(0).alias("seq"), told.alias("content"), F.lit("narrative").alias("unit_type"))
    last = F.when(F.col("doc_id") % 2 == 0, "section").otherwise("narrative")
    units = units.unionByName(d.select("doc_id", F.lit(1).alias("seq"), F.concat(F.lit("the end of note"), (F.col("doc_id") + 1).cast("string")).alias("content"), last.alias("unit_type")))
    units = units.withColumn("id", F.concat(F.lit("u"), "doc_id", F.lit("-"), "seq"))
    return links.mentions(units, d.select("doc_id", F.concat(F.lit("note"), "doc_id", F.lit(".txt")).alias("name")))


COMPLETE_SQL = f"""WITH d AS (SELECT doc_id, doc_id % 8 AS k, coalesce(text, '') || CASE WHEN doc_id % 8 = 7 THEN ' as you can see here' ELSE '' END AS content FROM documents),
p AS (SELECT *, {POINTERS_SQL} AS points, {SENTENCES_SQL.format('content')} AS s FROM d),
c AS (SELECT *, [CASE WHEN k <= 5 THEN k IN (1, 2, 5) END, CASE WHEN k IN (2, 3) THEN k = 2 END, CASE WHEN k IN (4, 5) THEN k = 4 END, NOT points OR k = 2, CASE WHEN k IN (6, 7) THEN k = 7 OR doc_id % 16 = 6 END, CASE WHEN k = 7 THEN doc_id % 16 = 7 END] AS checks,
  CAST(k IN (1, 2) AS INT) + CAST(k = 2 AS INT) + CAST(k = 4 AS INT) + CAST(points AND k = 2 AS INT) + CAST(k = 7 OR doc_id % 16 = 6 AS INT) + CAST(doc_id % 16 = 7 AS INT) AS n_attached FROM p)
SELECT doc_id, round(len(list_filter(checks, lambda x: x)) / len(list_filter(checks, lambda x: x IS NOT NULL)), 3) AS context_completeness, CAST(len(list_filter(checks, lambda x: NOT x)) AS INT) AS n_missing, n_attached,
  CAST({RATE_SQL} > 0.10 AS INT) + CAST(k NOT IN (1, 2) AS INT) + CAST(k = 5 AS INT) AS n_flags FROM c"""


@query(COMPLETE_SQL)
def completeness_by_kind(spark, sf_dir):
    """Checks and flags of eight kinds of unit: prose, row groups, floats, speech and video, each complete and not."""
    k = F.col("doc_id") % 8
    text = F.concat(F.coalesce("text", F.lit("")), F.when(k == 7, " as you can see here").otherwise(""))
    link = F.array(F.struct(F.lit("has_schema").alias("type"), F.lit("card").alias("target_id"), F.lit(1.0).alias("confidence"), F.lit("").alias("evidence")))
    kind = F.when(k.isin(2, 3), "row_group").when(k == 4, "figure").when(k == 5, "table").otherwise("prose")
    seen = F.when(F.col("doc_id") % 16 == 7, "a chart").otherwise("")
    u = documents(spark, sf_dir).select(
        "doc_id", text.alias("content"), kind.alias("element_kind"), F.when(k <= 5, "document").when(k == 6, "audio").otherwise("video").alias("modality"),
        F.when(k.isin(1, 2), F.array(F.lit("a heading"))).otherwise(F.array().cast("array<string>")).alias("heading_path"), F.when(k == 2, link).alias("relationships"),
        F.create_map(F.lit("columns"), F.when(k == 2, "a, b").otherwise(""), F.lit("visual_summary"), seen).alias("metadata"), F.create_map(F.lit("caption_confidence"), F.when(k == 4, 0.8).otherwise(0.0)).alias("signals"),
        F.when((k == 7) | (F.col("doc_id") % 16 == 6), "A").alias("speaker"), F.when(k >= 6, 1.0).alias("t_start"), F.lit(None).cast("string").alias("leading"), F.lit(None).cast("string").alias("situating_summary"),
    )
    flags = quality.escalation_flags(F.col("content"), F.col("heading_path"), F.lit("structural"), F.col("element_kind"), F.col("element_kind") != "table")
    return quality.completeness(u).select("doc_id", "context_completeness", F.size("missing_context").alias("n_missing"), F.size("attached_context").alias("n_attached"), F.size(flags).alias("n_flags"))
