"""Queries over documents and pages: elements, cleaning, routing, cutting, quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import chunk, cleaning, links, quality
from tessera.operators.boundary import best_cuts, candidates
from tessera.operators.graph import answers, build_edges, explains, heading_paths, references, relationship_loss, surrounding_text
from tessera.operators.profile import build_profile, route
from tessera.plans.engine import process
from tessera.plans.registry import query, spread, table
from tessera.plans.scratch import Scratch
from tessera.schema import elements as as_elements
from tessera.sources.html import html_elements
from tessera.sources.text import text_elements, with_parents

#: A token, as SQL counts it.
TOK = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'))"


def tok(column: str) -> str:
    return TOK.format(column)


#: Documents as paragraphs in order, with token counts.
ELEMENTS_SQL = f"""
pieces AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
el AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS pos, text, CAST({tok('text')} AS INT) AS tokens FROM pieces WHERE trim(text) <> '')
"""
#: Pages as elements: blocks outside of navigation, scripts and comments.
PAGES_SQL = r"""
bare AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<nav\b.*?</nav\s*>', ' ', 'g'), '(?is)<header\b.*?</header\s*>', ' ', 'g'), '(?is)<footer\b.*?</footer\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS html FROM pages),
raw AS (SELECT doc_id, unnest(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li|pre|figcaption|caption)\b[^>]*>.*?</(?:h[1-6]|p|li|pre|figcaption|caption)\s*>')) AS b,
  generate_subscripts(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li|pre|figcaption|caption)\b[^>]*>.*?</(?:h[1-6]|p|li|pre|figcaption|caption)\s*>'), 1) AS k FROM bare),
blocks AS (SELECT doc_id, k, lower(regexp_extract(b, '(?is)^<([a-z0-9]+)', 1)) AS tag,
  trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(b, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS text FROM raw),
pel AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS pos,
  CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list_item' WHEN tag = 'pre' THEN 'code' WHEN tag LIKE '%caption' THEN 'caption' ELSE 'paragraph' END AS kind,
  CASE WHEN tag LIKE 'h%' THEN CAST(substr(tag, 2, 1) AS INT) END AS level, text FROM blocks WHERE text <> '')
"""


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def elements(spark, sf_dir):
    return as_elements(text_elements(documents(spark, sf_dir)))


def page_elements(spark, sf_dir, group: int = 1):
    """Pages as elements; ``group`` neighbouring pages make one document."""
    e = html_elements(spread(table(spark, sf_dir, "pages")))
    if group > 1:
        w = Window.partitionBy("g").orderBy("doc_id", "pos")
        e = e.withColumn("g", F.floor(F.col("doc_id") / group).cast("bigint")).withColumn("pos", (F.row_number().over(w) - 1).cast("int")).drop("doc_id").withColumnRenamed("g", "doc_id").withColumn("id", F.concat(F.lit("el_"), F.col("pos").cast("string")))
    return as_elements(with_parents(e))


GROUPED_SQL = PAGES_SQL + """,
gel AS (SELECT CAST(doc_id // 5 AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 5 ORDER BY pel.doc_id, pos) - 1 AS INT) AS pos, kind, level, text FROM pel)
"""


@query(f"WITH {ELEMENTS_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_elements, CAST(sum(tokens) AS BIGINT) AS n_tokens, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM el GROUP BY doc_id")
def elements_from_documents(spark, sf_dir):
    e = elements(spark, sf_dir)
    return e.groupBy("doc_id").agg(F.count("*").alias("n_elements"), F.sum(fx.count_tokens("text")).cast("bigint").alias("n_tokens"), F.sum(F.length("text")).alias("n_chars"))


@query(f"WITH {PAGES_SQL} SELECT doc_id, pos, kind, coalesce(level, 0) AS level, text FROM pel")
def html_page_elements(spark, sf_dir):
    return html_elements(table(spark, sf_dir, "pages")).select("doc_id", "pos", "kind", F.coalesce("level", F.lit(0)).alias("level"), "text")


@query(f"""WITH {GROUPED_SQL} SELECT doc_id, pos, kind, CASE WHEN kind = 'heading' THEN -1 ELSE
  coalesce(last_value(CASE WHEN kind = 'heading' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) END AS parent_pos FROM gel""")
def heading_parent(spark, sf_dir):
    e = page_elements(spark, sf_dir, 5)
    return e.select("doc_id", "pos", "kind", F.coalesce(F.regexp_extract("parent_id", r"(\d+)", 1).try_cast("int"), F.lit(-1)).alias("parent_pos"))


@query(f"""WITH {ELEMENTS_SQL}, {PAGES_SQL.strip()}, every AS (
  SELECT doc_id, 'paragraph' AS kind FROM el UNION ALL SELECT -1 - doc_id // 5, kind FROM pel),
p AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'heading') AS h, count(*) FILTER (WHERE kind IN ('paragraph', 'list_item', 'code', 'caption')) AS t FROM every GROUP BY doc_id)
SELECT CASE WHEN h >= 3 AND h / greatest(t, 1) >= 0.03 THEN 'structural' ELSE 'paragraph_fallback' END AS route, CAST(count(*) AS BIGINT) AS n_documents, CAST(sum(h) AS BIGINT) AS n_headings FROM p GROUP BY 1""")
def profile_route(spark, sf_dir):
    pages = page_elements(spark, sf_dir, 5).withColumn("doc_id", -1 - F.col("doc_id"))
    p = route(build_profile(elements(spark, sf_dir).unionByName(pages)))
    return p.groupBy("route").agg(F.count("*").alias("n_documents"), F.sum("heading_count").alias("n_headings"))


def planted(spark, sf_dir):
    """Documents with debris put where commas and full stops stand; nothing in the tables is dirty by itself."""
    dirty = F.replace(F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" ,  ")), F.lit(". "), F.lit("..... ")), F.lit("the "), F.lit("the\x07 ( "))
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit("  "), dirty, F.lit(" 【12†L3-L9】 •")).alias("text"))


DIRTY_SQL = "dirty AS (SELECT doc_id, '  ' || replace(replace(replace(text, ', ', ' ,  '), '. ', '..... '), 'the ', 'the' || chr(7) || ' ( ') || ' 【12†L3-L9】 •' AS t0 FROM documents)"
_RULES = [("control", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), ("citation", r"【?\s*\d+\s*†\s*L?[\d\s\-–L]{0,24}】?", ""), ("leaders", r"\.{4,}", " "), ("bullets", r"(?m)[ \t]*[·•▪●○◦]+[ \t]*$", ""), ("punct", r"[ \t]+([,.;:!?%)\]])", r"\1"), ("bracket", r"([(\[])[ \t]+", r"\1"), ("spaces", r"[ \t]{2,}", " ")]


def _clean_sql() -> str:
    steps, last = [DIRTY_SQL], "dirty"
    for k, (_, pattern, to) in enumerate(_RULES):
        steps.append(f"s{k} AS (SELECT *, len(regexp_extract_all(t{k}, '{pattern}')) AS n{k}, regexp_replace(t{k}, '{pattern}', '{to}', 'g') AS t{k + 1} FROM {last})")
        last = f"s{k}"
    return "WITH " + ",\n".join(steps) + f", done AS (SELECT *, trim(t{len(_RULES)}, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM {last})\n"


_FIXES = {"n0": "control_chars", "n1": "citation_markers", "n2": "dot_leaders", "n3": "trailing_bullets", "n4": "space_before_punctuation", "n5": "space_after_bracket", "n6": "repeated_spaces"}


@query(_clean_sql() + "SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars, " + ", ".join(f"CAST({a} AS BIGINT) AS {b}" for a, b in _FIXES.items()) + " FROM done")
def clean_planted(spark, sf_dir):
    c = cleaning.clean_text(planted(spark, sf_dir), normalise=False)
    n = [F.coalesce(F.element_at("fixes", F.lit(r)), F.lit(0)).alias(r) for r in _FIXES.values()]
    return c.select("doc_id", F.md5(F.col("text")).alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"), *n)


@query(_clean_sql() + "SELECT rule, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS rule, sum({a}) AS n FROM done" for a, b in _FIXES.items()) + " UNION ALL SELECT 'surrounding_whitespace', count(*) FROM done WHERE t <> t7) WHERE n > 0")
def cleaning_report(spark, sf_dir):
    return cleaning.cleaning_report(cleaning.clean_text(planted(spark, sf_dir), normalise=False))


@query()
def clean_normalised(spark, sf_dir):
    """With NFKC, which SQL has no function for: full-width letters planted in every text come back as plain ones."""
    wide = documents(spark, sf_dir).select("doc_id", F.translate("text", "aeo", "ａｅｏ").alias("text"))
    c = cleaning.clean_text(wide)
    return c.select("doc_id", F.md5(F.col("text")).alias("text_md5"), F.coalesce(F.element_at("fixes", F.lit("unicode_normalised")), F.lit(0)).alias("n_normalised"))


@query("SELECT CAST(sum(length(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))) AS BIGINT) AS n_chars, CAST(count(DISTINCT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS BIGINT) AS n_texts FROM documents")
def norm_texts(spark, sf_dir):
    return documents(spark, sf_dir).select(fx.norm(F.col("text")).alias("n")).agg(F.sum(F.length("n")).alias("n_chars"), F.count_distinct("n").alias("n_texts"))


ANAPHORA_SQL = r"(?im)\bas (shown|described|noted|mentioned|discussed) (above|earlier|previously|below)\b|\bthis (table|figure|section|chart|diagram|approach|result)\b|\bthe (former|latter)\b|^(This|These|It|They)\b"
SENTENCES_SQL = r"list_filter(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"
RATE_SQL = "CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: regexp_matches(x, '" + ANAPHORA_SQL + "'))) / len(s) ELSE CAST(0 AS DOUBLE) END"


@query(f"WITH d AS (SELECT doc_id, {SENTENCES_SQL.format('text')} AS s FROM documents) SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, round({RATE_SQL}, 6) AS rate, {RATE_SQL} > 0.10 AS escalated FROM d")
def anaphora_rate(spark, sf_dir):
    d = documents(spark, sf_dir)
    none = F.array().cast("array<string>")
    flags = quality.escalation_flags(F.col("text"), none, F.lit("temporal"))
    return d.select("doc_id", F.size(fx.sentences(F.col("text"))).alias("n_sentences"), F.round(fx.anaphora_rate(F.col("text")), 6).alias("rate"), (F.size(flags) > 0).alias("escalated"))


@query(f"WITH {GROUPED_SQL}, s AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS region FROM gel) SELECT doc_id, CAST(region AS INT) AS region, CAST(count(*) AS BIGINT) AS n_elements, CAST(sum({tok('text')}) AS BIGINT) AS n_tokens FROM s GROUP BY ALL")
def sections(spark, sf_dir):
    s = chunk.sections(page_elements(spark, sf_dir, 5))
    return s.groupBy("doc_id", "region").agg(F.count("*").alias("n_elements"), F.sum(fx.count_tokens("text")).cast("bigint").alias("n_tokens"))


PACK_SQL = """packed AS (
  SELECT doc_id, pos, tokens, 0 AS grp, tokens AS used FROM el WHERE pos = 0
  UNION ALL
  SELECT e.doc_id, e.pos, e.tokens, CASE WHEN p.used + e.tokens > 700 THEN p.grp + 1 ELSE p.grp END, CASE WHEN p.used + e.tokens > 700 THEN e.tokens ELSE p.used + e.tokens END
  FROM packed p JOIN el e ON e.doc_id = p.doc_id AND e.pos = p.pos + 1)"""


@query(f"WITH RECURSIVE {ELEMENTS_SQL}, {PACK_SQL} SELECT doc_id, CAST(grp AS INT) AS grp, CAST(count(*) AS BIGINT) AS n_elements, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM packed GROUP BY doc_id, grp")
def packed_units(spark, sf_dir):
    p = chunk.packed_elements(elements(spark, sf_dir), 700)
    return p.groupBy("doc_id", "grp").agg(F.count("*").alias("n_elements"), F.sum("cost").cast("bigint").alias("n_tokens"))


@query(f"""WITH {ELEMENTS_SQL}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dist, sum(tokens) OVER (PARTITION BY doc_id) AS total FROM el),
q AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM r),
c AS (SELECT doc_id, pos, round(CAST(0.4 AS DOUBLE) - CAST(0.6 AS DOUBLE) * abs(dist - 500) / 500, 9) AS score FROM q WHERE pos > 0 AND total > 700)
SELECT doc_id, pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k FROM c) WHERE k = 1""")
def best_cut(spark, sf_dir):
    """The first cut of documents of more than 700 tokens."""
    scratch = Scratch(spark)
    e = scratch.cut(elements(spark, sf_dir), "elements")
    edges = scratch.cut(build_edges(e), "edges")
    total = Window.partitionBy("doc_id")
    regions = e.select("doc_id", "pos", fx.count_tokens("text").alias("tokens"), F.lit(0).alias("region")).withColumn("total", F.sum("tokens").over(total)).filter("total > 700")
    cuts = best_cuts(regions, candidates(e, edges), relationship_loss(e, edges))
    return cuts.select("doc_id", "pos", F.round("score", 6).alias("score"))


@query()
def adaptive_units(spark, sf_dir):
    """The exact cut: each document's regions cut again and again; tested against a plain walk."""
    scratch = Scratch(spark)
    e = scratch.cut(elements(spark, sf_dir), "elements")
    cuts = scratch.cut(chunk.cut_regions(e.withColumn("region", F.lit(0).cast("int")), scratch.cut(build_edges(e), "edges")), "cuts")
    units = chunk.text_units(e, cuts)
    return units.select("doc_id", "unit", F.md5(F.col("content")).alias("content_md5"), "token_count", "overflow", "was_cut")


@query()
def engine_units(spark, sf_dir):
    """The whole engine over pages and documents."""
    pages = page_elements(spark, sf_dir, 5).withColumn("doc_id", -1 - F.col("doc_id"))
    r = process(elements(spark, sf_dir).unionByName(pages))
    return r.units.select("doc_id", "seq", "id", "strategy", "unit_type", "token_count", F.size("heading_path").alias("depth"), F.size("relationships").alias("n_links"), "context_completeness")


@query(f"WITH {ELEMENTS_SQL}, n AS (SELECT doc_id, CAST({tok('text')} AS INT) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, n, 448)) AS first_token FROM n WHERE n > 0) SELECT doc_id, CAST(first_token // 448 AS INT) AS chunk, CAST(first_token AS INT) AS first_token, CAST(least(512, n - first_token) AS INT) AS n_tokens FROM c")
def fixed_chunks(spark, sf_dir):
    return chunk.fixed_chunks(documents(spark, sf_dir))


@query(f"""WITH {GROUPED_SQL}, p AS (SELECT doc_id, pos, kind, last_value(CASE WHEN kind = 'heading' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS par FROM gel),
w AS (SELECT doc_id, par, pos FROM p WHERE kind <> 'heading' AND par IS NOT NULL),
d AS (SELECT doc_id, par + 1 AS pos, CAST(0.95 AS DOUBLE) AS d FROM w UNION ALL SELECT doc_id, pos + 1, CAST(-0.95 AS DOUBLE) FROM w),
g AS (SELECT doc_id, pos, sum(d) AS d FROM d GROUP BY ALL)
SELECT doc_id, pos, round(sum(coalesce(d, 0)) OVER (PARTITION BY doc_id ORDER BY pos), 4) + 0.0 AS loss FROM gel LEFT JOIN g USING (doc_id, pos) QUALIFY pos > 0""")
def relationship_loss_prefix(spark, sf_dir):
    """What a cut before each element of a page group severs, by heading ancestry alone."""
    e = page_elements(spark, sf_dir, 5)
    from tessera.operators.graph import hierarchy

    return relationship_loss(e, hierarchy(e)).select("doc_id", "pos", (F.round("loss", 4) + F.lit(0.0)).alias("loss"))


@query(f"WITH {GROUPED_SQL} SELECT doc_id, CAST(count(*) FILTER (WHERE kind <> 'heading' AND par IS NOT NULL) AS BIGINT) AS n_parent, CAST(max(pos) AS BIGINT) AS n_pairs FROM (SELECT doc_id, pos, kind, last_value(CASE WHEN kind = 'heading' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS par FROM gel) GROUP BY doc_id HAVING max(pos) > 0")
def graph_edges_hierarchy(spark, sf_dir):
    """Edges of page groups: ancestry, and neighbours linked in some way (every neighbouring pair is)."""
    e = page_elements(spark, sf_dir, 5)
    edges = build_edges(e)
    at = e.select("doc_id", "id", "pos")
    pair = edges.join(at.toDF("doc_id", "src", "a"), ["doc_id", "src"]).join(at.toDF("doc_id", "dst", "b"), ["doc_id", "dst"])
    return pair.groupBy("doc_id").agg(F.count_if(F.col("type") == "parent").alias("n_parent"), F.count_if(F.col("b") == F.col("a") + 1).alias("n_pairs"))


def labelled(e):
    """Elements with planted floats: every seventh paragraph becomes a table with a label in a caption; its neighbours ask and mention."""
    k = F.floor(F.col("pos") / 7) + 1
    m = F.col("pos") % 7
    text = F.when(m == 3, F.concat(F.lit("Table "), (k + 10).cast("string"), F.lit(" holds it"))).when(m == 4, F.concat(F.lit("See Table "), (k + 10).cast("string"), F.lit(" and table 1."))).when(m == 5, F.lit("What follows from it?")).otherwise(F.col("text"))
    kind = F.when(m == 2, "table").when(m == 3, "caption").otherwise("paragraph")
    caps = F.when(m == 2, F.array(F.concat(F.lit("el_"), (F.col("pos") + 1).cast("string"))))
    return e.withColumn("text", text).withColumn("kind", kind).withColumn("caption_ids", caps)


LABELLED_SQL = ELEMENTS_SQL + """, lab AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 2 THEN 'table' WHEN pos % 7 = 3 THEN 'caption' ELSE 'paragraph' END AS kind,
  CASE WHEN pos % 7 = 3 THEN 'Table ' || (pos // 7 + 11) || ' holds it' WHEN pos % 7 = 4 THEN 'See Table ' || (pos // 7 + 11) || ' and table 1.' WHEN pos % 7 = 5 THEN 'What follows from it?' ELSE text END AS text FROM el WHERE pos < 28)"""


@query(f"""WITH {LABELLED_SQL}, t AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM lab WHERE kind = 'table'),
lbl AS (SELECT l.doc_id, l.pos - 1 AS pos, CAST(regexp_extract(l.text, 'Table (\\d+)', 1) AS INT) AS num FROM lab l WHERE kind = 'caption' AND EXISTS (SELECT 1 FROM t WHERE t.doc_id = l.doc_id AND t.pos = l.pos - 1)),
m AS (SELECT doc_id, pos, CAST(unnest(regexp_extract_all(text, '(?i)\\b(?:Table|Figure|Fig\\.?)\\s+(\\d+)', 1)) AS INT) AS num FROM lab WHERE kind IN ('paragraph', 'caption')),
r AS (SELECT DISTINCT m.doc_id, m.pos AS src, coalesce(lbl.pos, t.pos) AS dst FROM m LEFT JOIN lbl ON lbl.doc_id = m.doc_id AND lbl.num = m.num LEFT JOIN t ON t.doc_id = m.doc_id AND t.nth = m.num)
SELECT doc_id, CAST(src AS INT) AS src, CAST(dst AS INT) AS dst FROM r WHERE dst IS NOT NULL""")
def graph_references(spark, sf_dir):
    e = labelled(elements(spark, sf_dir).filter("pos < 28"))
    from tessera.operators.graph import declared_captions

    at = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("int")
    return references(e, declared_captions(e)).select("doc_id", at("src").alias("src"), at("dst").alias("dst"))


@query(f"""WITH {LABELLED_SQL}, n AS (SELECT *, lag(kind) OVER w AS bk, lag(text) OVER w AS bt, lead(kind) OVER w AS ak FROM lab WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, 'explains' AS type FROM n WHERE kind = 'table' AND bk IN ('paragraph', 'list_item') AND length(bt) > 20
UNION ALL SELECT doc_id, pos, 'answered_by' FROM n WHERE (trim(text) LIKE '%?') AND ak = 'paragraph'""")
def graph_neighbours(spark, sf_dir):
    e = labelled(elements(spark, sf_dir).filter("pos < 28"))
    at = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("int").alias("pos")
    return explains(e).select("doc_id", at("float"), F.lit("explains").alias("type")).unionByName(answers(e).select("doc_id", at("asks"), F.lit("answered_by").alias("type")))


@query()
def graph_edges_planted(spark, sf_dir):
    """All edge types of the planted documents, which are whole, with overwriting resolved; tested on a small fixture."""
    return build_edges(labelled(elements(spark, sf_dir))).groupBy("type").agg(F.count("*").alias("n_edges"), F.round(F.sum("importance"), 4).alias("importance"))


@query(f"""WITH {GROUPED_SQL}, s AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above,
  sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, CASE WHEN kind IN ('paragraph', 'list_item') AND length(text) > 40 THEN substr(text, 1, 320) END AS prose FROM gel)
SELECT doc_id, pos, last_value(prose IGNORE NULLS) OVER (PARTITION BY doc_id, coalesce(above, 0) ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS leading,
  first_value(prose IGNORE NULLS) OVER (PARTITION BY doc_id, upto ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS trailing FROM s""")
def surrounding_prose(spark, sf_dir):
    e = page_elements(spark, sf_dir, 5)
    return surrounding_text(e).join(e.select("doc_id", "id", "pos"), ["doc_id", "id"]).select("doc_id", "pos", "leading", "trailing")


@query("""WITH RECURSIVE t AS (SELECT CAST(n_nationkey AS BIGINT) + 100 AS id, CAST(n_regionkey AS BIGINT) AS up, n_name AS name FROM nation UNION ALL SELECT r_regionkey, CASE WHEN r_regionkey > 0 THEN CAST(r_regionkey AS BIGINT) - 1 END, r_name FROM region),
w AS (SELECT id, up, CAST('' AS VARCHAR) AS path FROM t UNION ALL SELECT w.id, t.up, CASE WHEN w.path = '' THEN t.name ELSE t.name || ' > ' || w.path END FROM w JOIN t ON t.id = w.up)
SELECT id, path FROM w WHERE up IS NULL AND path <> ''""")
def heading_path_recursive(spark, sf_dir):
    """Ancestor paths of a planted tree: nations under regions, each region under the one before it."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("k"), F.col("n_regionkey").cast("bigint").alias("up"), F.col("n_name").alias("text"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.when(F.col("r_regionkey") > 0, F.col("r_regionkey").cast("bigint") - 1).alias("up"), F.col("r_name").alias("text"))
    e = as_elements(n.unionByName(r).select(F.lit(0).alias("doc_id"), F.col("k").cast("int").alias("pos"), F.col("k").cast("string").alias("id"), F.col("up").cast("string").alias("parent_id"), F.lit("heading").alias("kind"), "text"))
    return heading_paths(e).select(F.col("id").cast("bigint").alias("id"), F.array_join("path", " > ").alias("path"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def cross_doc_mentions(spark, sf_dir):
    return links.containments(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query(f"""WITH RECURSIVE {ELEMENTS_SQL}, {PACK_SQL}, n AS (SELECT doc_id, {tok('text')} AS n FROM documents),
f AS (SELECT doc_id, CASE WHEN n > 0 THEN (n - 1) // 448 + 1 ELSE 0 END AS fixed FROM n), u AS (SELECT doc_id, grp, sum(tokens) AS size FROM packed GROUP BY ALL), a AS (SELECT doc_id, count(*) AS units FROM u GROUP BY ALL)
SELECT lang, CAST(sum(coalesce(units, 0)) AS BIGINT) AS n_units, CAST(sum(fixed) AS BIGINT) AS n_fixed, round(any_value(m), 4) AS mean_size, round(any_value(s), 4) AS deviation FROM documents d JOIN f USING (doc_id) LEFT JOIN a USING (doc_id)
JOIN (SELECT lang, avg(size) AS m, stddev_pop(size) AS s FROM u JOIN documents USING (doc_id) GROUP BY lang) z USING (lang) GROUP BY lang""")
def units_by_language(spark, sf_dir):
    """The flagship: for each language, packed units against fixed windows, and the size of units."""
    d = documents(spark, sf_dir)
    units = chunk.packed_elements(elements(spark, sf_dir), 700).groupBy("doc_id", "grp").agg(F.sum("cost").alias("size"))
    sizes = units.join(d.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n_units"), F.round(F.avg("size"), 4).alias("mean_size"), F.round(F.stddev_pop("size"), 4).alias("deviation"))
    n = fx.count_tokens("text")
    fixed = d.groupBy("lang").agg(F.sum(F.when(n > 0, F.floor((n - 1) / 448) + 1).otherwise(0)).alias("n_fixed"))
    return sizes.join(fixed, "lang").select("lang", "n_units", "n_fixed", "mean_size", "deviation")
