"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import table
from tessera.llm.decontam import contamination
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.packing import pack_documents
from tessera.llm.passages import repeated_passages
from tessera.llm.secrets import find_secrets, span_list
from tessera.llm.simhash import simhash_components
from tessera.llm.token_counts import token_counts
from tessera.llm.toxicity import score, train
from tessera.llm.vectors import near_vectors, true_links
from tessera.llm.wavelet import token_files

BPE = "byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), least=0.8, every=True)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    audited = F.broadcast(true_links(rows, least=0.95, queries=200))
    return near_vectors(rows, least=0.95).join(audited, "vec_id", "left")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=5, least=0.8)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), repo="source")
    digest = F.sha2(span_list(F.col("spans"), base_only=True), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), span_list(F.col("spans")).alias("spans"), "n_live", "n_example")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokens.public_path(BPE), limit=1024, end_id=2)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), words=4, radius=4, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokens.public_path(BPE), limit=512)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokens.public_path(BPE), end_id=0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = (op1_line_dedup, op2_substring_dedup, op3_embedding_near_dedup, op4_decontamination, op5_secret_scan, op6_best_fit_packing, op7_simhash_near_dedup, op8_token_counts, op9_token_files, op10_toxicity)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


#: Lines by document with what each key's smallest document is.
_LINES = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (
  SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM held GROUP BY doc_id
"""


_KINDS = (
    ("assign", r"(?i:(?:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+"),
    ("access", r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]{24,}"),
    ("owned", r"[A-Za-z0-9+/_=-]{20,}"),
)
#: Matches and the gaps between them alternate through a text, so running lengths give their places.
_SECRETS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS source FROM documents), raw AS (" + "\nUNION ALL ".join(
    f"SELECT doc_id, source, {k} AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS gap, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS k FROM d" for k, (_, p) in enumerate(_KINDS)
) + r"""),
placed AS (SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM raw WINDOW w AS (PARTITION BY doc_id, kind ORDER BY k)),
valued AS (SELECT doc_id, source, kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, CASE WHEN kind = 0 THEN regexp_extract(m, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE m END AS v FROM placed),
base AS (SELECT * FROM valued WHERE kind < 3 AND NOT (kind = 0 AND length(v) < 6)),
apart AS (SELECT * FROM valued o WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.s < o.e AND o.s < b.e)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM apart), held AS (SELECT v, count(DISTINCT source) AS owners FROM found GROUP BY v),
named AS (SELECT f.*, owners, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e AS t FROM found f JOIN held USING (v) WHERE kind < 3 OR owners <= 1),
lists AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c, string_agg(t, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3) AS base, string_agg(t, ',' ORDER BY s, kind, e) AS spans, count(*) FILTER (WHERE owners <= 1) AS live, count(*) FILTER (WHERE owners > 1) AS example FROM named GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(live, 0) AS BIGINT) AS n_live, CAST(coalesce(example, 0) AS BIGINT) AS n_example FROM d LEFT JOIN lists USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _LINES, "op5_secret_scan": _SECRETS}
