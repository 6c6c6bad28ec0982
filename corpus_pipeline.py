"""A training corpus from raw documents: five stages, each a table that the next one reads.

Toxic documents go, repeated lines go, one document of each near-duplicate group stays, documents that hold
benchmark items go, and what is left is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import Scratch, table
from tessera.llm.decontam import decontaminate
from tessera.llm.line_dedup import ADDED, dedup_lines
from tessera.llm.packing import pack_documents
from tessera.llm.simhash import one_of_each
from tessera.llm.toxicity import reject_toxic

TOKENIZER = "byte_bpe_50k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not predict toxic."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that one with a smaller ``doc_id`` has; ``n_chars`` follows the text."""
    held = docs.withColumnsRenamed({c: f"held_{c}" for c in ADDED if c in docs.columns})
    kept = dedup_lines(held, least=10).drop(*ADDED).withColumnsRenamed({f"held_{c}": c for c in ADDED})
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest ``doc_id`` of each group."""
    return one_of_each(docs, words=4, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), words=5, least=0.8)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    return pack_documents(docs, tokens.public_path(TOKENIZER), limit=1024, end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no tokenizer, no compressor and no XXH64.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written in the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
