"""Token counts from a corpus-wide table of pre-tokens."""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import Scratch, parts, texts

#: Distinct pre-tokens that a task gathers before it hands them on.
FLUSH = 200_000
#: Most frequent pre-tokens that are broadcast, and bytes of the longest of them: a bound of 10 MB.
HOT, HOT_BYTES = 300_000, 32


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, hot: int = HOT) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    A first pass lists the corpus's distinct pre-tokens with their number of occurrences, combined in each
    task before the shuffle. The pieces of each are counted once. A second pass joins these counts to the
    documents' pre-token frequencies and sums; the ids of a text are never made. At most ``hot`` pre-tokens,
    the most frequent, are joined by a broadcast, which leaves the rare ones to a shuffle of (document,
    pre-token, frequency) rows.

    That is for byte-level BPE files, whose pre-tokens are independent of each other. Other files have no
    such pre-tokens here: their library encodes each text, one at a time.

    A null or empty text has 0 bytes and 0 tokens; repeated rows each give a row; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    if isinstance(tokens.load(tokenizer), tokens.ByteLevelBPE):
        counted = _by_pretokens(rows, tokenizer, hot)
    else:
        counted = rows.mapInArrow(_whole(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _whole(tokenizer: str):
    def count(batches):
        tok = tokens.load(tokenizer)
        for batch in parts(batches):
            n = pa.array([tok.count_piece(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"]
            )

    return count


def _by_pretokens(rows: DataFrame, tokenizer: str, hot: int) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "tokens")

    def listed(batches):
        tok, seen = tokens.load(tokenizer), Counter()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"]
            )

        for batch in parts(batches):
            for text in batch.column("text"):
                seen.update(tok.pretokens(text.as_py())[0])
                if len(seen) >= FLUSH:
                    yield flush()
                    seen.clear()
        yield flush()

    def pieces(batches):
        tok = tokens.load(tokenizer)
        for batch in batches:
            k = pa.array([tok.count_piece(w.as_py()) for w in batch.column("word")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, k], ["word", "n", "pieces"])

    words = rows.select("text").mapInArrow(listed, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = scratch.cut(words.mapInArrow(pieces, "word string, n long, pieces long"), "vocabulary")
    step = F.floor(F.log2("n") * 8)  # frequencies in eighths of a doubling: a few hundred rows
    sizes = sorted(((r.step, r["count"]) for r in vocabulary.groupBy(step.alias("step")).count().collect()), reverse=True)
    fits = [at for at, total in zip((at for at, _ in sizes), accumulate(n for _, n in sizes)) if total <= hot]
    is_hot = (step >= (fits[-1] if fits else 1 << 20)) & (F.octet_length("word") <= HOT_BYTES)
    frequent = {r.word: r.pieces for r in vocabulary.filter(is_hot).select("word", "pieces").collect()}
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def tally(batches):
        """A row a document; its pre-tokens outside the broadcast beside it, with their frequencies."""
        tok, known = tokens.load(tokenizer), shared.value
        for batch in parts(batches):
            n, cold = [], []
            for text in batch.column("text"):
                words, special = tok.pretokens(text.as_py())
                seen = Counter(words)
                rest = [(w, k) for w, k in seen.items() if w not in known]
                n.append(special + sum(known[w] * k for w, k in seen.items() if w in known))
                cold.append([{"word": w, "k": k} for w, k in rest])
            cold = pa.array(cold, pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), cold],
                ["doc_id", "n_bytes", "n", "cold"],
            )

    schema = "doc_id long, n_bytes long, n long, cold array<struct<word:string,k:bigint>>"
    counted = rows.mapInArrow(tally, schema).withColumn("row", F.monotonically_increasing_id())
    counted = scratch.cut(counted, "tally")
    asked = counted.filter(F.size("cold") > 0).select("row", F.inline("cold"))
    found = asked.join(vocabulary.filter(~is_hot).select("word", "pieces"), "word")
    more = found.groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("more"))
    out = counted.select("row", "doc_id", "n_bytes", "n").join(more, "row", "left")
    return out.select("doc_id", "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
