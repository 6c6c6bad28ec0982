"""Toxicity by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, parts, texts

#: Stands before every window and ends every dictionary: zstd stores very short inputs as they are.
LEAD = b"window of words to be weighed: "
#: Words of a window, and from the start of one to that of the next.
WORDS, STRIDE = 4, 2
#: Bytes saved by the toxic dictionary, from which windows are tallied.
MARGINS = tuple(range(-2, 9))
#: Windows that save most, whose sums count beside the tallies.
TOP = 6
#: How much more often (as a logarithm) toxic documents have a word that can tell them, and the documents
#: that it must add; the words that each document should have.
TELLING, LEAST, COVER = 2.5, 3, 2
#: Bytes of the part that both dictionaries share, and of the toxic part at most.
COMMON, OWN = 8192, 4096
#: Ordinary windows that the library's trainer reads.
TRAINED_ON = 40_000
WORD = regex.compile(r"[\p{L}\p{N}]+")


def windows(text: str, words: int = WORDS, stride: int = STRIDE) -> list[bytes]:
    """Windows of ``words`` lower-cased words with a blank at both ends, ``stride`` words apart; the last ends the text."""
    found = WORD.findall(text.lower())
    if not found:
        return []
    starts = [*range(0, len(found) - words, stride), max(len(found) - words, 0)]
    return [f" {' '.join(found[i : i + words])} ".encode() for i in starts]


def compressor(dictionary: bytes):
    """Compressed bytes under a dictionary as it is. Matches of three bytes count, as the gain of a word is a few bytes."""
    loaded = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        12, source_size=128, dict_size=len(dictionary), strategy=zstandard.STRATEGY_GREEDY, min_match=3,
        search_log=5, target_length=64, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    loaded.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=loaded, compression_params=how).compress


@dataclass
class Model:
    """Two dictionaries and the weights that turn window tallies into a probability."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.centre) / self.spread) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Measure:
    """Features of texts: how many windows the toxic dictionary makes shorter, by how many bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)

    def saved(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, for each window."""
        toxic, ordinary = self.toxic, self.ordinary
        return np.array([len(ordinary(LEAD + w)) - len(toxic(LEAD + w)) for w in windows(text)] or [0])

    def __call__(self, text: str) -> np.ndarray:
        saved = self.saved(text)
        tally = np.array([np.count_nonzero(saved >= m) for m in MARGINS], float)
        n = max(len(saved), 8)
        most = np.sort(saved)[: -TOP - 1 : -1].clip(0).cumsum()
        most = np.pad(most, (0, TOP - len(most)), mode="edge")
        return np.concatenate([tally / n, math.log(n) * tally[3:] / n, np.log1p(tally[4:10]), most, most / math.log(n)])


def covering(documents: list[frozenset], candidates: dict[bytes, int]) -> list[bytes]:
    """Few words that between them stand in each document COVER times.

    Greedy, as the library's trainer is: the word comes next that the most documents still need, less twice
    the ordinary documents that have it (``candidates`` gives their number), until none adds LEAST.
    """
    holders: dict[bytes, list[int]] = {}
    for k, found in enumerate(documents):
        for w in found & candidates.keys():
            holders.setdefault(w, []).append(k)
    need = [COVER] * len(documents)
    heap = [(2 * candidates[w] - len(h), w) for w, h in holders.items()]
    heapq.heapify(heap)
    out = []
    while heap:
        was, w = heapq.heappop(heap)
        now = 2 * candidates[w] - sum(need[k] > 0 for k in holders[w])
        if now > -LEAST:
            continue
        if now > was and heap and now > heap[0][0]:
            heapq.heappush(heap, (now, w))
            continue
        out.append(w)
        for k in holders[w]:
            need[k] -= 1
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """``size`` bytes trained on ``samples`` by the library, or the samples themselves where they are too few."""
    try:
        found = zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        found = b"".join(samples)
    return found[-size:].rjust(size, b" ")


def dictionaries(rows: list[tuple[int, str]]) -> tuple[bytes, bytes]:
    """A toxic and an ordinary dictionary of equal size, trained on (label, text).

    Both begin with one part trained on ordinary windows, so that what the classes have in common costs the
    same under either and only what follows makes a difference: there the toxic dictionary has the
    words that cover the toxic documents among those they have far more often, the ordinary one as many bytes
    of further ordinary text.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    docs, toxic = [0, 0], []
    for label, text in rows:
        found = frozenset(windows(text, 1, 1))
        seen[label].update(found)
        docs[label] += 1
        if label:
            toxic.append(found)
    rate = lambda w, k: math.log((seen[k][w] + 0.5) / (docs[k] + 1))
    telling = {w: seen[0][w] for w, n in seen[1].items() if n >= LEAST and rate(w, 1) - rate(w, 0) > TELLING}
    own, size = [], 0
    for w in covering(toxic, telling):
        if size + len(w) <= OWN:
            own.append(w)
            size += len(w)
    plain = sorted({w for label, text in rows if not label for w in windows(text, 2 * WORDS, 2 * WORDS)}, key=zlib.crc32)
    ordinary = trained(plain[:TRAINED_ON], COMMON + size)
    common, rest = ordinary[size:], ordinary[:size]
    return common + b"".join(reversed(own)) + LEAD, common + rest + LEAD


def fit(rows: list[tuple[int, str]], weight: tuple[float, float]) -> Model:
    """Train on (label, text) rows.

    Of three rows in order two go to the dictionaries, the third to the thresholds and weights, which so
    rest on texts that the dictionaries have not seen. ``weight`` is that of a row of each class.
    """
    toxic, ordinary = dictionaries([row for k, row in enumerate(rows) if k % 3])
    measure = Measure(toxic, ordinary)
    width = len(measure(""))
    x = np.array([measure(text) for _, text in rows[::3]]).reshape(-1, width)
    y = np.array([label for label, _ in rows[::3]], float)
    centre, spread = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(width), np.ones(width))
    a = np.c_[(x - centre) / spread, np.ones(len(x))]
    w, of_row = np.zeros(width + 1), np.where(y > 0, weight[1], weight[0])
    ridge = np.r_[np.ones(width), 1e-3]
    for _ in range(50):  # Newton steps of a logistic regression
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (of_row * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (of_row * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return Model(toxic, ordinary, w, centre, spread)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 3000, bytes_per_class: int = 12_000_000) -> Model:
    """Fit on a bounded sample: at most ``rows_per_class`` labelled rows of each class and ``bytes_per_class`` of text.

    Rows come by the smallest hash of ``doc_id`` until either is reached. Only rows that are not held out are
    asked; the classes keep their weights among all of those. The sample is the one thing that is brought
    to the driver, and its size does not grow with the data. Of a ``doc_id`` with several texts the first in
    order is taken, with several labels the larger.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    hashed = known.withColumn("h", F.xxhash64("doc_id"))
    first = [hashed.filter(F.col("toxic") == k).orderBy("h", "doc_id").limit(rows_per_class).collect() for k in (0, 1)]
    label = {r.doc_id: (r.toxic, r.h) for rows in first for r in rows}

    def asked(ids):
        # an Arrow table, as Python rows would start Python workers of another kind in each executor, which stay
        wanted = spark.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64())}))
        return texts(docs).join(F.broadcast(wanted), "doc_id")

    size = asked(list(label)).groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).collect()
    chosen, used = [], [0, 0]
    for r in sorted(size, key=lambda r: (label[r.doc_id][1], r.doc_id)):
        k = label[r.doc_id][0]
        used[k] += r.n
        if used[k] <= bytes_per_class:
            chosen.append(r.doc_id)
    rows = asked(chosen).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    have = Counter(label[r.doc_id][0] for r in rows)
    weight = tuple(total.get(k, 0) / max(have[k], 1) for k in (0, 1))
    scale = sum(have.values()) / max(sum(total.values()), 1)
    return fit([(label[r.doc_id][0], r.text) for r in rows], (weight[0] * scale, weight[1] * scale))


def scores(model: Model, column: pa.Array, measure: Measure) -> np.ndarray:
    features = [measure(t.as_py() or "") for t in column]
    return model.score(np.array(features)) if features else np.empty(0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Windows cover all of a text. A null or empty text has no window and the score of none. Repeated rows
    and rows without a ``doc_id`` are scored each (the latter are held out by no test: null); other columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches):
        measure = Measure(model.toxic, model.ordinary)
        for batch in parts(batches):
            p = pa.array(scores(model, batch.column("text"), measure), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), p], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rows whose text is predicted toxic; columns as they were, whatever their names.

    The decision is made where the text is, so that no text is shuffled. A null or empty text is scored as
    one without windows; rows without a ``doc_id`` and repeated rows are decided each; without labels every
    score is the same; an empty table stays empty.
    """
    model = train(docs, labels)
    inner, names = numbered(docs)
    body = names[docs.columns.index("text")]
    inner = inner.select(*names)

    def run(batches):
        measure = Measure(model.toxic, model.ordinary)
        for batch in parts(batches):
            yield batch.filter(pa.array(scores(model, batch.column(body), measure) < 0.5))

    return inner.mapInArrow(run, inner.schema).toDF(*docs.columns)
