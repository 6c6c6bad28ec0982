"""Token ids in compressed wavelet-matrix files."""

from __future__ import annotations

import mmap
import struct
import zlib
from bisect import bisect_right
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import Scratch, parts, texts

MAGIC = b"TWM2"
#: Header: magic, ids, bits, documents.
HEAD = struct.Struct("<4sQIQ")
#: Bits of a plane that are compressed together, and bits between two rank samples in them.
BLOCK, STEP = 1 << 19, 1 << 10
#: Inflated blocks that a reader keeps.
KEPT = 64


class WaveletMatrix:
    """Bit-planes from the highest bit, each stably sorted by the planes above, with sampled ranks.

    A plane is blocks of BLOCK bits. The directory (``zeros`` of each plane, ``before``: the ones before each
    block) is small; ``block(level, b)`` gives the rank samples and the bits of one block, from memory or out
    of a file. ``access``, ``rank`` (occurrences before a place) and ``select`` (place of an occurrence) ask for
    one or two blocks of each plane; ``decode`` takes all ids back at once.
    """

    def __init__(self, n: int, zeros: list[int], before: list[list[int]], block) -> None:
        self.n, self.bits, self.zeros, self.before, self.block = n, len(zeros), zeros, before, block

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        ids = np.asarray(ids, np.uint32)
        bits = bits or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        now = ids.astype(np.uint16) if bits <= 16 else ids
        planes, zeros, before = [], [], []
        for k in range(bits - 1, -1, -1):
            bit = ((now >> k) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (STEP // 8)))).reshape(-1, STEP // 8)
            ones = np.r_[0, np.cumsum(ones.sum(axis=1, dtype=np.int64))][:-1]
            starts = ones[:: BLOCK // STEP]
            blocks = []
            for b in range(-(-len(ids) // BLOCK)):
                samples = ones[b * BLOCK // STEP : (b + 1) * BLOCK // STEP] - starts[b]
                blocks.append((samples.astype(np.uint32), packed[b * BLOCK // 8 : (b + 1) * BLOCK // 8]))
            low, high = now[~bit], now[bit]
            planes.append(blocks)
            zeros.append(len(low))
            before.append([*starts[: len(blocks)].tolist(), len(high)])
            now = np.concatenate([low, high])
        return cls(len(ids), zeros, before, lambda level, b: planes[level][b])

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        b, rest = divmod(at, BLOCK)
        if not rest:
            return self.before[level][b]
        samples, packed = self.block(level, b)
        step, tail = divmod(rest, STEP)
        if step == len(samples):  # the end of the plane
            return self.before[level][-1]
        part = packed[step * STEP // 8 : step * STEP // 8 + (tail + 7) // 8]
        ones = int(np.bitwise_count(part).sum())
        if tail & 7:
            ones -= (int(part[-1]) >> (tail & 7)).bit_count()
        return self.before[level][b] + int(samples[step]) + ones

    def _bit(self, level: int, at: int) -> int:
        b, rest = divmod(at, BLOCK)
        return int(self.block(level, b)[1][rest >> 3]) >> (rest & 7) & 1

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            one = self._bit(level, at)
            value = value << 1 | one
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if one else at - ones
        return value

    def rank(self, value: int, at: int) -> int:
        """Occurrences of ``value`` among the first ``at`` ids."""
        if value >> self.bits:
            return 0
        start, end = 0, min(max(at, 0), self.n)
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, end)
            one = value >> (self.bits - 1 - level) & 1
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if one else (start - a, end - b)
        return end - start

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of ``value``, or -1."""
        if k < 0 or k >= self.rank(value, self.n):
            return -1
        start = 0
        for level in range(self.bits):
            a = self._ones(level, start)
            start = self.zeros[level] + a if value >> (self.bits - 1 - level) & 1 else start - a
        at = start + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            at = self._find(level, one, at - self.zeros[level] if one else at)
        return at

    def _find(self, level: int, one: int, k: int) -> int:
        """The place of the k-th one, or zero, of a plane: the block by the directory, the step by its samples."""
        before = self.before[level]
        had = lambda b: before[b] if one else b * BLOCK - before[b]
        b = bisect_right(range(len(before) - 1), k, key=had) - 1
        k -= had(b)
        samples, packed = self.block(level, b)
        had_in = lambda s: int(samples[s]) if one else s * STEP - int(samples[s])
        step = bisect_right(range(len(samples)), k, key=had_in) - 1
        bits = np.unpackbits(packed[step * STEP // 8 : (step + 1) * STEP // 8], bitorder="little")
        return b * BLOCK + step * STEP + int(np.flatnonzero(bits == one)[k - had_in(step)])

    def decode(self) -> np.ndarray:
        """All ids: from the last plane up, each parting into zeros and ones is undone by two sequential writes."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            packed = [self.block(level, b)[1] for b in range(len(self.before[level]) - 1)]
            packed = np.concatenate(packed) if packed else np.empty(0, np.uint8)
            bit = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[~bit] = values[: self.zeros[level]]
            above[bit] = values[self.zeros[level] :] | values.dtype.type(1 << (self.bits - 1 - level))
            values = above
        return values


def to_file(ids: np.ndarray, doc_ids: list[int], counts: list[int]) -> bytes:
    """One shard's file: header, directory, then zstd frames.

    The directory has the zeros of each plane, the ones before each of its blocks, and the end of each frame.
    The frames are the documents' ids, their lengths, and every block of every plane: its rank samples, then
    its bits.
    """
    wm = WaveletMatrix.build(ids)
    z = zstandard.ZstdCompressor(level=1)
    frames = [z.compress(np.asarray(doc_ids, "<i8").tobytes()), z.compress(np.asarray(counts, "<i8").tobytes())]
    for level in range(wm.bits):
        for b in range(len(wm.before[level]) - 1):
            samples, packed = wm.block(level, b)
            frames.append(z.compress(samples.astype("<u4").tobytes() + packed.tobytes()))
    directory = np.r_[wm.zeros, np.ravel(wm.before), np.cumsum([len(f) for f in frames])].astype("<u8")
    return HEAD.pack(MAGIC, wm.n, wm.bits, len(doc_ids)) + directory.tobytes() + b"".join(frames)


def from_file(blob) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """The matrix, the documents and their counts, out of a file's bytes or a map of them.

    Only the directory and the documents are read here; the matrix inflates a block when it is asked for,
    and keeps the last KEPT.
    """
    magic, n, bits, _ = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    per_plane = -(-n // BLOCK)
    size = bits + bits * (per_plane + 1) + 2 + bits * per_plane
    directory = np.frombuffer(blob, "<u8", size, HEAD.size).astype(np.int64)
    zeros, before, ends = np.split(directory, [bits, bits + bits * (per_plane + 1)])
    base = HEAD.size + 8 * size
    z = zstandard.ZstdDecompressor()

    def frame(k: int) -> bytes:
        return z.decompress(blob[base + (int(ends[k - 1]) if k else 0) : base + int(ends[k])])

    kept: OrderedDict = OrderedDict()

    def block(level: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        k = 2 + level * per_plane + b
        if k in kept:
            kept.move_to_end(k)
            return kept[k]
        raw = frame(k)
        steps = -(-min(BLOCK, n - b * BLOCK) // STEP)
        kept[k] = np.frombuffer(raw, "<u4", steps), np.frombuffer(raw, np.uint8, offset=4 * steps)
        if len(kept) > KEPT:
            kept.popitem(last=False)
        return kept[k]

    wm = WaveletMatrix(n, zeros.tolist(), before.reshape(bits, -1).tolist(), block)
    return wm, np.frombuffer(frame(0), "<i8"), np.frombuffer(frame(1), "<i8")


def open_file(path: str) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """:func:`from_file` over a map of a local file, of which only what is asked for is read."""
    with open(path, "rb") as f:
        return from_file(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


#: A shard file, what it holds, the task that wrote it and the ids which that task had written before.
SHARDS = "first_doc long, n_docs long, n_ids long, task int, before long, file binary"


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, shard_ids: int = 4_000_000, partitions: int | None = None) -> None:
    """Write the ids of all documents in ascending ``doc_id`` order, as a table of shard files at ``path``.

    The table is Parquet with one whole file image a row (up to some 8 MB, of which a worker decodes one at a
    time), so it can lie in any store that Spark reaches;
    :func:`export` puts the files themselves in a folder. Documents are dealt out by ranges of ``doc_id``;
    a task writes a file for every ``shard_ids`` ids, which bounds its memory. The longest document is
    never divided, so a file may pass ``shard_ids`` by that one document.
    """

    def build(batches):
        tok = tokens.load(tokenizer)
        ids: list[np.ndarray] = []
        doc_ids: list[int] = []
        held = before = 0
        task = TaskContext.get().partitionId()

        def shard():
            flat = np.concatenate(ids)
            file = to_file(flat, doc_ids, [len(x) for x in ids])
            numbers = [pa.array([x], pa.int64()) for x in (doc_ids[0], len(doc_ids), len(flat))]
            rest = [pa.array([task], pa.int32()), pa.array([before], pa.int64()), pa.array([file], pa.binary())]
            names = ["first_doc", "n_docs", "n_ids", "task", "before", "file"]
            return pa.RecordBatch.from_arrays([*numbers, *rest], names)

        for batch in parts(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if held >= shard_ids:
                    yield shard()
                    ids, doc_ids, held, before = [], [], 0, before + held
                ids.append(np.append(tok.ids(text.as_py()), end_id).astype(np.uint32))
                doc_ids.append(doc)
                held += len(ids[-1])
        if doc_ids:
            yield shard()

    rows = texts(docs).filter("doc_id IS NOT NULL")
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    dealt.sortWithinPartitions("doc_id").mapInArrow(build, SHARDS).write.mode("overwrite").option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, per document: ``doc_id, start, n_tokens, ids_crc32``.

    A shard knows the ids before it in its task; what the tasks before have written is a running sum over
    one row a task. Tasks have ranges of ``doc_id`` in ascending order.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    tasks = shards.groupBy("task").agg(F.sum("n_ids").alias("n")).collect()
    ends = np.cumsum([0, *(r.n for r in sorted(tasks))])
    bases = spark.createDataFrame([(r.task, int(e)) for r, e in zip(sorted(tasks), ends)], "task int, base long")
    placed = shards.join(F.broadcast(bases), "task").select((F.col("base") + F.col("before")).alias("start"), "file")

    def take_back(batches):
        for batch in parts(batches, 1):
            file = memoryview(batch.column("file")[0].as_buffer())
            start = batch.column("start")[0].as_py()
            wm, doc_ids, counts = from_file(file)
            ids = wm.decode().astype("<u4")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids), pa.array(ends - counts + start), pa.array(counts), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return placed.mapInArrow(take_back, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Put the shard files of a table into a local folder, one after the other, and return their names."""
    names = []
    for r in spark.read.schema(SHARDS).parquet(path).orderBy("task", "before").toLocalIterator():
        names.append(f"{folder}/ids-{len(names):05d}.twm")
        with open(names[-1], "wb") as f:
            f.write(r.file)
    return names


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all ids and read the files back: ``doc_id, start, n_tokens, ids_crc32``.

    A null or empty text is the end id alone. Rows without a ``doc_id`` have no place in the order and are
    left out; repeated ids are kept side by side. Other columns are ignored; an empty table gives an empty
    result.
    """
    scratch = Scratch(docs.sparkSession, "wavelet")
    write_shards(docs, tokenizer, scratch.path("shards"), end_id)
    return read_shards(docs.sparkSession, scratch.path("shards"))
