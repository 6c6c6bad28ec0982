"""Vector best-fit packing of documents into sequences."""

from __future__ import annotations

import zlib
from array import array
from heapq import heapify, heappop, heappush
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm import tokens
from tessera.llm.common import parts, texts

#: Bins of one packing task: sequence ids are task << 40 | bin.
TASK_SHIFT = 40
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class VectorBestFit:
    """Bins with a token, a document and an attention-cost capacity.

    An item of n tokens asks for (n, 1, n * n). Among the bins that can take it under every capacity, the
    rule ``residual`` selects the one whose residual vector, each part as a share of its capacity and
    weighted, is shortest afterwards; ``dot`` the one whose residual has the largest weighted dot product
    with the item. Ties go to the oldest bin. Bins that can't take even the smallest item left are closed.

    Bins with the same residual vector are interchangeable but for their age, so they are kept together:
    an item's length is scored once against the distinct residuals, then each item takes a few heap steps.
    """

    def __init__(self, capacity=(1024, 1024, 1024 * 1024), weights=(1.0, 1e-3, 1e-3), rule: str = "residual") -> None:
        self.capacity, self.weights, self.rule = tuple(map(int, capacity)), tuple(weights), rule
        if rule not in ("residual", "dot"):
            raise ValueError(f"no such rule: {rule}")

    def cost(self, room: tuple, ask: tuple) -> float:
        """What the rule makes smallest."""
        total = 0.0
        for r, a, c, w in zip(room, ask, self.capacity, self.weights):
            total += w * ((r - a) / c) ** 2 if self.rule == "residual" else -w * (r / c) * (a / c)
        return total

    def pack(self, lengths: np.ndarray) -> np.ndarray:
        """The bin of each length; longest first, equal ones in the given order."""
        lengths = np.asarray(lengths, np.int64)
        out = np.empty(len(lengths), np.int64)
        if not len(lengths):
            return out
        least = int(lengths.min())
        if any(a > c for a, c in zip((int(lengths.max()), 1, int(lengths.max()) ** 2), self.capacity)):
            raise ValueError("an item is larger than an empty bin")
        order = np.argsort(-lengths, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0])
        bins: dict[tuple, list[int]] = {}
        made = 0
        for a, b in zip(first, np.r_[first[1:], len(order)]):
            n = int(lengths[order[a]])
            ask = (n, 1, n * n)
            fits = lambda room: room[0] >= n and room[1] >= 1 and room[2] >= n * n  # noqa: B023, E731
            best = [(self.cost(room, ask), names[0], room) for room, names in bins.items() if fits(room)]
            heapify(best)
            for i in order[a:b].tolist():
                while best:  # entries whose bin has been taken since are renewed
                    cost, name, room = best[0]
                    names = bins.get(room)
                    if names and names[0] == name:
                        break
                    heappop(best)
                    if names:
                        heappush(best, (cost, names[0], room))
                if best:
                    cost, name, room = heappop(best)
                    heappop(names)
                    if names:
                        heappush(best, (cost, names[0], room))
                    else:
                        del bins[room]
                else:
                    name, room, made = made, self.capacity, made + 1
                out[i] = name
                room = (room[0] - n, room[1] - 1, room[2] - n * n)
                if room[0] >= least and room[1] >= 1 and room[2] >= least * least:
                    names = bins.setdefault(room, [])
                    heappush(names, name)
                    if fits(room) and names[0] == name:
                        heappush(best, (self.cost(room, ask), name, room))
        return out


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ``limit`` pieces behind a first one that may be shorter."""
    first = n % limit or min(n, limit)
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 1024,
    end_id: int = 2,
    max_docs: int | None = None,
    max_attention: int | None = None,
    rule: str = "residual",
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``limit`` tokens.

    A document is its ids and ``end_id``; only longer ones are cut. Capacities per sequence: ``limit``
    tokens, ``max_docs`` pieces (by default as many as tokens), ``max_attention`` (the sum of squared piece
    lengths, by default that of one full piece). The defaults follow from the token capacity, for the
    fewest sequences; smaller ones bind. Where ``max_attention`` doesn't hold a full piece, documents are
    cut into the longest pieces that it does hold.

    Each task packs the pieces of its own split, so no row is shuffled and a task holds 41 bytes a piece
    of it; the bins left half empty at the end are a few per split of thousands of documents. A task run
    again reads the same split in the same order and gives the same sequences.

    A null or empty text is the end id alone; repeated rows are packed each; a null ``doc_id`` stays null;
    other columns are ignored; an empty table gives an empty result.
    """
    capacity = (limit, max_docs or limit, max_attention or limit * limit)
    longest = min(limit, isqrt(capacity[2]))

    def pack(batches):
        tok = tokens.load(tokenizer)
        doc, no_doc, number, start, length, crc = array("q"), bytearray(), array("i"), array("q"), array("q"), array("q")
        for batch in parts(batches):
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(tok.ids(text.as_py()), end_id).astype("<u4")
                for k, (at, n) in enumerate(cuts(len(ids), longest)):
                    doc.append(d or 0)
                    no_doc.append(d is None)
                    number.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
        if not doc:
            return
        long = np.frombuffer(length, np.int64)
        bins = VectorBestFit(capacity, weights, rule).pack(long)
        order = np.argsort(bins, kind="stable")
        bins = bins[order]
        ends = np.cumsum(long[order])
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        before = np.repeat((ends - long[order])[first], np.diff(np.r_[first, len(bins)]))
        columns = {
            "doc_id": pa.array(np.frombuffer(doc, np.int64)[order], mask=np.frombuffer(no_doc, bool)[order]),
            "piece": pa.array(np.frombuffer(number, np.int32)[order]),
            "start": pa.array(np.frombuffer(start, np.int64)[order]),
            "length": pa.array(long[order]),
            "ids_crc32": pa.array(np.frombuffer(crc, np.int64)[order]),
            "sequence_id": pa.array((np.int64(TaskContext.get().partitionId()) << TASK_SHIFT) + bins),
            "offset": pa.array(ends - long[order] - before),
        }
        yield from pa.table(columns).to_batches(max_chunksize=65536)

    return texts(docs).mapInArrow(pack, SCHEMA)
