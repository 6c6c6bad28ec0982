"""Substring dedup: repeated passages by MinHash banding over paragraphs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, join_hot, numbered, parts, versions
from tessera.llm.components import Forest, components

#: Words of a paragraph at least, and of a shingle.
LEAST_WORDS, SHINGLE = 25, 5
#: Permutations at most, and the probability that a pair of the least similarity shares a band.
PERMUTATIONS, RECALL = 64, 0.994
#: A passage window has this many words, and one of so many neighbouring ones is taken: 49 equal words in
#: two texts hold a common one wherever they stand.
WINDOW, WINNOW = 20, 30
#: A word that is one of so many before it only goes on with what was said.
ECHO = 3
#: Distinct paragraphs of a band's bucket that one task compares.
BUCKET = 512
#: Shingles of a paragraph up to which it is compared as a hash set, which takes eight times the memory.
AS_SET = 2000
#: Bytes of a text whose words are hashed together.
SPAN = 1 << 20

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
#: Odd bases of two independent word hashes.
BASES = (0x100000001B3, 0xD1342543DE82EF95)


def banding(least: float) -> tuple[int, int]:
    """(bands, rows): the longest rows with which a pair of similarity ``least`` shares a band with RECALL."""
    for rows in range(8, 0, -1):
        meet = least**rows
        bands = 1 if meet >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - meet))
        if bands * rows <= PERMUTATIONS:
            return bands, rows
    raise ValueError(f"no banding of {PERMUTATIONS} permutations reaches similarity {least}")


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as texts have needed them yet."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            on, back = pow(self.base, k, 1 << 64), pow(self.base, -k, 1 << 64)
            self.up = np.concatenate([self.up, self.up * np.uint64(on)])
            self.down = np.concatenate([self.down, self.down * np.uint64(back)])
        return self.up, self.down


_POWERS = [Powers(base) for base in BASES]


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """A hash of each word ``data[start:end]``: differences of a running polynomial sum, moved to a common place.

    Texts are taken in spans of about SPAN bytes that end between words, which bounds what the sums hold.
    ``kind`` is the base, one of two.
    """
    out, at = np.empty(len(start), np.uint64), 0
    raw = np.frombuffer(data, np.uint8)
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + SPAN, side="right")))
        stop = int(end[to - 1])
        if stop - base > 2 * SPAN:  # one word
            out[at], at = xxhash.xxh64_intdigest(data[base:stop], kind), to
            continue
        up, down = _POWERS[kind].upto(stop - base)
        total = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((raw[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=total[1:])
        out[at:to] = (total[end[at:to] - base] - total[start[at:to] - base]) * down[start[at:to] - base]
        at = to
    return mix(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P
    return h ^ (h >> np.uint64(29))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _P + h[j : j + n]
    return mix(out)


def echoes(h: np.ndarray) -> np.ndarray:
    """Running number of words that repeat one of the ECHO before them."""
    again = np.zeros(len(h), bool)
    for k in range(1, ECHO + 1):
        again[k:] |= h[k:] == h[:-k]
    out = np.zeros(len(h) + 1, np.int64)
    np.cumsum(again, out=out[1:])
    return out


def winnow(g: np.ndarray, w: int, empty: np.ndarray) -> np.ndarray:
    """Places of the smallest of every w neighbours, those that are ``empty`` left out."""
    if not len(g):
        return np.empty(0, np.int64)
    g = np.where(empty, np.uint64(0xFFFFFFFFFFFFFFFF), g)
    if len(g) <= w:
        at = np.array([int(g.argmin())])
    else:
        at = np.unique(np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) + np.arange(len(g) - w + 1))
    return at[~empty[at]]


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte places of word starts, word ends, and line breaks."""
    b = np.frombuffer(data, np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    word = np.zeros(len(b) + 2, bool)
    np.logical_not(blank, out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2], np.flatnonzero(b == 10)


def bands(shingles: np.ndarray, first: np.ndarray, last: np.ndarray, n_bands: int, n_rows: int) -> np.ndarray:
    """Band hashes of paragraphs whose shingles are ``shingles[first:last]``: one row each."""
    cut = np.empty(2 * len(first), np.int64)
    cut[::2], cut[1::2] = first, last
    if cut[-1] == len(shingles):
        cut = cut[:-1]
    low = np.empty((len(first), n_bands * n_rows), np.uint64)
    for p in range(n_bands * n_rows):
        low[:, p] = np.minimum.reduceat((shingles ^ _B[p]) * _A[p], cut)[::2]
    key = np.zeros((len(first), n_bands), np.uint64)
    for r in range(n_rows):
        key = mix(key * _P + low[:, r::n_rows])
    return key * np.uint64(PERMUTATIONS) + np.arange(n_bands, dtype=np.uint64)


class Words:
    """The words of a text: byte places, code point places, hashes."""

    def __init__(self, text: str) -> None:
        self.data = text.encode().lower()
        self.at, self.to, self.breaks = word_places(self.data)
        self.start, self.end = self.at, self.to
        if len(self.data) != len(text):  # bytes to code points
            point = np.cumsum((np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80)
            self.start, self.end = point[self.at] - 1, point[self.to - 1]

    def hashes(self, kind: int = 0) -> np.ndarray:
        return word_hashes(self.data, self.at, self.to, kind)


def pieces(text: str) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, check, start, end) of paragraphs, then of passage windows (no check); and of the paragraphs:
    the text's shingles, the first and after the last of each, and whether they say anything.

    Words said over and over are no passage: windows of which over half repeat one of the ECHO words before
    have no unit, and such paragraphs say nothing.
    """
    w = Words(text)
    nothing = np.empty(0, np.int64)
    if len(w.at) < WINDOW:
        return [], np.empty(0, np.uint64), nothing, nothing, np.empty(0, bool)
    h = w.hashes()
    line = np.searchsorted(w.breaks, w.at)
    first = np.concatenate([[0], np.flatnonzero(line[1:] != line[:-1]) + 1])
    last = np.append(first[1:], len(h))
    long_enough = last - first >= LEAST_WORDS
    first, last = first[long_enough], last[long_enough]
    again = echoes(h)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        said = b" ".join(w.data[int(w.at[a]) : int(w.to[b - 1])].split())
        same = xxhash.xxh64_intdigest(h[a:b].tobytes()), xxhash.xxh64_intdigest(said, 2)
        out.append((*same, int(w.start[a]), int(w.end[b - 1])))
    shingles = rolling(h, SHINGLE) if len(first) else np.empty(0, np.uint64)
    says = 2 * (again[last] - again[first]) <= last - first
    empty = 2 * (again[WINDOW:] - again[:-WINDOW]) > WINDOW
    for a in winnow(rolling(h, WINDOW), WINNOW, empty).tolist():
        same = xxhash.xxh64_intdigest(h[a : a + WINDOW].tobytes(), 1)
        out.append((same, None, int(w.start[a]), int(w.end[a + WINDOW - 1])))
    return out, shingles, first, last - SHINGLE + 1, says


def keys_of(found: list[tuple], n_bands: int, n_rows: int, every: bool = False) -> np.ndarray:
    """Band keys of the paragraphs of several texts' :func:`pieces`: one row each.

    Unless ``every`` is set, the bands of a paragraph that says nothing are those of nothing but itself.
    """
    size = np.cumsum([0] + [len(shingles) for _, shingles, *_ in found])
    first = np.concatenate([f + at for (_, _, f, _, _), at in zip(found, size)])
    last = np.concatenate([t + at for (_, _, _, t, _), at in zip(found, size)])
    if not len(first):
        return np.empty((0, n_bands), np.uint64)
    keys = bands(np.concatenate([shingles for _, shingles, *_ in found]), first, last, n_bands, n_rows)
    if every:
        return keys
    says = np.concatenate([x for *_, x in found])
    own = np.array([x[0] for out, _, f, *_ in found for x in out[: len(f)]], np.uint64)[:, None] * np.uint64(PERMUTATIONS)
    return np.where(says[:, None], keys, own + np.arange(n_bands, dtype=np.uint64))


def likes(shingles: np.ndarray, first: np.ndarray, last: np.ndarray, says: np.ndarray) -> list[int | None]:
    """For paragraphs that say nothing a hash of their set of shingles: many differ only in how often they say it."""
    sets = (None if told else np.unique(shingles[a:b]) for a, b, told in zip(first.tolist(), last.tolist(), says.tolist()))
    return [None if x is None else xxhash.xxh64_intdigest(x.tobytes(), 3) for x in sets]


def units(text: str, n_bands: int = 10, n_rows: int = 4) -> tuple[list[tuple], np.ndarray]:
    """The units of one text's :func:`pieces`, and :func:`keys_of` its paragraphs."""
    found = pieces(text)
    return found[0], keys_of([found], n_bands, n_rows)


def signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def signed_or_null(values: list[int | None]) -> pa.Array:
    return pa.array(np.array([x or 0 for x in values], np.uint64).view(np.int64), mask=np.array([x is None for x in values]))


UNIT = "doc_id long, version long, unit long, check long, like long, start int, end int, bands array<long>"


def all_units(docs: DataFrame, least: float, every: bool) -> DataFrame:
    """``doc_id, version, unit, check, like, start, end, bands`` of all documents; the last is null for windows.

    ``like`` is what :func:`likes` gives if ``every`` is set, else null.
    """
    n_bands, n_rows = banding(least)

    def run(batches):
        for batch in parts(batches):
            doc, version, found, like, flat, size, waiting, held = [], [], [], [], [], [], [], 0
            for d, v, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text"))):
                waiting.append(pieces(text))
                own, n = waiting[-1][0], len(waiting[-1][2])
                size += [n_bands] * n + [None] * (len(own) - n)
                doc += [d] * len(own)
                version += [v] * len(own)
                found += own
                like += [*(likes(*waiting[-1][1:]) if every else [None] * n), *[None] * (len(own) - n)]
                held += len(waiting[-1][1])
                if held > SPAN // 8:  # the temporaries of the bands stay in the processor's cache
                    flat.append(keys_of(waiting, n_bands, n_rows, every).view(np.int64).ravel())
                    waiting, held = [], 0
            if not doc:
                continue
            if waiting:
                flat.append(keys_of(waiting, n_bands, n_rows, every).view(np.int64).ravel())
            unit, check, start, end = zip(*found)
            offsets = pa.array(np.r_[0, np.cumsum([s or 0 for s in size])].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat)), mask=pa.array([s is None for s in size]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(version, pa.int64()), signed(unit), signed_or_null(check), signed_or_null(like), pa.array(start, pa.int32()), pa.array(end, pa.int32()), lists],
                ["doc_id", "version", "unit", "check", "like", "start", "end", "bands"],
            )

    return docs.mapInArrow(run, UNIT)


def windows_near(text: str, found: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(second hash, start, end, whether found) of all windows less than WINNOW words from those that start at ``found``."""
    w = Words(text)
    h = w.hashes(1)
    again = echoes(h)
    g = rolling(h, WINDOW)
    place = np.searchsorted(w.start, np.array(found))
    near = np.zeros(len(g) + 1, np.int64)
    np.add.at(near, np.clip(place - WINNOW + 1, 0, len(g)), 1)
    np.add.at(near, np.clip(place + WINNOW, 0, len(g)), -1)
    empty = 2 * (again[WINDOW:] - again[:-WINDOW]) > WINDOW
    taken = np.flatnonzero((np.cumsum(near[:-1]) > 0) & ~empty)
    return g[taken], w.start[taken], w.end[taken + WINDOW - 1], np.isin(taken, place)


def all_windows_near(docs: DataFrame) -> DataFrame:
    """``doc_id, version, unit, start, end, sure`` of the windows near those ``found`` in each text."""

    def run(batches):
        for batch in parts(batches):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "version", "text", "found"))
            for d, v, text, found in zip(*columns):
                unit, start, end, sure = windows_near(text, found)
                same = [pa.array(np.full(len(unit), x, np.int64)) for x in (d, v)]
                places = [pa.array(x.astype(np.int32)) for x in (start, end)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(unit.view(np.int64)), *places, pa.array(sure)],
                    ["doc_id", "version", "unit", "start", "end", "sure"],
                )

    return docs.mapInArrow(run, "doc_id long, version long, unit long, start int, end int, sure boolean")


#: Start, end and whether it was found, of a window, in one number.
PLACE = "shiftleft(CAST(start AS LONG), 32) | shiftleft(CAST(end AS LONG), 1) | CAST(sure AS LONG)"
#: What windows are sorted by: half a hash of the document, then the start. One number is sorted by its digits.
DEAL = "shiftleft(xxhash64(doc_id, version), 32) | shiftright(place, 32)"
ISLAND = "doc_id long, version long, island int, part int, gone boolean, start int, end int, sure boolean, n long, owners array<long>"


def islands_of(batches):
    """Rows of ISLAND for windows ``doc_id, version, place, owner, deal`` that come sorted by ``deal``.

    Windows of a text that touch are an island; those of them that another document keeps are parted where they
    don't touch. Both go by the start of their first window, and a window that the document keeps itself by the
    part before it. An island or part that goes on in the next batch has a row in each.
    """
    held, top = {}, None  # reach, island, reach of what others keep, part: of the texts whose hash the last row has
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in ("doc_id", "version", "place", "owner", "deal")]
        hashes = columns[-1] >> 32
        changes = lambda doc, version: np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])]
        if top != hashes[-1]:
            kept, top = held, hashes[-1]
            held = {}
        else:
            kept = held
        if (changes(*columns[:2])[1:] & (hashes[1:] == hashes[:-1])).any():  # two texts of one hash
            order = np.lexsort((columns[4], columns[1], columns[0]))
            columns, hashes = [c[order] for c in columns], hashes[order]
        doc, version, place, owner, _ = columns
        start, end, sure, gone = place >> 32, (place & 0xFFFFFFFF) >> 1, (place & 1).astype(bool), owner != doc
        change = changes(doc, version)
        first, row = np.flatnonzero(change), np.arange(len(doc))
        before = np.full((4, len(first)), -1, np.int64)  # as in held, -1 for none
        for (d, v), state in kept.items():
            before[:, (doc[first] == d) & (version[first] == v)] = np.array(state)[:, None]
        # windows have one number of words, so they end in the order in which they start
        reach = np.r_[-1, end[:-1]]
        reach[first] = before[0]
        apart = start > reach
        name = start.copy()
        name[first] = np.where(apart[first], start[first], before[1])
        island = name[np.maximum.accumulate(np.where(apart | change, row, 0))]
        at, text = np.flatnonzero(gone), np.cumsum(change) - 1
        goes = np.r_[-1, end[at][:-1]][: len(at)]
        head = np.flatnonzero(np.r_[True, text[at][1:] != text[at][:-1]][: len(at)])
        goes[head] = before[2][text[at[head]]]
        fresh = np.zeros(len(doc), bool)
        fresh[at] = start[at] > goes
        name = start.copy()
        name[first] = np.where(fresh[first], start[first], before[3])
        part = name[np.maximum.accumulate(np.where(fresh | change, row, 0))]

        for rows, is_gone in ((at, True), (np.flatnonzero(~gone), False)):
            if not len(rows):
                continue
            i, k, o, t = island[rows], part[rows], owner[rows], text[rows]
            new = np.r_[True, (i[1:] != i[:-1]) | (k[1:] != k[:-1]) | (t[1:] != t[:-1])]
            begin, group = np.flatnonzero(new), np.cumsum(new) - 1
            once = np.flatnonzero(new | np.r_[True, o[1:] != o[:-1]])
            once = once[np.lexsort((o[once], group[once]))]
            once = once[np.r_[True, (group[once][1:] != group[once][:-1]) | (o[once][1:] != o[once][:-1])]]
            owners = pa.ListArray.from_arrays(pa.array(np.searchsorted(group[once], np.arange(len(begin) + 1)).astype(np.int32)), pa.array(o[once]))
            size = np.diff(np.r_[begin, len(rows)])
            one, other = rows[begin], rows[begin + size - 1]
            places = [pa.array(x.astype(np.int32)) for x in (i[begin], k[begin], start[one], end[other])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[one]), pa.array(version[one]), *places[:2], pa.array(np.full(len(begin), is_gone)), *places[2:], pa.array(np.logical_or.reduceat(sure[rows], begin)), pa.array(size), owners],
                ["doc_id", "version", "island", "part", "gone", "start", "end", "sure", "n", "owners"],
            )
        last = np.r_[first[1:], len(doc)] - 1
        gone_reach = np.maximum(np.maximum.reduceat(np.where(gone, end, -1), first), before[2])
        for j in np.flatnonzero(hashes[last] == top).tolist():
            z = last[j]
            held[int(doc[z]), int(version[z])] = int(end[z]), int(island[z]), int(gone_reach[j]), int(part[z])


def shingle_set(text: str) -> np.ndarray:
    return np.unique(rolling(Words(text).hashes(), SHINGLE))


def verified_links(rows: DataFrame, least: float) -> DataFrame:
    """``a, b`` within the buckets of ``key, unit, shingles``: exact Jaccard of ``least`` or more, as a spanning forest.

    The rows of a bucket stream past sorted by key; a paragraph is compared with those of its bucket that
    it isn't joined to yet.
    """

    def run(batches):
        forest, key, groups = Forest(), None, []
        for batch in parts(batches):
            links = []
            for k, u, s in zip(batch.column("key").to_pylist(), batch.column("unit").to_pylist(), batch.column("shingles").to_pylist()):
                mine = np.frombuffer(s, np.uint64)
                mine = frozenset(mine.tolist()) if len(mine) <= AS_SET else mine
                if k != key:
                    key, groups = k, []
                joined = [[(u, mine)]]
                rest = []
                for part in groups:
                    if forest.root(part[0][0]) == forest.root(u):
                        joined.append(part)
                        continue
                    hit = next((v for v, other in part if reaches(mine, other, least)), None)
                    if hit is None:
                        rest.append(part)
                    else:
                        if forest.link(u, hit):
                            links.append((u, hit))
                        joined.append(part)
                groups = [*rest, [x for part in joined for x in part]]
            if len(forest.up) > 1_000_000:
                forest, groups = Forest(), [[x] for part in groups for x in part]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "unit").mapInArrow(run, "a long, b long")


def reaches(a, b, least: float) -> bool:
    """Whether the Jaccard similarity of two shingle sets (hash sets, or sorted arrays of large ones) is ``least``."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    if isinstance(a, frozenset) and isinstance(b, frozenset):
        common = len(a & b)
    else:
        a, b = (np.sort(np.fromiter(x, np.uint64, len(x))) if isinstance(x, frozenset) else x for x in (a, b))
        common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common)


KEY = ["doc_id", "version"]


def repeated_passages(docs: DataFrame, least: float = 0.8, every: bool = False) -> DataFrame:
    """Passages that stand in several documents: a row for each document that has any.

    Returns ``doc_id, n_repeated`` (paragraphs and windows found again in other documents), ``n_removed``
    (those that another document keeps), ``removed`` (array of ``start, end`` in code points, merged),
    ``n_removed_chars`` and ``documents`` (the smallest ``doc_id`` of each cluster, ascending).

    Paragraphs are lines of at least LEAST_WORDS words. They are banded by MinHash over their SHINGLE-word
    shingles, by :func:`banding` for ``least``; those that share a band are compared by exact Jaccard and
    linked at ``least`` or more. As a passage may repeat inside longer paragraphs, windows of WINDOW words are
    taken at winnowed places of the whole text; equal ones name the documents in which all windows near them
    are then compared, by a second, independent hash. What equal windows cover is a passage, to its ends, if
    both hashes found one of them: no WINNOW windows in a row of a repeated passage go unfound, so one of 49
    words or more is found wherever it begins. Words are divided by white space, ASCII letters lower-cased.
    Windows in which a few words are said over and over are no passage. Such paragraphs are compared for
    equality alone, or with ``every`` like any other; those of one set of shingles then meet others as one.
    Links are closed to components; a component of two or more documents stays in the smallest of them and
    is removed from the others.

    Equal paragraphs (by two independent hashes) are one vertex, however many. Buckets of more than BUCKET
    different paragraphs are parted into blocks, every two of which meet, so no comparison is lost and no
    task holds a whole one.

    A null or empty text, or one of fewer than WINDOW words, has no passage. Rows that repeat a ``doc_id``
    with the same text are one document; another text of the same ``doc_id`` has a row of its own, and what
    only texts of one ``doc_id`` share is not repeated. Rows without a ``doc_id`` are left out. Other columns
    are ignored; an empty table gives an empty result.
    """
    return _repeated(docs, least, every).drop("version")


def _repeated(docs: DataFrame, least: float, every: bool) -> DataFrame:
    """:func:`repeated_passages` with the ``version`` of the text."""
    scratch = Scratch(docs.sparkSession, "passages")
    id_of, text_of = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    rows = versions(docs.select(id_of, text_of).filter("doc_id IS NOT NULL"))
    found = scratch.cut(all_units(rows, least, every), "units")
    classes, banded = _classes(found, scratch)
    linked = components(_paragraph_links(rows, banded, classes, least, scratch), scratch)

    joined = classes.select("unit", "first", "last", "n").join(linked.withColumnRenamed("id", "unit"), "unit", "left")
    of_part = joined.filter("component_id IS NOT NULL")
    ends = of_part.groupBy("component_id").agg(F.min("first").alias("owner"), F.max("last").alias("end_doc"))
    of_part = of_part.join(ends, "component_id").select("unit", "n", "owner", "end_doc")
    alone = joined.filter("component_id IS NULL")
    alone = alone.select("unit", "n", F.col("first").alias("owner"), F.col("last").alias("end_doc"))
    repeats = of_part.unionByName(alone).filter("owner < end_doc").select("unit", "n", "owner")
    repeats = scratch.cut(repeats, "repeats")
    hits = found.filter("bands IS NOT NULL").select("unit", *KEY, "start", "end")
    hits = join_hot(hits, repeats, ["unit"], "n").withColumn("gone", F.col("doc_id") != F.col("owner"))
    hits = hits.select(*KEY, "start", "end", "gone", F.lit(1).cast("long").alias("n"), F.array("owner").alias("owners"))
    hits = scratch.cut(hits, "hits")

    windows = found.filter("bands IS NULL").select("unit", *KEY, "start")
    ends = F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")
    several = windows.groupBy("unit").agg(*ends).filter("first < last").select("unit", "n")
    several = join_hot(windows, scratch.cut(several, "several"), ["unit"], "n").select(*KEY, "start")
    several = scratch.cut(several, "starts")
    scratch.drop("units")
    hits = scratch.cut(hits.unionByName(_windows_again(rows, several, scratch)), "all-hits")

    order = Window.partitionBy(*KEY).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    step = F.sum(F.when(F.col("start") > F.col("reach"), 1).otherwise(0)).over(order)
    gone = hits.filter("gone").withColumn("reach", reach).withColumn("island", step)
    spans = gone.groupBy(*KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    removed = F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed")
    spans = spans.groupBy(*KEY).agg(removed, F.sum(F.col("end") - F.col("start")).alias("n_removed_chars"))
    counts = hits.groupBy(*KEY).agg(
        F.sum("n").alias("n_repeated"),
        F.sum(F.when(F.col("gone"), F.col("n")).otherwise(0)).alias("n_removed"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("documents"),
    )
    none = F.array().cast(dict(spans.dtypes)["removed"])
    return counts.join(spans, KEY, "left").select(
        *KEY,
        "n_repeated",
        "n_removed",
        F.coalesce("removed", none).alias("removed"),
        F.coalesce("n_removed_chars", F.lit(0)).alias("n_removed_chars"),
        "documents",
    )


def _classes(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``unit, like, first, last, n, at`` of equal paragraphs: the documents at both ends, and a place of one.

    Then ``unit, like, bands``: equal paragraphs have equal bands.

    Paragraphs of one hash that differ in the other are none of them equal; such a unit is left out.
    """
    classes = found.filter("bands IS NOT NULL").groupBy("unit").agg(
        F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last"),
        F.count("*").alias("n"),
        F.min(F.struct(*KEY, "start", "end")).alias("at"),
        F.min("like").alias("like"),
        F.min("check").alias("least"),
        F.max("check").alias("most"),
        F.first("bands").alias("bands"),
    )
    wide = scratch.cut(classes.filter("least = most").drop("least", "most"), "banded")
    return scratch.cut(wide.drop("bands"), "classes"), wide.select("unit", "like", "bands")


def _paragraph_links(rows: DataFrame, banded: DataFrame, classes: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """``a, b``: paragraphs that share a band and are similar enough, as a spanning forest.

    Paragraphs with a ``like`` are linked to it, and it stands for them in the buckets.
    """
    stands = F.coalesce("like", "unit").alias("unit")
    alone = banded.filter("like IS NULL").select("unit", F.explode("bands").alias("key"))
    filed = alone.unionByName(banded.filter("like IS NOT NULL").select(F.col("like").alias("unit"), F.explode("bands").alias("key")).distinct())
    size = scratch.cut(filed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    meets = scratch.cut(join_hot(filed, size, ["key"], "size"), "meets")
    wanted = meets.select("unit").distinct().join(classes.select(stands, "at"), "unit")
    place = F.struct("unit", "at.start", "at.end")
    of_doc = wanted.groupBy(*[F.col(f"at.{c}").alias(c) for c in KEY]).agg(F.collect_list(place).alias("wanted"))

    def shingles(batches):
        for batch in parts(batches):
            unit, sets = [], []
            for text, ask in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                for w in ask:
                    unit.append(w["unit"])
                    sets.append(shingle_set(text[w["start"] : w["end"]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(sets, pa.binary())], ["unit", "shingles"])

    asked = rows.join(of_doc, KEY).select("text", "wanted")
    sets = asked.mapInArrow(shingles, "unit long, shingles binary").dropDuplicates(["unit"])
    sets = scratch.cut(sets, "sets")
    blocks = F.when(F.col("size") > BUCKET, F.ceil(2 * F.col("size") / BUCKET).cast("long")).otherwise(1)
    parted = meets.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    group = F.when(F.col("blocks") == 1, F.col("key")).otherwise(pair)
    links = verified_links(parted.select(group.alias("key"), "unit").join(sets, "unit"), least)
    alike = classes.filter("like IS NOT NULL").select(F.col("unit").alias("a"), F.col("like").alias("b"))
    links = scratch.cut(links.unionByName(alike), "links")
    for name in ("banded", "buckets", "meets", "sets"):
        scratch.drop(name)
    return links


def _windows_again(rows: DataFrame, hits: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, version, start, end, gone, n, owners`` of the passages made of windows near the winnowed ``hits``.

    Windows that touch are one passage, if it holds one that both hashes found; ``gone`` parts it into what
    other documents keep and what the document itself does. The windows themselves are rows no longer.
    """
    seen = hits.groupBy(*KEY).agg(F.collect_set("start").alias("found"))
    near = scratch.cut(all_windows_near(rows.join(seen, KEY)), "near")
    ends = F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")
    again = near.groupBy("unit").agg(*ends).filter("owner < last").select("unit", "n", "owner")
    again = join_hot(near.select(*KEY, "unit", F.expr(PLACE).alias("place")), scratch.cut(again, "again"), ["unit"], "n").select(*KEY, "place", "owner")
    sorted_windows = again.repartition(*KEY).withColumn("deal", F.expr(DEAL)).sortWithinPartitions("deal")
    islands = scratch.cut(sorted_windows.mapInArrow(islands_of, ISLAND), "islands")
    scratch.drop("near")
    held = F.max("sure").over(Window.partitionBy(*KEY, "island"))
    return islands.withColumn("held", held).filter("held").select(*KEY, "start", "end", "gone", "n", "owners")


def cut_passages(docs: DataFrame, least: float = 0.8, every: bool = False) -> DataFrame:
    """``docs`` with the removed spans of :func:`repeated_passages` cut out of ``text``; columns as they were.

    Rows without a ``doc_id`` keep their texts, as do null texts.
    """
    gone = _repeated(docs, least, every).filter("n_removed > 0").select(*KEY, "removed")
    inner, names = numbered(docs)
    body = names[docs.columns.index("text")]
    wide = versions(inner, "__doc", body).join(gone.toDF("__doc", "version", "__cut"), ["__doc", "version"], "left")
    n = F.size("__cut")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("__cut", i - 1)["end"])
    stop = lambda i: F.when(i == n, F.length(body)).otherwise(F.get("__cut", i)["start"])
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(body, begin(i) + 1, stop(i) - begin(i)))
    text = F.when(F.col("__cut").isNull(), F.col(body)).otherwise(F.array_join(kept, ""))
    return wide.select(*[(text if c == "text" else F.col(k)).alias(c) for k, c in zip(names, docs.columns)])
