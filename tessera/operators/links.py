"""Edges between units: projected references, reading order, hierarchy, mentions across documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

def in_sequence() -> Window:
    return Window.partitionBy("doc_id").orderBy("seq")



def unit_of_element(units: DataFrame) -> DataFrame:
    """``doc_id, id, unit``: the first unit that an element is in."""
    members = units.select("doc_id", "seq", F.col("id").alias("unit"), F.explode("member_ids").alias("id"))
    return members.groupBy("doc_id", "id").agg(F.min_by("unit", "seq").alias("unit"))


def reference_links(units: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, src, dst, type, confidence, evidence``: element references whose ends lie in different units, once per pair."""
    of = unit_of_element(units)
    r = edges.filter("type = 'references'").join(of.toDF("doc_id", "src", "su"), ["doc_id", "src"]).join(of.toDF("doc_id", "dst", "du"), ["doc_id", "dst"]).filter("su <> du")
    return r.groupBy("doc_id", "su", "du").agg(F.min(F.struct("src", "dst", "confidence", "evidence")).alias("x")).select("doc_id", F.col("su").alias("src"), F.col("du").alias("dst"), F.lit("references").alias("type"), "x.confidence", "x.evidence")


def order_links(units: DataFrame) -> DataFrame:
    u = units.select("doc_id", "seq", F.col("id").alias("src"), F.lead("id").over(in_sequence()).alias("dst")).filter("dst IS NOT NULL")
    ahead = u.select("doc_id", "src", "dst", F.lit("next").alias("type"), F.lit(1.0).alias("confidence"), F.lit("reading order").alias("evidence"))
    back = u.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("previous").alias("type"), F.lit(1.0).alias("confidence"), F.lit("reading order").alias("evidence"))
    return ahead.unionByName(back)


def hierarchy_links(units: DataFrame) -> DataFrame:
    """Units of one heading path: the first is the parent of the others. ``doc_id, parent, child``."""
    path = F.array_join("heading_path", " > ")
    w = Window.partitionBy("doc_id", "path").orderBy("seq")
    u = units.filter(F.coalesce(F.size("heading_path"), F.lit(0)) > 0).select("doc_id", "seq", F.col("id").alias("child"), path.alias("path")).withColumn("parent", F.first("child").over(w))
    return u.filter("parent <> child").select("doc_id", "parent", "child")


def schema_links(units: DataFrame) -> DataFrame:
    """Row groups to the schema card of their table and back."""
    cards = units.filter("element_kind = 'schema_card'").select("doc_id", F.get("member_ids", F.lit(0)).alias("table"), F.col("id").alias("card"))
    groups = units.filter("element_kind = 'row_group'").select("doc_id", F.get("member_ids", F.lit(0)).alias("table"), F.col("id").alias("grp"), F.concat(F.lit("describes rows "), F.element_at("metadata", F.lit("first_row")), F.lit("–"), F.element_at("metadata", F.lit("last_row"))).alias("rows"))
    both = groups.join(cards, ["doc_id", "table"])
    up = both.select("doc_id", F.col("grp").alias("src"), F.col("card").alias("dst"), F.lit("has_schema").alias("type"), F.lit(1.0).alias("confidence"), F.lit("column types and ranges for these rows").alias("evidence"))
    return up.unionByName(both.select("doc_id", F.col("card").alias("src"), F.col("grp").alias("dst"), F.lit("schema_of").alias("type"), F.lit(1.0).alias("confidence"), F.col("rows").alias("evidence")))


def attach(units: DataFrame, links: DataFrame, parents: DataFrame) -> DataFrame:
    """``units`` with their relationships, parent and children."""
    both = links.select("doc_id", "src", F.struct("type", F.col("dst").alias("target_id"), "confidence", "evidence").alias("r"))
    family = parents.select("doc_id", F.col("parent").alias("src"), F.struct(F.lit("parent_of").alias("type"), F.col("child").alias("target_id"), F.lit(1.0).alias("confidence"), F.lit("section hierarchy").alias("evidence")).alias("r"))
    family = family.unionByName(parents.select("doc_id", F.col("child").alias("src"), F.struct(F.lit("child_of").alias("type"), F.col("parent").alias("target_id"), F.lit(1.0).alias("confidence"), F.lit("section hierarchy").alias("evidence")).alias("r")))
    lists = both.unionByName(family).groupBy("doc_id", F.col("src").alias("id")).agg(F.sort_array(F.collect_set("r")).alias("__r"))
    up = parents.select("doc_id", F.col("child").alias("id"), F.col("parent").alias("__p"))
    down = parents.groupBy("doc_id", F.col("parent").alias("id")).agg(F.sort_array(F.collect_set("child")).alias("__c"))
    out = units.join(lists, ["doc_id", "id"], "left").join(up, ["doc_id", "id"], "left").join(down, ["doc_id", "id"], "left")
    return out.withColumns({"relationships": F.coalesce("__r", "relationships"), "parent_id": F.coalesce("__p", "parent_id"), "child_ids": F.coalesce("__c", "child_ids")}).drop("__r", "__p", "__c")


#: Characters that every name has at least; texts are looked at where the first of some name stand.
HEAD = 4
#: Bits of a filter of hashes, as a power of two.
FILTER_BITS = 24
#: Characters of texts that are hashed together.
SPAN = 1 << 18
_BASE = 0x100000001B3


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    both = (np.full(n, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    up, down = (np.multiply.accumulate(np.r_[np.uint64(1), x[1:]]) for x in both)
    return up, down


class _Hashes:
    """Hashes of any run of characters of a text, by differences of one running polynomial sum."""

    def __init__(self, text: str, powers: tuple[np.ndarray, np.ndarray]) -> None:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.n, self.down = len(points), powers[1]
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[0][: self.n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.total[end] - self.total[start]) * self.down[start]
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def _filters(keys: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Filters of the first characters of ``key`` and of whole ones, and the lengths. One job; the filters' size is the same for any number of rows."""

    def hashed(batches):
        for batch in batches:
            key = batch.column("key").to_pylist()
            if key:
                n = np.array([len(k) for k in key])
                end = np.cumsum(n)
                hashes = _Hashes("".join(key), _powers(int(end[-1]) + 1))
                found = hashes.of(end - n, end - n + HEAD).astype(np.int64), hashes.of(end - n, end).astype(np.int64), n
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["heads", "whole", "lengths"])

    names = ("heads", "whole", "lengths")
    sums = keys.select("key").distinct().mapInArrow(hashed, "heads long, whole long, lengths long")
    each = sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("of"), F.shiftright(c, 15).alias("k"), F.col(c).bitwiseAND(F.lit(32767)).alias("bit")) for c in names])))
    rows = each.groupBy("of", "k").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = {c: np.zeros((1 << FILTER_BITS - 15, 4096), np.uint8) for c in names[:2]}
    lengths = []
    for r in rows:
        bits = np.frombuffer(r["bits"], np.uint8)
        if r["of"] in out:
            out[r["of"]][r["k"]] = bits
        else:
            lengths += ((r["k"] << 15) + np.flatnonzero(np.unpackbits(bits, bitorder="little"))).tolist()
    return out["heads"].ravel(), out["whole"].ravel(), sorted(lengths)


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _runs_of_names(texts: list[str], heads: np.ndarray, whole: np.ndarray, lengths: list[int], powers) -> set[tuple[int, str]]:
    """(place in ``texts``, run) of what may be a name: its first characters and all of it pass the filters."""
    text = "".join(texts)
    found, ends = set(), np.cumsum([len(t) for t in texts])
    hashes = _Hashes(text, powers)
    at = np.arange(max(hashes.n - HEAD + 1, 0))
    at = at[_holds(heads, hashes.of(at, at + HEAD))]
    owner = np.searchsorted(ends, at, side="right")
    for n in lengths if len(at) else ():
        inside = at + n <= ends[owner]
        start, own = at[inside], owner[inside]
        hit = _holds(whole, hashes.of(start, start + n))
        found.update((k, text[a : a + n]) for k, a in zip(own[hit].tolist(), start[hit].tolist()))
    return found


def _named(said: DataFrame, keys: DataFrame) -> DataFrame:
    """``src_doc, src, key``: the runs of ``content`` that may be a ``key``; none that is one is missing.

    Two filters of fixed size, of the keys' first characters and of whole keys, say which runs of the keys'
    lengths leave a text; what passes by chance meets no key in the join that follows.
    """

    heads, whole, lengths = _filters(keys)
    most, span = max(lengths, default=1), SPAN

    def run(batches):
        powers = _powers(2 * span + most)
        for batch in batches:
            rows, texts, held, found = [], [], 0, set()
            for k, text in enumerate(batch.column("content").to_pylist()):
                for a in range(0, len(text), span):  # a long text in pieces that overlap by a name
                    rows.append(k)
                    texts.append(text[a : a + span + most - 1])
                    held += len(texts[-1])
                    if held >= span:
                        found.update((rows[j], key) for j, key in _runs_of_names(texts, heads, whole, lengths, powers))
                        rows, texts, held = [], [], 0
            found.update((rows[j], key) for j, key in _runs_of_names(texts, heads, whole, lengths, powers))
            if found:
                place = pa.array([k for k, _ in found])
                yield pa.RecordBatch.from_arrays([batch.column("src_doc").take(place), batch.column("src").take(place), pa.array([key for _, key in found], pa.string())], ["src_doc", "src", "key"])

    return said.filter("content IS NOT NULL").mapInArrow(run, StructType([*said.select("src_doc", "src").schema, StructField("key", StringType())]))


def mentions(units: DataFrame, files: DataFrame) -> DataFrame:
    """Units that name another document's file: ``src_doc, src, dst_doc, dst``.

    ``files`` has ``doc_id, name``. A name counts, in either case and also within longer words, as whole or
    without its extension, if what is left has more than three characters. Texts are read once; what leaves
    them are runs of characters that may be names, which meet the names by an equal key. Null names and
    contents name nothing.
    """
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    lowered = files.select("doc_id", F.lower("name").alias("name")).filter(F.length(stem) >= HEAD)
    keys = lowered.select(F.col("doc_id").alias("dst_doc"), F.explode(F.array_distinct(F.array("name", stem))).alias("key")).distinct()
    said = units.select(F.col("doc_id").alias("src_doc"), F.col("id").alias("src"), F.lower("content").alias("content"))
    anchors = units.groupBy(F.col("doc_id").alias("dst_doc")).agg(F.max_by("id", F.when(F.col("unit_type").isin("section", "schema_card"), F.col("seq"))).alias("last"), F.min_by("id", "seq").alias("first"))
    ends = keys.join(anchors, "dst_doc").select("key", "dst_doc", F.coalesce("last", "first").alias("dst"))
    return _named(said, keys).join(ends, "key").filter("src_doc <> dst_doc").select("src_doc", "src", "dst_doc", "dst").distinct()


def containments(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """``doc_id, item_id`` where a document's text holds a probe's text, letter by letter.

    Probes are found by their longest inner word and compared whole afterwards; those that have none, being of
    one word or two, are held against every document.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+", -1), lambda w: w != ""))
    # the first and last words of a probe may be parts of words in a text; those within are whole
    inner = F.filter(F.split(F.col("text"), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    longest = F.get(F.sort_array(F.transform(F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))
    p = probes.select("item_id", F.col("text").alias("probe"), longest["w"].alias("word"))
    d = docs.select("doc_id", "text", F.explode_outer(words(F.col("text"))).alias("word"))
    keyed = d.join(p.filter("word IS NOT NULL"), "word").filter(F.col("text").contains(F.col("probe"))).select("doc_id", "item_id")
    short = p.filter("word IS NULL AND probe <> ''")
    rest = docs.select("doc_id", "text").join(short, F.col("text").contains(F.col("probe"))).select("doc_id", "item_id")
    return keyed.distinct().unionByName(rest.distinct()) if short.take(1) else keyed.distinct()
