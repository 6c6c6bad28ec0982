"""Secret scans with corpus-wide ownership. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, join_hot

#: The patterns of the base kinds in their order, and what a match needs to count.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs below the least length fail anyway; these quantifiers drop them while matching, at the same places.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
#: A run of 20 or more characters with a digit, a capital and a small letter: unlike words, like a key.
OWNED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "owned")


def matches(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start,end,kind,h>>``; places in code points.

    The pieces between matches and the matches alternate through the text, so running lengths give places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    kind_of = "struct<start:int,end:int,kind:int,h:string>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind_of}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        value = x["m"] if value_group == 0 else F.regexp_extract(x["m"], pattern, value_group)
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.sha2(value, 256).alias("h")).cast(kind_of)
        out = F.concat(acc["out"], F.array(span))
        return F.struct(end.alias("at"), (F.when(F.length(value) >= least, out).otherwise(acc["out"]) if least else out).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, empty, step, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{kind_of}>"))


def find_secrets(docs: DataFrame, repo: str = "source", owner: str | None = None, most_owners: int = 1) -> DataFrame:
    """Spans of secrets in every whole text, and who holds the same ones.

    Returns a row for each row of ``docs``: ``doc_id``, ``spans`` (array of ``start, kind, end, h, n_repos,
    n_owners``; places in code points, end exclusive, in order of start, then kind) and counts. The base
    kinds are always reported. Candidates of the kind ``owned`` are any key-like runs; their hashes, like
    those of the base kinds' values, are counted over the whole corpus by distinct repositories and owners:
    runs that at most ``most_owners`` owners hold are reported, those copied more widely are examples. Runs
    inside a base span are that span. ``n_live`` and ``n_example`` part all reported spans the same way.
    Only hashes are shuffled, never a secret.

    ``repo`` and ``owner`` (by default the repository itself) are columns of ``docs``; a null is an owner of
    its own. A null text is empty and has no spans. Repeated rows and rows without a ``doc_id`` each give a
    row. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias
    doc = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(doc, marked(repo)("repo"), marked(owner or repo)("owner"), text.alias("text"))
    t = F.col("text")
    parts = rows.select("doc_id", "repo", "owner", matches(t, ASSIGN, 0, 2, 6).alias("assign"), matches(t, ACCESS_LONG, 1).alias("access"), matches(t, HEX_LONG, 2).alias("hex"), matches(t, OWNED, 3).alias("owned"))
    base = F.concat("assign", "access", "hex")
    apart = F.filter("owned", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = parts.select("doc_id", "repo", "owner", F.when(F.size("owned") > 0, F.concat(base, apart)).otherwise(base).alias("found")).withColumn("row", F.monotonically_increasing_id())
    scan = scratch.cut(spans, "scan")

    each = scan.filter(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("s")).select("row", "repo", "owner", "s", F.col("s.h").alias("h"))
    held = each.groupBy("h", "repo", "owner").agg(F.count("*").alias("n"))
    of_hash = scratch.cut(held.groupBy("h").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.sum("n").alias("n")), "held")
    known = join_hot(each.select("row", "s", "h"), of_hash, ["h"], "n")
    known = known.filter((F.col("s.kind") < 3) | (F.col("n_owners") <= most_owners))
    span = F.struct("s.start", "s.kind", "s.end", "h", "n_repos", "n_owners")
    lists = known.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    out = scan.select("row", "doc_id").join(lists, "row", "left").drop("row")
    none = F.array().cast(dict(lists.dtypes)["spans"])
    out = out.withColumn("spans", F.coalesce("spans", none))
    kinds = F.transform("spans", lambda s: s["kind"])
    of_kind = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    live = F.size(F.filter("spans", lambda s: s["n_owners"] <= most_owners)).cast("long")
    return out.select("doc_id", "spans", *of_kind, live.alias("n_live"), (F.size("spans") - live).alias("n_example"))


def span_list(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"] < 3) if base_only else spans
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
