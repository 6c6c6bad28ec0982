"""Datasets: column profiles, schema cards, row groups."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import as_number, count_tokens, format_number, header_markdown, row_markdown

TARGET_TOKENS, MAX_TOKENS = 900, 1200
# What counts as nothing, as true or false, and as a number, a date or a share.
NULLISH = ("", "-", "n/a", "na", "null", "none", "nan")
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "0", "1")
PERCENT = r"^-?\d+(\.\d+)?\s*%$"
DATE = r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-Q[1-4]|\d{4}/\d{1,2})([ T]\d{1,2}:\d{2}(:\d{2})?)?$"
INTEGER = r"^-?\d{1,3}(,\d{3})*$|^-?\d+$"
DECIMAL = r"^-?\d*\.\d+$|^-?\d{1,3}(,\d{3})*\.\d+$"


def as_cells(df: DataFrame, order: Column | None = None) -> DataFrame:
    """A wide table as ``pos, column, position, value``: every cell as text, nulls empty."""
    texts = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for i, c in enumerate(df.columns)]
    rows = df.select((order if order is not None else F.monotonically_increasing_id()).alias("pos"), F.array(*texts).alias("cells"))
    return rows.select("pos", F.inline("cells"))


def grid_cells(tables: DataFrame) -> DataFrame:
    """The cells of ``grid`` columns: ``doc_id, id, pos, column, position, value``; cells that a row lacks are empty."""
    header = F.coalesce("header_row", F.get("grid", F.lit(0)))
    wide = F.array_max(F.transform("grid", lambda r: F.size(r)))
    body = F.when(F.get("grid", F.lit(0)) == header, F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0)))).otherwise(F.col("grid"))
    rows = tables.filter("size(grid) > 0").select("doc_id", "id", header.alias("header"), F.greatest(wide, F.size(header)).alias("width"), F.posexplode(body).alias("pos", "row"))
    cells = rows.select("doc_id", "id", "header", "row", F.col("pos").cast("bigint").alias("pos"), F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("position"))
    name = F.coalesce(F.get("header", "position"), F.concat(F.lit("column_"), (F.col("position") + 1).cast("string")))
    return cells.select("doc_id", "id", "pos", name.alias("column"), "position", F.coalesce(F.get("row", "position"), F.lit("")).alias("value"))


def profile_columns(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A profile of every column of ``cells``, in one pass that combines before it shuffles.

    Values are first counted per column: what is shuffled is distinct values, not rows. Returns ``by``,
    ``position, column, dtype, non_null, nulls, n_distinct, minimum, maximum, mean, examples``.
    """
    key = [*by, "position", "column"]
    bare = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    value = F.when(F.lower(bare).isin(*NULLISH), None).otherwise(bare)
    present = cells.select(*key, "pos", value.alias("v"))
    each = present.groupBy(*key, "v").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    v, n = F.col("v"), F.col("n")
    kind = F.when(v.rlike(PERCENT), "p").when(v.rlike(DATE), "d").when(v.rlike(INTEGER), "i").when(v.rlike(DECIMAL), "f")
    number = as_number(v)
    typed = each.withColumns({"kind": kind, "number": number, "low": F.lower(v)})
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0))
    some = v.isNotNull()
    stats = typed.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(some, n)), F.lit(0)).alias("non_null"), F.coalesce(F.sum(F.when(~some, n)), F.lit(0)).alias("nulls"), F.count("v").alias("n_distinct"),
        of("p").alias("pct"), of("d").alias("dates"), of("i").alias("ints"), of("f").alias("decs"),
        (F.sum(F.length(v) * n) / F.sum(F.when(some, n))).alias("avg_len"), F.bool_and(F.col("low").isin(*BOOLEANS)).alias("is_bool"),
        F.min("number").alias("lo"), F.max("number").alias("hi"), (F.sum(F.col("number") * n) / F.sum(F.when(F.col("number").isNotNull(), n))).alias("avg"),
    )
    total, distinct = F.col("non_null"), F.col("n_distinct")
    dtype = (
        F.when(total == 0, "empty").when(F.col("pct") >= 0.9 * total, "percentage").when(F.col("dates") >= 0.9 * total, "date")
        .when(F.col("ints") + F.col("decs") >= 0.9 * total, F.when(F.col("decs") > 0, "decimal").otherwise("integer"))
        .when(F.col("is_bool") & (distinct <= 2), "boolean").when((distinct <= F.greatest(F.lit(12.0), total * 0.1)) & (F.col("avg_len") <= 60), "categorical")
        .when((distinct == total) & (total > 1), "identifier").otherwise("text")
    )
    stats = stats.withColumn("dtype", dtype)
    numeric = F.col("dtype").isin("integer", "decimal", "percentage")
    # examples: the first eight distinct values in row order; of columns that aren't sets, the first two cells
    firsts = _first(typed.filter(some).select(*key, F.col("first").alias("pos"), "v"), key, 8, "firsts")
    cells_first = _first(present.filter(some), key, 2, "two")
    both = stats.join(firsts, key, "left").join(cells_first, key, "left")
    sets = F.col("dtype").isin("categorical", "boolean")
    none = F.array().cast("array<string>")
    examples = F.when(F.col("dtype") == "empty", none).when(sets, F.col("firsts")).otherwise(F.col("two"))
    return both.select(*key, "dtype", "non_null", "nulls", "n_distinct", F.when(numeric, F.col("lo")).alias("minimum"), F.when(numeric, F.col("hi")).alias("maximum"), F.when(numeric, F.col("avg")).alias("mean"), F.coalesce(examples, none).alias("examples"))


def _first(values: DataFrame, key: list[str], k: int, name: str) -> DataFrame:
    """The k values met first in each column. The rank is pruned in every task before rows are shuffled."""
    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).filter(F.col("r") <= k)
    return ranked.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias(name))


def describe_column() -> Column:
    """A column profile in words."""
    head = F.concat("column", F.lit(" ("), "dtype", F.when(F.col("nulls") > 0, F.concat(F.lit(", "), F.col("nulls").cast("string"), F.lit(" empty"))).otherwise(""), F.lit(")"))
    dp = F.col("dtype").isin("decimal", "percentage")
    spread = F.concat(F.lit(": "), format_number(F.col("minimum"), dp), F.lit(" … "), format_number(F.col("maximum"), dp), F.lit(", mean "), format_number(F.col("mean"), dp))
    shown = F.slice("examples", 1, 6)
    more = F.when(F.col("n_distinct") > 6, F.concat(F.lit(" (+"), (F.col("n_distinct") - F.size(shown)).cast("string"), F.lit(" more)"))).otherwise("")
    quoted = lambda n: F.concat(F.lit("e.g. '"), F.substring(F.get("examples", F.lit(0)), 1, n), F.lit("'"))
    rest = (
        F.when(F.col("minimum").isNotNull(), spread)
        .when(F.col("dtype").isin("categorical", "boolean") & (F.size("examples") > 0), F.concat(F.lit(": "), F.array_join(shown, ", "), more))
        .when(F.col("dtype") == "identifier", F.concat(F.lit(": "), F.format_number("n_distinct", 0), F.lit(" unique values"), F.when(F.size("examples") > 0, F.concat(F.lit(", "), quoted(40))).otherwise("")))
        .when(F.size("examples") > 0, F.concat(F.lit(": "), quoted(60)))
        .otherwise("")
    )
    return F.concat(head, rest)


def schema_cards(profiles: DataFrame, shapes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A text for each dataset: ``by, content``. ``shapes`` has ``by``, ``source_name, sheet, row_count, column_count``."""
    lines = profiles.select(*by, "position", F.concat(F.lit("  - "), describe_column()).alias("line")).groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    where = F.concat("source_name", F.when(F.col("sheet").isNotNull(), F.concat(F.lit(" · sheet “"), "sheet", F.lit("”"))).otherwise(""))
    head = F.concat(F.lit("Dataset: "), where, F.lit("\n"), F.format_number("row_count", 0), F.lit(" rows × "), F.col("column_count").cast("string"), F.lit(" columns\n\nColumns:\n"))
    return shapes.join(lines, list(by)).select(*by, F.concat(head, "lines").alias("content"))


def greedy_groups(rows: DataFrame, key: list[str], cost: str, budget: str, target: int) -> DataFrame:
    """``rows`` with ``grp``: within a key, in order of ``pos``, a new group begins where the next cost would pass ``target``.

    Each group starts at ``budget``. The rows of a key stream past in order, so a task holds none of them
    and a key may be of any length.
    """
    names, schema = rows.columns, rows.withColumn("grp", F.lit(0)).schema

    def walk(batches):
        last, group, used, filled = object(), 0, 0, False
        for batch in batches:
            out = []
            cols = [batch.column(names.index(k)).to_pylist() for k in key]
            for *at, c, b in zip(*cols, batch.column(names.index(cost)).to_pylist(), batch.column(names.index(budget)).to_pylist()):
                if at != last:
                    last, group, used, filled = at, 0, b, False
                if filled and used + c > target:
                    group, used = group + 1, b
                used, filled = used + c, True
                out.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*names, "grp"])

    return rows.repartition(*key).sortWithinPartitions(*key, "pos").mapInArrow(walk, schema)


def row_groups(tables: DataFrame, target: int = TARGET_TOKENS, counter=count_tokens) -> DataFrame:
    """Body rows of grids packed to a budget: ``doc_id, id, grp, first_row, last_row, n_rows, content, token_count``.

    ``first_row`` counts from 1 with the header as row 1. The header is repeated in every group.
    """
    header = F.coalesce("header_row", F.get("grid", F.lit(0)))
    t = tables.filter("size(grid) > 0").select("doc_id", "id", header.alias("header"), "grid")
    body = F.when(F.get("grid", F.lit(0)) == F.col("header"), F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0)))).otherwise(F.col("grid"))
    head_cost = F.when(F.size("header") > 0, counter(row_markdown(F.col("header")))).otherwise(0)
    rows = t.select("doc_id", "id", "header", head_cost.alias("budget"), F.posexplode(body).alias("pos", "row"))
    rows = rows.select("doc_id", "id", "pos", row_markdown(F.col("row")).alias("line"), "budget").withColumn("cost", counter(F.col("line")))
    packed = greedy_groups(rows.select("doc_id", "id", "pos", "line", "budget", "cost"), ["doc_id", "id"], "cost", "budget", target)
    groups = packed.groupBy("doc_id", "id", "grp").agg(F.min("pos").alias("start"), F.count("*").alias("n_rows"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    out = groups.join(t.select("doc_id", "id", header_markdown(F.col("header")).alias("head"), (F.size("header") > 0).alias("headed")), ["doc_id", "id"])
    content = F.when(F.col("headed"), F.concat("head", F.lit("\n"), "lines")).otherwise(F.col("lines"))
    return out.select("doc_id", "id", "grp", (F.col("start") + 2).alias("first_row"), (F.col("start") + 1 + F.col("n_rows")).alias("last_row"), "n_rows", content.alias("content")).withColumn("token_count", counter(F.col("content")))


def wide_row_groups(df: DataFrame, block: Column, order: Column, target: int = TARGET_TOKENS, counter=count_tokens) -> DataFrame:
    """Row groups of a Spark table: its columns are the header, rows are packed within ``block`` in ``order``.

    Packing a whole table is one chain, so tables that outgrow a task are packed by blocks (a key or a
    range of rows): ``block, grp, first_pos, n_rows, content, token_count``.
    """
    header = F.array(*map(F.lit, df.columns))
    row = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    rows = df.select(block.alias("block"), order.alias("pos"), row_markdown(row).alias("line")).withColumn("cost", counter(F.col("line"))).withColumn("budget", counter(row_markdown(header)))
    packed = greedy_groups(rows, ["block"], "cost", "budget", target)
    groups = packed.groupBy("block", "grp").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_rows"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    content = reduce(lambda a, b: F.concat(a, b), [header_markdown(header), F.lit("\n"), F.col("lines")])
    return groups.select("block", "grp", "first_pos", "n_rows", content.alias("content")).withColumn("token_count", counter(F.col("content")))
