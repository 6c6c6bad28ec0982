"""Files of any kind as documents and elements: dispatch by extension, one branch a format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import table_markdown
from tessera.schema import elements as as_elements
from tessera.sources.contract import contract_elements
from tessera.sources.html import parsed_html_elements
from tessera.sources.text import markdown_elements, text_elements

# What extensions hold.
AUDIO = (".mp3", ".wav", ".m4a", ".flac", ".ogg", ".aac")
VIDEO = (".mp4", ".mov", ".mkv", ".webm", ".avi")
IMAGE = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".tiff", ".bmp")
DOCUMENT = (".pdf", ".docx", ".pptx", ".xlsx", ".csv", ".html", ".htm", ".md", ".txt", ".asciidoc")
MAX_FILES, MAX_FILE, MAX_TOTAL = 20, 50 << 20, 200 << 20
#: A parser for formats without one here: (binary DataFrame) to elements.
Parser = Callable[[DataFrame], DataFrame]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def branch(path: Column) -> Column:
    """``contract``, ``audio``, ``video``, ``image`` or ``document``."""
    ext = extension(path)
    return F.when(ext == ".json", "contract").when(ext.isin(*AUDIO), "audio").when(ext.isin(*VIDEO), "video").when(ext.isin(*IMAGE), "image").otherwise("document")


def leaf(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, name, extension, branch, length, sha256, content`` of every file below a path. ``doc_id`` is a hash of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", leaf(F.col("path")).alias("name"), extension(F.col("path")).alias("extension"), branch(F.col("path")).alias("branch"), "length", F.sha2("content", 256).alias("sha256"), "content")


def check_uploads(files: DataFrame, max_files: int = MAX_FILES, max_file: int = MAX_FILE, max_total: int = MAX_TOTAL) -> None:
    """Raise ``ValueError`` for too many, too large or unknown files; one row comes to the driver."""
    known = F.col("extension").isin(*DOCUMENT, *AUDIO, *VIDEO, *IMAGE, ".json")
    r = files.agg(F.count("*").alias("n"), F.coalesce(F.max("length"), F.lit(0)).alias("largest"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"), F.min(F.when(~known, F.col("name"))).alias("odd")).first()
    for bad, why in ((r.n > max_files, f"at most {max_files} files"), (r.largest > max_file, f"at most {max_file} bytes a file"), (r.total > max_total, f"at most {max_total} bytes in all"), (r.odd is not None, f"unsupported file type: {r.odd}")):
        if bad:
            raise ValueError(why)


def unique_names(files: DataFrame) -> DataFrame:
    """Names made distinct: repeats get ``_1``, ``_2`` and so on before the extension."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("name").orderBy("path")) - 1
    stem, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    return files.withColumn("name", F.when(k > 0, F.concat(stem, F.lit("_"), k.cast("string"), ext)).otherwise(F.col("name")))


def csv_elements(files: DataFrame, delimiter: str = ",") -> DataFrame:
    """A whole file as one table element with its grid; quoted cells may hold delimiters and breaks."""
    import csv
    import io

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            grids = [[[c.strip() for c in r] for r in csv.reader(io.StringIO(t or ""), delimiter=delimiter) if r] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(grids, pa.list_(pa.list_(pa.string())))], ["doc_id", "grid"])

    out = files.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, grid array<array<string>>").filter("size(grid) > 0")
    return out.select("doc_id", F.lit(0).alias("pos"), F.lit("el_0").alias("id"), F.lit("table").alias("kind"), table_markdown(F.col("grid")).alias("text"), "grid", F.get("grid", F.lit(0)).alias("header_row"), F.lit(1).alias("page"))


def table_element(df: DataFrame, doc_id: int, rows: int, order: str) -> DataFrame:
    """A Spark table of at most ``rows`` rows as one table element; larger ones are profiled and packed as they are."""
    data = df.orderBy(order).limit(rows + 1)
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    listed = data.select(F.struct(F.col(order).alias("k"), cells.alias("r")).alias("x")).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]).alias("rows"), F.count("*").alias("n"))
    checked = listed.withColumn("rows", F.when(F.col("n") <= rows, F.col("rows")).otherwise(F.raise_error(F.lit(f"more than {rows} rows"))))
    header = F.array(*map(F.lit, df.columns))
    grid = F.concat(F.array(header), "rows")
    return checked.select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(0).alias("pos"), F.lit("el_0").alias("id"), F.lit("table").alias("kind"), table_markdown(grid).alias("text"), grid.alias("grid"), header.alias("header_row"))


def file_elements(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Elements of all files that can be read here, each format by its own plan.

    ``parsers`` add formats (PDF, office files, media) by extension; files without a parser give no elements
    and show in :func:`skipped`.
    """
    text = files.withColumn("text", F.decode("content", "UTF-8"))
    of = lambda *ext: text.filter(F.col("extension").isin(*ext))
    parts = [
        text_elements(of(".txt", ".asciidoc"), r"\n\s*\n"), markdown_elements(of(".md")), csv_elements(of(".csv")),
        parsed_html_elements(of(".html", ".htm").select("doc_id", F.col("text").alias("html")), "doc_id"), contract_elements(of(".json")),
    ]
    for ext, parse in (parsers or {}).items():
        parts.append(parse(files.filter(F.col("extension") == ext)))
    out = as_elements(parts[0])
    for p in parts[1:]:
        out = out.unionByName(as_elements(p))
    return out


def skipped(files: DataFrame, elements: DataFrame) -> DataFrame:
    """Files that gave no element: ``doc_id, name, reason``."""
    return files.join(elements.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "name", F.concat(F.lit("nothing could be read from a file of type "), "extension").alias("reason"))


def documents_of(files: DataFrame) -> DataFrame:
    """``doc_id, title, source_uri, sha256`` for the engine."""
    return files.select("doc_id", F.regexp_replace("name", r"\.[^.]*$", "").alias("title"), F.col("path").alias("source_uri"), "sha256")
