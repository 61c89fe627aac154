"""Relations of pages, lines, words, characters and geometry from the tables at hand.

Geometry is synthetic: no positioned text is given, so a line of a document is laid on a fixed grid (ADVANCE per character,
LEADING per line, LINES_PER_PAGE lines a page, origin top left). Every relation has explicit ordinals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import prefix_sums

ADVANCE, LEADING, LINES_PER_PAGE, MARGIN = 6.0, 12.0, 60, 72.0
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 864.0

RUN = r"(?is)<(?:p|h1|li|a|title)\b[^>]*>(.*?)</(?:p|h1|li|a|title)>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; any path that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def binary(spark: SparkSession, path: str, magic: bytes = b"%PDF") -> DataFrame:
    """Files as bytes, with whether they begin with the magic; a missing path is an error. Spark
    skips files without a byte."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", "content", (F.substring(F.hex("content"), 1, 2 * len(magic)) == magic.hex().upper()).alias("is_document"))


def page_runs(pages: DataFrame) -> DataFrame:
    """(page_id, runs): the text of each text element in document order, tags stripped and entities decoded."""
    raw = F.regexp_extract_all("html", F.lit(RUN), F.lit(1))
    return pages.select("page_id", F.transform(raw, lambda r: tx.decode_entities(tx.strip_tags(r))).alias("runs"))


def run_rows(pages: DataFrame) -> DataFrame:
    """(page_id, run_no, text), run_no from 0."""
    return page_runs(pages).select("page_id", F.posexplode("runs").alias("run_no", "text"))


def metadata(docs: DataFrame) -> DataFrame:
    """Titles, with a label that falls back to the 1-based position, and empty texts for what is not known."""
    return docs.select(
        "doc_id", F.coalesce(F.substring_index("text", "\n", 1), F.lit("")).alias("title"), F.coalesce("source", F.lit("")).alias("producer"),
        F.coalesce(F.nullif(F.trim(F.coalesce("lang", F.lit(""))), F.lit("")), (F.col("doc_id") + 1).cast("string")).alias("label"),
    )


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, text) with lines counted from 1."""
    return docs.select(key, F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).select(key, (F.col("pos") + 1).alias("line"), "text")


def characters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, seq, ch): every character but line feeds; seq counts from 0 over the text, lines from 1. All of it is
    read inside the text's row, without a shuffle."""
    cut = rows.select(*keys, F.split("text", "\n", -1).alias("l"))
    placed = cut.select(*keys, F.posexplode(F.arrays_zip(F.col("l").alias("t"), prefix_sums(F.transform("l", F.length)).alias("before"))).alias("p", "z"))
    chars = F.filter(F.split("z.t", ""), lambda c: c != "")
    each = placed.select(*keys, (F.col("p") + 1).alias("line"), F.col("z.before").alias("before"), F.posexplode(chars).alias("col", "ch"))
    return each.select(*keys, "line", (F.col("before") + F.col("col")).cast("long").alias("seq"), "ch")


def grid_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, span_no, text, x, y, width, height): a span per line, on the synthetic grid."""
    at = F.col("line") - 1
    return lines(docs).select(
        "doc_id", (F.floor(at / LINES_PER_PAGE) + 1).cast("int").alias("page_no"), F.pmod(at, F.lit(LINES_PER_PAGE)).cast("int").alias("span_no"), "text",
        F.lit(MARGIN).alias("x"), (F.lit(MARGIN) + F.pmod(at, F.lit(LINES_PER_PAGE)) * LEADING).alias("y"),
        (F.length("text") * ADVANCE).alias("width"), F.lit(10.0).alias("height"),
    )


def grid_drawings(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, n, x, y, width, height): one synthetic drawing on the first page, its size from n_chars."""
    n = F.col("n_chars")
    return docs.select(
        "doc_id", F.lit(1).alias("page_no"), F.lit(0).alias("n"), (F.pmod(n, F.lit(5)) * 20.0 - 20.0).alias("x"), F.lit(36.0).alias("y"),
        (F.pmod(n, F.lit(11)) * 50.0 + 40.0).alias("width"), F.pmod(n, F.lit(97)).cast("double").alias("height"),
    )


def write_runs(runs: DataFrame, path: str) -> None:
    """A text file part per write, one run a line, markup escaped."""
    runs.orderBy("page_id", "run_no").select(tx.escape_text(F.regexp_replace("text", "\n", " ")).alias("value")).write.text(path)
