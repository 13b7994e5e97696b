"""ISBN line files: the sink (S3 written) and the source the reports read
(S6). A line is ``title|isbn`` or ``title|isbn|CHECKSUM_WRONG``; it is not
CSV (titles hold quotes, rows have two or three fields)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.isbn import isbn_lines, unescaped
from scriptorium.sources.dump import ORDER_KEY, order_cols
from scriptorium.sources.ordered import write_ordered


def write_isbn_lines(isbns: DataFrame, path: str, ordered: bool = False, escape: bool = False) -> int:
    """Write ISBN rows as line files from the scan's own tasks: one pass over
    the dump, no shuffle, rows of a task in file order. ``ordered``: a folder
    per split, whose names follow each other in dump order (``write_ordered``;
    rows without an order key are sorted). ``escape``: values keep their line
    breaks, reversibly (``isbn_lines``). Returns the number of lines (A9),
    counted while writing."""
    lines = isbn_lines(isbns, escape=escape)
    if ordered and set(ORDER_KEY) <= set(lines.columns):
        return write_ordered(lines, path, "hit_no")
    if ordered:
        lines = lines.orderBy(*(order_cols(lines) or ["value"]), "hit_no")
    seen = Observation("isbn_lines")
    lines.observe(seen, F.count(F.lit(1)).alias("n")).select("value").write.mode("overwrite").text(path)
    return seen.get["n"]


def read_isbn_lines(spark: SparkSession, path: str | list[str], escaped: bool = False) -> DataFrame:
    """S6 + P2: the lines with their fields. ``title`` is everything before
    the first ``|`` (a line without ``|`` is all title, as ``cut -f1``). Only
    a newline ends a line; a carriage return is part of it. ``escaped``: fields
    written with ``escape`` are read back as they were.

    Columns: ``value, title, isbn, flag`` and a file-order key
    ``file_path, file_block_start, seq``.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("lineSep", "\n").text(paths)
    fields = F.split(F.col("value"), r"\|", 3)
    plain = unescaped if escaped else lambda c: c
    return df.select(
        "value",
        plain(F.substring_index("value", "|", 1)).alias("title"),
        plain(F.try_element_at(fields, F.lit(2))).alias("isbn"),
        F.try_element_at(fields, F.lit(3)).alias("flag"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
        F.monotonically_increasing_id().alias("seq"),
    )
