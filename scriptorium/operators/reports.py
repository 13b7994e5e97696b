"""Reports over ISBN lines (the reference's two shell scripts): totals
(A3-A5), top articles (A6, T1), format distribution (F5, A7, X14), the
sample (T2), and the pattern filter with its summary (F4, A8).

Input: the DataFrame of ``read_isbn_lines`` (``value, title`` and a file
order key). Percent and average columns are truncated to two decimals
like ``bc scale=2``, and null where the reference would divide by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.ere import to_java

LINE_ORDER = ["file_path", "file_block_start", "seq"]

# Fixed value: the ISBN-13 shape test of the report.
ISBN13_LINE = r"\|97[89][-0-9]{10,14}$"


def _trunc2(num: Column, den: Column) -> Column:
    """num / den truncated to two decimals; null when den = 0."""
    return F.when(den > 0, F.floor((num * 100) / den) / F.lit(100.0))


def _titles(collation: str | None) -> Column:
    return F.col("title") if collation is None else F.collate(F.col("title"), collation)


def isbn_stats(lines: DataFrame, collation: str | None = None) -> DataFrame:
    """A3-A5: one row ``total, articles, avg_per_article``. Titles differ if
    their bytes do, or (T3) by one of Spark's collations, as ``de`` or
    ``UNICODE``: those that it takes for equal count once."""
    agg = lines.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(_titles(collation)).alias("articles"))
    return agg.select("total", "articles",
                      _trunc2(F.col("total"), F.col("articles")).alias("avg_per_article"))


def isbn_top_articles(lines: DataFrame, n: int = 10, collation: str | None = None) -> DataFrame:
    """A6 + T1: ISBN count per title, the ``n`` largest; ties by title
    descending (``sort -nr`` on ``count title``): by bytes as in the C locale,
    or by one of Spark's collations, as ``de`` or ``UNICODE``, and by bytes
    where that takes titles for equal (as ``sort`` does at last)."""
    if n < 0:
        raise ValueError("n must be >= 0")
    counts = lines.groupBy("title").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), _titles(collation).desc(), F.desc("title")).limit(n)


def isbn_format_distribution(lines: DataFrame) -> DataFrame:
    """F5 + A7: lines whose ISBN looks like an ISBN-13 (``|978``/``|979``
    then 10-14 of ``[-0-9]`` to the end of the line) against all others.
    Flagged lines and ISBN-13s written with spaces count as "other", as in
    the reference. One row ``isbn13, other, isbn13_pct, other_pct``."""
    is13 = F.col("value").rlike(ISBN13_LINE)
    agg = lines.agg(F.count(F.lit(1)).alias("total"), F.count_if(is13).alias("isbn13"))
    total = F.col("total")
    return agg.select(
        "isbn13",
        (total - F.col("isbn13")).alias("other"),
        _trunc2(F.col("isbn13") * 100, total).alias("isbn13_pct"),
        _trunc2((total - F.col("isbn13")) * 100, total).alias("other_pct"),
    )


def isbn_sample(lines: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` lines in file order (``head``)."""
    return lines.orderBy(*LINE_ORDER).limit(n).select("value")


SYNTAXES = ("java", "ere")


def isbn_filter(lines: DataFrame, pattern: str, on: str = "line", syntax: str = "java", ascii_classes: bool = False) -> DataFrame:
    """lines matching a regular expression.

    ``on="line"`` is what the reference does (it greps the whole line, so the
    pattern also sees the ISBN and ``^Berlin$`` never matches);
    ``on="title"`` is what its help text promises. ``syntax="ere"``: the
    pattern is a POSIX extended expression, as the reference's ``grep -E``
    reads it (``functions.ere``); ``"java"``: one of Java, as ``rlike`` reads it.
    """
    if syntax not in SYNTAXES:
        raise ValueError(f"syntax must be one of {SYNTAXES}")
    if on not in ("line", "title"):
        raise ValueError("on must be 'line' or 'title'")
    java = to_java(pattern, ascii_classes) if syntax == "ere" else pattern
    return lines.filter(F.col("value" if on == "line" else "title").rlike(java))


def isbn_filter_summary(matched: DataFrame, collation: str | None = None) -> DataFrame:
    """One row ``isbns, articles`` over filtered lines (0 and 0 when
    nothing matches); titles differ as in ``isbn_stats``."""
    return matched.agg(F.count(F.lit(1)).alias("isbns"), F.count_distinct(_titles(collation)).alias("articles"))
