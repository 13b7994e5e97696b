"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory. Each one reads the given tables (through the
fixture dump derived from ``documents``, or ``pages`` directly) and runs the
whole job through the library on all rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import reports
from scriptorium.plans import rich
from scriptorium.operators.articles import extract_articles, extract_title, per_article, read_articles, scan_counters
from scriptorium.operators.categories import category_counts, category_stats, category_usage
from scriptorium.functions.isbn import checksum_steps
from scriptorium.operators.isbn import extract_isbns, isbn_count, isbn_lines
from scriptorium.operators.search import search_kwic, search_lines
from scriptorium.plans.fixtures import _exists, code_tag, fixture_dump
from scriptorium.session import scratch_root
from scriptorium.sources.dump import page_index, page_records, read_pages
from scriptorium.sources.isbn_file import read_isbn_lines, write_isbn_lines

# Parameters of the registered queries.
SEARCH_TERM = "erer"
SEARCH_CONTEXT = 20
TOP_N = 10
SAMPLE_N = 10
FILTER_LINE_PATTERN = "Berlin"
FILTER_TITLE_PATTERN = "^Doc 40 Berlin$"


def articles(spark: SparkSession, sf_dir: str, grouped_titles: bool = False) -> DataFrame:
    return read_articles(spark, fixture_dump(spark, sf_dir, grouped_titles))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ISBN line file of the shared-title dump (extended dialect),
    written once to the scratch folder and read back as the reports do."""
    dump = fixture_dump(spark, sf_dir, grouped_titles=True)
    code = code_tag("sources/dump.py", "operators/articles.py", "functions/isbn.py", "operators/isbn.py",
                    "sources/isbn_file.py")
    path = f"{scratch_root(spark)}/scriptorium/isbn_lines/{hashlib.sha1((dump + code).encode()).hexdigest()[:16]}"
    if not _exists(spark, path + "/_SUCCESS"):
        write_isbn_lines(extract_isbns(read_articles(spark, dump), "extended"), path, ordered=True)
    return read_isbn_lines(spark, path)


def q_dump_scan(spark, sf_dir):
    return read_pages(spark, fixture_dump(spark, sf_dir)).select("page")


def q_page_index(spark, sf_dir):
    return page_index(spark, fixture_dump(spark, sf_dir)).select("start_pos", "length")


def q_article_extract(spark, sf_dir):
    # the page-level operator (P1 on S1 pages); other queries use read_articles
    return extract_articles(read_pages(spark, fixture_dump(spark, sf_dir))).select("title", "text")


def q_html_title(spark, sf_dir):
    pages = spark.read.parquet(os.path.join(sf_dir, "pages.parquet"))
    return extract_title(pages, "html").select("page_id", "title")


def q_scan_counters(spark, sf_dir):
    records = page_records(spark, fixture_dump(spark, sf_dir))
    return scan_counters(records, lambda t: isbn_count(t, "extended"), "isbns")


def q_category_counts(spark, sf_dir):
    return category_counts(articles(spark, sf_dir)).select("title", "n")


def q_category_stats(spark, sf_dir):
    return category_stats(articles(spark, sf_dir))


def q_category_usage(spark, sf_dir):
    return category_usage(articles(spark, sf_dir))


def q_search_kwic(spark, sf_dir):
    hits = search_kwic(articles(spark, sf_dir), SEARCH_TERM, SEARCH_CONTEXT)
    return hits.select("title", "match_no", "match_pos", "context")


def q_search_kwic_bytes(spark, sf_dir):
    """Byte-unit search; the BINARY context is shown as hex so that it
    compares as text."""
    hits = search_kwic(articles(spark, sf_dir), SEARCH_TERM, SEARCH_CONTEXT, unit="bytes")
    return hits.select("title", "match_no", "match_pos", F.hex("context").alias("context_hex"))


def q_search_lines(spark, sf_dir):
    return search_lines(search_kwic(articles(spark, sf_dir), SEARCH_TERM, SEARCH_CONTEXT)).select("value")


def q_isbn_extract_basic(spark, sf_dir):
    return extract_isbns(articles(spark, sf_dir), "basic").select("title", "hit_no", "isbn", "checksum_valid")


def q_isbn_extract_extended(spark, sf_dir):
    return extract_isbns(articles(spark, sf_dir), "extended").select("title", "hit_no", "isbn", "checksum_valid")


def q_isbn_lines(spark, sf_dir):
    return isbn_lines(extract_isbns(articles(spark, sf_dir), "extended")).select("value")


def q_isbn_checksum(spark, sf_dir):
    """The checksum verdict (X7-X9) on every value of the extended
    extraction, with the recomputed check value (10 stands for X)."""
    found = extract_isbns(articles(spark, sf_dir), "extended").select("title", "isbn")
    return found.selectExpr("title", "isbn", *checksum_steps("isbn", "checksum_valid")).selectExpr(
        "title", "isbn", "checksum_valid", "cast(if(_ck_nd = 13, _ck_c13, _ck_c10) AS int) AS check_value")


def q_isbn_file_source(spark, sf_dir):
    return report_lines(spark, sf_dir).select("title", "isbn", "flag")


def q_isbn_stats(spark, sf_dir):
    return reports.isbn_stats(report_lines(spark, sf_dir))


def q_isbn_top_articles(spark, sf_dir):
    return reports.isbn_top_articles(report_lines(spark, sf_dir), TOP_N)


def q_isbn_format_distribution(spark, sf_dir):
    return reports.isbn_format_distribution(report_lines(spark, sf_dir))


def q_isbn_sample(spark, sf_dir):
    return reports.isbn_sample(report_lines(spark, sf_dir), SAMPLE_N)


def q_isbn_filter_line(spark, sf_dir):
    return reports.isbn_filter(report_lines(spark, sf_dir), FILTER_LINE_PATTERN, on="line").select("value", "title")


def q_isbn_filter_title(spark, sf_dir):
    return reports.isbn_filter(report_lines(spark, sf_dir), FILTER_TITLE_PATTERN, on="title").select("value", "title")


def q_isbn_filter_summary(spark, sf_dir):
    return reports.isbn_filter_summary(reports.isbn_filter(report_lines(spark, sf_dir), FILTER_LINE_PATTERN))


def _article_sizes(batch: pd.DataFrame) -> pd.DataFrame:
    """Example per-article job: UTF-8 sizes of title and text."""
    size = lambda c: pc.binary_length(pa.array(batch[c], pa.string()).cast(pa.binary())).to_numpy().astype("int64")
    return pd.DataFrame({"title": batch["title"], "title_bytes": size("title"), "text_bytes": size("text")})


def q_per_article(spark, sf_dir):
    return per_article(articles(spark, sf_dir).select("title", "text"), _article_sizes,
                       "title string, title_bytes long, text_bytes long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dump_scan": q_dump_scan,
    "page_index": q_page_index,
    "article_extract": q_article_extract,
    "html_title": q_html_title,
    "scan_counters": q_scan_counters,
    "category_counts": q_category_counts,
    "category_stats": q_category_stats,
    "category_usage": q_category_usage,
    "search_kwic": q_search_kwic,
    "search_kwic_bytes": q_search_kwic_bytes,
    "search_lines": q_search_lines,
    "isbn_extract_basic": q_isbn_extract_basic,
    "isbn_extract_extended": q_isbn_extract_extended,
    "isbn_lines": q_isbn_lines,
    "isbn_checksum": q_isbn_checksum,
    "isbn_file_source": q_isbn_file_source,
    "isbn_stats": q_isbn_stats,
    "isbn_top_articles": q_isbn_top_articles,
    "isbn_format_distribution": q_isbn_format_distribution,
    "isbn_sample": q_isbn_sample,
    "isbn_filter_line": q_isbn_filter_line,
    "isbn_filter_title": q_isbn_filter_title,
    "isbn_filter_summary": q_isbn_filter_summary,
    "per_article": q_per_article,
    **rich.QUERIES,
}
