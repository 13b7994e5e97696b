"""scriptorium: Spark-native analytics over MediaWiki XML dumps.

A dump is read in parallel as a table of pages, turned into a table of
articles (title and raw wikitext), and the per-article jobs run as
DataFrame plans: category statistics, keyword-in-context search with
overlapping matches, ISBN extraction in two dialects, and reports over the
extracted ISBN lines.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run in Python workers (the Arrow UDF of the
# search, the page-index running sums, the per-article hook) travel with the
# task by value, so executors need not have the package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from scriptorium.sources.dump import read_pages, page_index  # noqa: E402
from scriptorium.sources.isbn_file import read_isbn_lines, write_isbn_lines
from scriptorium.operators.articles import (articles_from_records, extract_articles, per_article, read_articles,
                                            read_articles_observed, scan_counters)
from scriptorium.operators.categories import category_counts, category_stats, category_usage
from scriptorium.operators.search import search_kwic, search_lines, write_search_lines
from scriptorium.operators.isbn import extract_isbns, isbn_lines
from scriptorium.operators import reports

__all__ = [
    "read_pages",
    "page_index",
    "read_isbn_lines",
    "write_isbn_lines",
    "extract_articles",
    "articles_from_records",
    "read_articles",
    "read_articles_observed",
    "scan_counters",
    "per_article",
    "category_counts",
    "category_stats",
    "category_usage",
    "search_kwic",
    "search_lines",
    "write_search_lines",
    "extract_isbns",
    "isbn_lines",
    "reports",
]
