"""Category jobs: per-article link counts (X2), the global statistics (A1)
and usage per category name (A2)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.numbers import c_format
from scriptorium.functions.text import count_nonoverlapping, quote_regex
from scriptorium.operators.articles import aggregate_articles
from scriptorium.sources.dump import ORDER_KEY, order_cols

# Fixed value: the German category link tag the reference counts.
CATEGORY_TAG = "[[Kategorie:"


def category_counts(articles: DataFrame, tag: str = CATEGORY_TAG) -> DataFrame:
    """Number of category links per article (non-overlapping, case
    sensitive). Columns: ``title, n`` and the order key."""
    return articles.select("title", count_nonoverlapping(F.col("text"), tag).alias("n"), *order_cols(articles))


def category_stats(articles: DataFrame, tag: str = CATEGORY_TAG) -> DataFrame:
    """A1: one row of category statistics over all articles.

    ``max_cat_article`` is the first article in file order among those with
    the most links ('' when no article has a link). Percent and average are
    raw doubles; the average is per article *with* categories. Plan: one
    narrow stage and a partial aggregate, so the exchange carries one row per
    task.
    """
    counted = category_counts(articles, tag)
    # file order decides ties; without an order key, the smallest title
    tie_break = [*[F.col(c) for c in order_cols(articles)], F.col("title")]
    n = F.col("n")
    agg = counted.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count_if(n > 0).alias("articles_with_cats"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_categories"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_categories"),
        # min over (-n, file order) among articles with a link
        F.min_by("title", F.when(n > 0, F.struct((-n).alias("neg_n"), *tie_break)))
        .alias("_max_title"),
    )
    total, with_cats, links = F.col("total_articles"), F.col("articles_with_cats"), F.col("total_categories")
    return agg.select(
        "total_articles", "articles_with_cats", "total_categories", "max_categories",
        F.coalesce(F.col("_max_title"), F.lit("")).alias("max_cat_article"),
        # divide first, then scale: the reference's order of operations
        F.when(total > 0, with_cats / total * 100.0).otherwise(F.lit(0.0)).alias("pct_with_cats"),
        F.when(with_cats > 0, links / with_cats).otherwise(F.lit(0.0)).alias("avg_per_article_with_cats"),
    )


def category_usage(articles: DataFrame, tag: str = CATEGORY_TAG) -> DataFrame:
    """A2: links per category name; the name is what follows the tag up to
    the next ``|`` or ``]``, or the next tag. Every link counted by A1c has a
    name, so the sum of ``n`` is A1c. Columns: ``category, n``.

    Only names leave the article (the text never reaches the shuffle), and
    the partial aggregate collapses a hot category before the exchange.
    """
    pieces = F.split("text", quote_regex(tag), -1)  # each piece but the first follows a tag
    names = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1),
                        lambda x: F.substring_index(F.substring_index(x, "|", 1), "]", 1))
    return (articles.filter(F.col("text").contains(tag))
            # outer + filter: keeps the extraction from being evaluated twice
            .select(F.explode_outer(names).alias("category"))
            .filter(F.col("category").isNotNull())
            .groupBy("category")
            .agg(F.count(F.lit(1)).alias("n")))


# The labels of the reference's summary (count-cats action).
STATS_TEMPLATE = (
    "Category Statistics:\n"
    "Total articles: {total_articles}\n"
    "Articles with categories: {articles_with_cats} ({pct_with_cats:.1f}%)\n"
    "Total categories: {total_categories}\n"
    "Average categories per article: {avg_per_article_with_cats:.2f}\n"
    "Maximum categories: {max_categories} in article \"{max_cat_article}\"\n"
)


def category_summary(stats: DataFrame) -> DataFrame:
    """The summary text of ``category_stats`` as a row: ``summary``. Numbers
    are rounded in the plan as C's printf does (``c_format``)."""
    parts = re.split(r"\{(\w+)(?::\.(\d)f)?\}", STATS_TEMPLATE)
    out = [F.lit(parts[0])]
    for name, digits, text in zip(parts[1::3], parts[2::3], parts[3::3]):
        value = F.col(name).cast("string") if digits is None else c_format(F.col(name), int(digits))
        out += [value, F.lit(text)]
    return stats.select(F.concat(*out).alias("summary"))


def format_category_stats(stats: DataFrame) -> str:
    """The summary text of ``category_stats`` (one aggregated row)."""
    row = category_summary(stats).collect()
    if len(row) != 1:
        raise ValueError("expected the one-row result of category_stats")
    return row[0]["summary"]


# A1 as a custom job with state, for articles that a Python step has to look at anyway.

def _stats_init() -> tuple:
    return (0, 0, 0, 0, None, "")  # articles, with links, links, maximum, order of its first article, title


def _stats_step(tag: str):
    def step(state: tuple, batch: pd.DataFrame) -> tuple:
        n = batch["text"].str.count(re.escape(tag)).to_numpy()
        total, with_links, links, most, first, title = state
        if len(n) and n.max() > 0:
            # batches follow each other in file order, and so do the rows of one
            best = batch[n == n.max()]
            keys = [c for c in (*ORDER_KEY, "title") if c in best.columns]
            row = min(tuple(r) for r in best[keys].itertuples(index=False))
            state = _stats_merge((total, with_links, links, most, first, title),
                                 (0, 0, 0, int(n.max()), row, row[-1]))
            most, first, title = state[3:]
        return (total + len(n), with_links + int((n > 0).sum()), links + int(n.sum()), most, first, title)

    return step


def _stats_merge(a: tuple, b: tuple) -> tuple:
    best = min((s for s in (a, b) if s[3] > 0), key=lambda s: (-s[3], s[4]), default=a)
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2], *best[3:])


def _stats_finish(s: tuple) -> pd.DataFrame:
    return pd.DataFrame([(s[0], s[1], s[2], s[3], s[5], s[1] / s[0] * 100.0 if s[0] else 0.0, s[2] / s[1] if s[1] else 0.0)],
                        columns=["total_articles", "articles_with_cats", "total_categories", "max_categories", "max_cat_article",
                                 "pct_with_cats", "avg_per_article_with_cats"])


def category_stats_by_state(articles: DataFrame, tag: str = CATEGORY_TAG) -> DataFrame:
    """``category_stats`` through ``aggregate_articles``: the same row, as an
    example of a job whose state is a Python object."""
    return aggregate_articles(articles, _stats_init, _stats_step(tag), _stats_merge, _stats_finish,
                              "total_articles long, articles_with_cats long, total_categories long, max_categories long, "
                              "max_cat_article string, pct_with_cats double, avg_per_article_with_cats double")
