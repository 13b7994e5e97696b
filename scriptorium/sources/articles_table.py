"""Materialised articles: the extracted (title, text) table in Parquet.

Parsing the XML is the expensive part of every job. Writing the articles
once (columnar, compressed, splittable) lets later jobs read only the
columns they need; a category job then reads ``title`` and ``text`` and no
XML. The order key is kept, so file-order tie breaks are unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.dump import ORDER_KEY

ARTICLE_COLUMNS = ["title", "text", *ORDER_KEY]


def write_articles(articles: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write the articles as Parquet (one file per task, no shuffle)."""
    articles.select(*ARTICLE_COLUMNS).write.mode(mode).parquet(path)
    return path


def read_articles_table(spark: SparkSession, path: str) -> DataFrame:
    """Read articles written by ``write_articles`` or by the stream's sink;
    same columns as ``read_articles``. In a table without ``seq`` it is 0, and
    ties within a split fall to the title."""
    df = spark.read.parquet(path)
    return (df if "seq" in df.columns else df.withColumn("seq", F.lit(0).cast("long"))).select(*ARTICLE_COLUMNS)
