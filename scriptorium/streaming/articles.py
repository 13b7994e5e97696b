"""Articles from dumps that arrive over time (Structured Streaming).

The page split and the title/text extraction are stateless per record, so
the batch operators run unchanged on ``readStream``: each new dump file is
split by the reader. ``start_article_sink`` writes the articles of every
micro-batch; there the batch's files are known, so that the open end of a file
that is cut off inside a page is dropped as in a batch scan, and the order key
is whole. The plain streams (``stream_pages``, ``stream_articles``) have only
records: no ``seq`` in the order key, and a last page that is not closed is
taken for a page. Per-article jobs (categories, search, ISBNs) compose on them.
A file must be complete when it lands in the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.articles import articles_from_records
from scriptorium.sources.dump import PAGE_CLOSE, PAGE_OPEN, _after_open, ends_of_files, pages_of, without_open_ends


def _stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("text").option("lineSep", PAGE_CLOSE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(folder).select("value", *[F.col(f"_metadata.{c}").alias(c) for c in
                                                 ("file_path", "file_block_start", "file_block_length", "file_size")])


def _stream_records(spark: SparkSession, folder: str, max_files_per_trigger: int | None) -> DataFrame:
    return _stream(spark, folder, max_files_per_trigger).where(F.col("value").contains(PAGE_OPEN)).select(
        _after_open(F.col("value")).alias("value"), "file_path", "file_block_start")


def stream_pages(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming S1: pages of every dump file that appears in ``folder``."""
    return pages_of(_stream_records(spark, folder, max_files_per_trigger))


def stream_articles(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming S1 + P1 + F1 in one pass over the records (as
    ``read_articles``): (title, text, file_path, file_block_start)."""
    return articles_from_records(_stream_records(spark, folder, max_files_per_trigger))


def batch_articles(records: DataFrame) -> DataFrame:
    """Articles of a micro-batch of records, as ``read_articles`` gives them
    for its files. A micro-batch does not list its files: a pass without text
    does."""
    files = [r["file_path"] for r in records.select("file_path").distinct().collect()]
    records = records.withColumn("seq", F.monotonically_increasing_id())
    kept = without_open_ends(records, ends_of_files(records.sparkSession, files))
    return articles_from_records(kept.select(_after_open(F.col("value")).alias("value"), "file_path", "file_block_start", "seq"))


def start_article_sink(spark: SparkSession, folder: str, sink: str, checkpoint: str,
                       available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Add the articles of new dump files to the Parquet table at ``sink``, a
    folder ``batch=<n>`` per micro-batch, with the whole order key.

    ``checkpoint`` must be on shared storage (e.g. under
    ``spark.checkpoint.dir``): it records which files were consumed. A batch
    that is run again after a failure writes its folder anew, so a restarted
    query neither skips nor repeats a file.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch_articles(batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    writer = (_stream(spark, folder, max_files_per_trigger).writeStream.foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
