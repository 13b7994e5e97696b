"""Helpers shared by the operators: tables written to the shared folder,
byte-bounded Arrow batches, connected components, bounded training samples."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import scratch_root

# Words are maximal runs of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table_path(spark: SparkSession, name: str) -> str:
    """A new folder for one written table under the shared scratch folder."""
    return f"{scratch_root(spark)}/scriptorium_llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the
    lineage, survives lost executors and is never computed twice."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 8) -> None:
    """Bound the Arrow batches that Python tasks get by rows and by bytes
    (a single longer text still makes a batch of its own)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components: ``(node, component)`` for every node of ``edges``;
    the component is the smallest node of it.

    Labels start as the smallest neighbour and shrink in rounds: each node
    takes the smallest label around it, then the label of that label (pointer
    jumping), until a round changes nothing. Rounds grow with the logarithm of
    the longest path. Each round reads and writes tables in the shared folder;
    only the number of changed rows reaches the driver. A hub's edges are
    aggregated before the shuffle, and joins read written tables on both
    sides, so that adaptive execution can split a hub's partition.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where(F.col("u") != F.col("v"))
    e = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    label = materialize(e.groupBy(F.col("u").alias("node"))
                         .agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    while True:
        around = (e.join(label, e["v"] == label["node"])
                   .select(F.col("u").alias("node"), "component")
                   .unionByName(label)
                   .groupBy("node").agg(F.min("component").alias("near")))
        up = label.select(F.col("node").alias("near"), F.col("component").alias("top"))
        own = label.select(F.col("node").alias("n0"), F.col("component").alias("old"))
        # every label is a node of the same component, so "top" always exists
        new = materialize(around.join(up, "near").join(own, F.col("node") == F.col("n0"))
                          .select("node", F.least("near", "top").alias("component"), "old"), "labels")
        changed = new.where(F.col("component") != F.col("old")).limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label


def sample_ids(rows: DataFrame, id_col: str, label_col: str, per_label: int, salts: int = 16) -> DataFrame:
    """At most ``per_label`` rows of each label, those with the smallest
    64-bit hash of their id: ``(id_col, label_col)``.

    Two levels, so that a label with a third of all rows is not ranked in one
    task: first inside (label, salt), then among the survivors of a label.
    """
    order = [F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.col(id_col)]
    r = (rows.select(id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), F.lit("salt")), F.lit(salts))))
    w1 = Window.partitionBy(label_col, "_salt").orderBy(*order)
    w2 = Window.partitionBy(label_col).orderBy(*order)
    r = r.withColumn("_n", F.row_number().over(w1)).where(F.col("_n") <= per_label).drop("_n")
    return (r.withColumn("_n", F.row_number().over(w2)).where(F.col("_n") <= per_label)
             .select(id_col, label_col))


def sampled_texts(rows: DataFrame, ids: DataFrame, id_col: str, label_col: str, text_col: str) -> DataFrame:
    """Whole texts of the sampled ids, written once: ``(label, text)``, one row
    per id and label, however many rows an id has (the smallest text). ``ids``
    has a bounded number of rows per label."""
    ids = ids.groupBy(id_col).agg(F.max(label_col).alias("label"))
    got = rows.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(ids), id_col)
    return materialize(got.groupBy(id_col, "label").agg(F.min("text").alias("text")).select("label", "text"), "sample")


def bounded_windows(sample: DataFrame, cut: Callable[[str], list[str]], per_label: int) -> list[Row]:
    """Windows ``(label, text)`` of the sampled texts, at most ``per_label`` of
    each label: every text's first ones, then the second ones, and so on; among
    equals those with the smallest hash. Texts are cut on the executors by
    ``cut``, which sees them whole and bounds what it returns; the driver gets
    the windows only."""
    label = sample.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for y, text in zip(batch["label"], batch["text"]):
                yield pd.DataFrame([(y, no, w) for no, w in enumerate(cut(text))], columns=["label", "no", "text"])

    rows = sample.mapInPandas(run, f"label {label}, no int, text string")
    order = Window.partitionBy("label").orderBy("no", F.xxhash64("text"), "text")
    return (rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label)
                .select("label", "text").orderBy(F.xxhash64("text"), "text", "label").collect())


def spread_windows(text: str, size: int, most: int) -> list[str]:
    """Up to ``most`` of a text's windows of about ``size`` characters, which
    together are the whole text, in an order drawn from their numbers. Windows
    begin behind white space where there is some near."""
    n = max(1, -(-len(text) // size))
    pick = sorted(range(n), key=lambda i: zlib.crc32(f"{n}/{i}".encode()))[:most]
    at = lambda i: 0 if i <= 0 else next((k + 1 for k in range(i * size, min(i * size + 100, len(text))) if text[k].isspace()), i * size)
    return [text[at(i):at(i + 1) if i + 1 < n else len(text)] for i in pick]


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 5, is 0
    (rows without an id are held out as well)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))
