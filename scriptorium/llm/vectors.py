"""Blocks of vectors for the two searches: which rows take part, their split
into blocks of bounded size, and the merge of per-block top lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SCHEMA = "block long, ids binary, vectors binary, dim int"


def valid_vectors(table: DataFrame, id_col: str, vec_col: str, drop_zero: bool = False) -> DataFrame:
    """``vec_id, v`` (array<double>): rows whose vector is not null and holds
    only finite components (with ``drop_zero``, not only zeros).

    A row without an id cannot be named in a result and takes no part. An id
    names one vector: repeated rows count once, and of different vectors under
    one id the smallest (as arrays compare) is used. Shorter vectors are
    padded with zeros to the longest, which leaves inner products unchanged.
    """
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = (table.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fine)
                 .select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")))
    if drop_zero:
        rows = rows.where(F.exists("v", lambda c: c != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def blocks(rows: DataFrame, n_blocks: int, dim: int, dtype: str = "<f8", value: str = "v") -> DataFrame:
    """Rows (vec_id, array) as one row per block: ``block, ids, vectors, dim``
    (packed arrays, ordered by id). Ids are hashed to blocks, so with
    ``n_blocks`` in proportion to the rows a block stays bounded."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        m = np.zeros((len(pdf), dim), dtype=dtype)
        for i, v in enumerate(pdf["x"]):
            m[i, :len(v)] = v
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()],
                             "vectors": [m.tobytes()], "dim": [dim]})

    return (rows.select(block.alias("block"), "vec_id", F.col(value).alias("x"))
                .groupBy("block").applyInPandas(pack, BLOCK_SCHEMA))


def unpack(ids: bytes, vectors: bytes, dim: int, dtype: str = "<f8") -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, dtype).reshape(-1, dim)


def tiles(query_blocks: DataFrame, shards: DataFrame, n_query_blocks: int, n_shards: int) -> DataFrame:
    """Every query block beside every shard, one row per tile. The stated
    query set meets all rows block by block: both sides are repeated along the
    grid and joined on the tile."""
    q = query_blocks.select(*[F.col(c).alias(f"q_{c}") for c in query_blocks.columns],
                            F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("s"))
    q = q.withColumn("tile", F.col("q_block") * n_shards + F.col("s"))
    c = shards.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("qb"))
    c = c.withColumn("tile", F.col("qb") * n_shards + F.col("block"))
    return q.join(c, "tile")


def top_of_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row: highest score first, ties to
    the smaller id (columns must be ordered by id). -inf takes no part."""
    n, m = scores.shape
    if m > k:
        low = np.partition(scores, m - k, axis=1)[:, m - k]
        mask = (scores >= low[:, None]) & (scores > -np.inf)
    else:
        mask = scores > -np.inf
    r, c = np.nonzero(mask)
    o = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[o], c[o]
    start = np.searchsorted(r, np.arange(n))
    keep = np.arange(len(r)) - start[r] < k
    return r[keep], c[keep]


def merge_tree(lists: DataFrame, k: int, n_parts: int, fan_in: int = 16) -> DataFrame:
    """Merge per-part top lists ``query_id, part, vec_id, score`` into one per
    query, ``fan_in`` parts at a time: no step ranks more than fan_in * k rows
    of a query together. Returns ``query_id, rank, vec_id, score``."""
    best: list[Column] = [F.col("score").desc(), F.col("vec_id").asc()]
    while True:
        n_parts = -(-n_parts // fan_in)
        lists = lists.withColumn("part", F.expr(f"part div {fan_in}"))
        w = Window.partitionBy("query_id", "part").orderBy(*best)
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if n_parts <= 1:
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        lists = lists.drop("rank")


def per_batch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batches:
        yield from pdf.to_dict("records")
