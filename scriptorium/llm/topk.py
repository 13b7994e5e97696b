"""Exact top-k by tiled matrix products of quantised vectors.

Components become floor(64 * x). Queries and candidates are packed into
blocks; every tile (query block, shard) is one matrix product with a partial
selection of the k best per query, and the per-tile lists are merged in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bounded_batches, materialize
from scriptorium.llm.vectors import blocks, merge_tree, per_batch_rows, tiles, top_of_rows, unpack, valid_vectors

SCALE = 64
SHARD_ROWS = 8192
QUERY_ROWS = 1024
EXACT = 2.0 ** 53


def integer_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows as int64: a floating-point matrix
    product where every partial sum is exact, else 64-bit integer products."""
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= EXACT:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return (q @ c.T).astype(np.int64)


def exact_top_k(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
                shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of every row matching ``is_query``
    (a condition on ``vec_id``) the ``k`` other rows with the highest integer
    inner product, ties to the smaller id; all, if fewer.

    Rows that take no part and repeated ids: see ``valid_vectors``. Scores are
    exact while they fit 64 bits.
    """
    bounded_batches(table.sparkSession, rows=1, mb=64)
    rows = valid_vectors(table, id_col, vec_col)
    rows = materialize(rows.select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v")), "quantised")
    n, n_queries, dim = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_rows))
    grid = tiles(blocks(rows.where(is_query), n_blocks, dim), blocks(rows, n_shards, dim), n_blocks, n_shards)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in per_batch_rows(batches):
            q_ids, q = unpack(t["q_ids"], t["q_vectors"], dim)
            ids, c = unpack(t["ids"], t["vectors"], dim)
            for at in range(0, len(q_ids), 128):
                exact = integer_scores(q[at:at + 128], c)
                own = q_ids[at:at + 128, None] == ids[None, :]
                lowest = np.iinfo(np.int64).min
                r, col = _top_integers(np.where(own, lowest, exact), ids, k, lowest)
                yield pd.DataFrame({"query_id": q_ids[at + r], "part": np.full(len(r), t["block"]),
                                    "vec_id": ids[col], "score": exact[r, col]})

    lists = grid.mapInPandas(search, "query_id long, part long, vec_id long, score long")
    return merge_tree(lists, k, n_shards)


def _top_integers(scores: np.ndarray, ids: np.ndarray, k: int, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """``top_of_rows`` for integers (``lowest`` takes no part)."""
    if not scores.size or np.abs(scores[scores != lowest]).max(initial=0) < EXACT:
        return top_of_rows(np.where(scores == lowest, -np.inf, scores), ids, k)
    out = [(i, j) for i, row in enumerate(scores)
           for j in np.lexsort((ids, -row.astype(object)))[:k + 1] if row[j] != lowest]
    keep, seen = [], {}
    for i, j in out:
        seen[i] = seen.get(i, 0) + 1
        if seen[i] <= k:
            keep.append((i, j))
    a = np.array(keep, dtype=np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]
