"""Approximate nearest neighbours (largest inner product) by multi-index
hashing of learned binary codes.

Vectors are scaled by the largest length and get one more component that
makes them unit vectors, so that the largest inner product is the smallest
angle. Codes are signs after learned rotations (iterative quantisation, fitted
on a bounded sample). A code is cut into substrings and a shard indexes its
codes by the value of every substring. A query probes, in each substring, all
values within the radius that the pigeonhole principle gives, which retrieves
every code within the Hamming radius; complete distances are verified and the
survivors are reranked by their inner product in double precision.

The radius is learned too: the smallest at which the sample's own neighbours
are retrieved at the wanted rate. Neighbours in the whole table are nearer
than those in a sample, so recall there is not lower. A query with too few
codes within the radius is searched at growing radii until it has enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bounded_batches, materialize
from scriptorium.llm.vectors import blocks, merge_tree, per_batch_rows, tiles, unpack, valid_vectors

SAMPLE = 4096        # vectors that the rotations and the radius are fitted on, at most
SHARD_ROWS = 8192
QUERY_ROWS = 1024
ROTATIONS = 2
SUBSTRING = 16       # bits of a substring
RECALL = 0.97        # share of the sample's neighbours within the radius


def unit(v: np.ndarray, longest: float) -> np.ndarray:
    """Rows divided by ``longest``, with the component that makes them units."""
    x = v / longest
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1, keepdims=True)))])


def fit_rotations(x: np.ndarray, n: int = ROTATIONS, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """n rotations side by side (dim x n*dim): each from a random start, turned
    towards the signs of the data by alternating Procrustes steps."""
    rng, d, out = np.random.default_rng(seed), x.shape[1], []
    for _ in range(n):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        out.append(r)
    return np.hstack(out)


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Sign codes as 16-bit substrings (rows x substrings); a last short
    substring is filled with zero bits."""
    bits = (x @ rotation > 0).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % SUBSTRING)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u2")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Complete Hamming distances of code a to each row of b."""
    return np.bitwise_count(b ^ a).sum(axis=-1, dtype=np.int32)


def substring_radii(radius: int, m: int) -> list[int]:
    """Radius r = m*a + b: a code within r is within a in one of the first
    b + 1 substrings or within a - 1 in one of the others."""
    a, b = divmod(radius, m)
    return [a if j <= b else a - 1 for j in range(m)]


class SubstringIndex:
    """Rows of a shard by the value of each substring."""

    def __init__(self, code: np.ndarray):
        self.code, self.tables = code, []
        for j in range(code.shape[1]):
            order = np.argsort(code[:, j], kind="stable")
            values, start = np.unique(code[order, j], return_index=True)
            self.tables.append((values, np.append(start, len(order)), order))

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """All rows at complete distance <= radius, ascending."""
        found = np.zeros(len(self.code), dtype=bool)
        for (values, start, order), part, r in zip(self.tables, q, substring_radii(radius, len(q))):
            if r >= 0:  # the values of the ball that the table holds
                hit = np.bitwise_count(values ^ part) <= r
                found[order[np.repeat(hit, np.diff(start))]] = True
        rows = np.flatnonzero(found)
        return rows[distances(q, self.code[rows]) <= radius]


def fit_radius(x: np.ndarray, v: np.ndarray, code: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Smallest radius that holds ``recall`` of the k largest inner products
    among the sample's rows (every 8th row asks)."""
    if len(v) < 2:
        return code.shape[1] * SUBSTRING
    out = []
    for i in range(0, len(v), 8):
        s = v @ v[i]
        s[i] = -np.inf
        near = np.argpartition(-s, min(k, len(s) - 1) - 1)[:min(k, len(s) - 1)]
        out.append(distances(code[i], code[near]))
    d = np.sort(np.concatenate(out))
    return int(d[min(len(d) - 1, int(np.ceil(recall * len(d))) - 1)])


def fit(rows: DataFrame, k: int, sample: int = SAMPLE) -> dict:
    """Model from at most ``sample`` rows (those with the smallest hash of the
    id); the largest length is taken over all rows."""
    dim, sq = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)),
                       F.coalesce(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0))).first()
    taken = rows.orderBy(F.xxhash64("vec_id", F.lit("fit")), "vec_id").limit(sample).collect()
    v = np.zeros((len(taken), dim))
    for i, r in enumerate(taken):
        v[i, :len(r["v"])] = r["v"]
    longest = float(np.sqrt(sq)) or 1.0
    x = unit(v, longest) if len(v) else np.zeros((0, dim + 1))
    rotation = fit_rotations(x) if len(v) else np.eye(dim + 1)
    code = codes(x, rotation)
    return {"dim": dim, "longest": longest, "rotation": rotation, "radius": fit_radius(x, v, code, k)}


def approximate_top_k(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
                      vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of every row matching ``is_query``
    (a condition on ``vec_id``) the ``k`` nearest other rows found, score (inner product of the
    original vectors) descending, ties to the smaller id; all, if fewer.

    Every valid row is indexed (see ``valid_vectors``; zero vectors take no
    part either). Query blocks meet shards tile by tile, and the per-shard
    lists are merged in a tree. A shard with fewer than k codes within the
    radius widens it for that query until it has k or is exhausted.
    """
    bounded_batches(table.sparkSession, rows=1, mb=64)
    rows = materialize(valid_vectors(table, id_col, vec_col, drop_zero=True), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    model = fit(rows, k)
    dim = model["dim"]
    n_shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_rows))
    grid = tiles(blocks(rows.where(is_query), n_blocks, dim), blocks(rows, n_shards, dim), n_blocks, n_shards)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in per_batch_rows(batches):
            q_ids, q = unpack(t["q_ids"], t["q_vectors"], dim)
            ids, v = unpack(t["ids"], t["vectors"], dim)
            index = SubstringIndex(codes(unit(v, model["longest"]), model["rotation"]))
            q_codes = codes(unit(q, model["longest"]), model["rotation"])
            total = q_codes.shape[1] * SUBSTRING
            out = []
            for i, q_id in enumerate(q_ids):
                radius = model["radius"]
                while True:
                    near = index.within(q_codes[i], radius)
                    near = near[ids[near] != q_id]
                    if len(near) >= k or radius >= total:
                        break
                    radius = min(total, radius + max(1, total // 32))
                s = (v[near] * q[i]).sum(axis=1)
                best = np.lexsort((ids[near], -s))[:k]
                out.append((np.full(len(best), q_id), ids[near][best], s[best]))
            if out:
                a, b, c = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"query_id": a, "part": np.full(len(a), t["block"]), "vec_id": b, "score": c})

    lists = grid.mapInPandas(search, "query_id long, part long, vec_id long, score double")
    return merge_tree(lists, k, n_shards)
