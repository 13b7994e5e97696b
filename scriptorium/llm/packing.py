"""Conflict-constrained best-fit packing.

Documents are cut to bins of a fixed number of words. A bin holds at most one
piece of a source and one of a duplicate cluster; it carries both sets as
bitmaps. Pieces are placed in falling size: the successor search starts at the
tightest bin that has room and goes on through the bins, ordered by residual
space, until one has no conflict; if none is left, a new bin is opened.

Best fit is sequential, so documents are hashed to shards of bounded size and
every shard is packed on its own: its bins are its own, too. Only ids and
sizes travel, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import materialize

CAPACITY = 2048
SHARD_PIECES = 8192
SCHEMA = ("doc_id long, piece int, words long, bin_id string, bin_offset long, source string, cluster string")


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every piece ``(size, source, cluster)``, taken in the
    given order; source and cluster are small numbers, -1 for none."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []            # bitmaps by bin
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
            sources[b] |= s
            clusters[b] |= c
        else:
            residual, b = capacity, len(sources)
            sources.append(s)
            clusters.append(c)
        out.append((b, capacity - residual))
        insort(order, (residual - size, b))
    return out


def _numbers(values: list, shared_only: bool) -> list[int]:
    """Each value as a small number, null as -1; with ``shared_only`` values
    that occur once get -1 as well (they cannot conflict)."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    number: dict = {}
    return [-1 if v is None or (shared_only and count[v] == 1) else number.setdefault(v, len(number)) for v in values]


def pack(docs: DataFrame, words: Column, cluster: Column, id_col: str = "doc_id", source_col: str = "source",
         capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: ``doc_id, piece, words, bin_id, bin_offset, source,
    cluster``. A document of more than ``capacity`` words is cut into pieces of
    ``capacity`` and a rest; one without words is a piece of 0 words.

    ``cluster`` names a row's duplicate cluster. A null source or cluster
    conflicts with nothing, except that pieces of one document never share a
    bin. Repeated rows are documents of their own. The result depends on the
    rows only, not on their order or partitions.
    """
    d = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(words, F.lit(0)).cast("long").alias("n"),
                    F.col(source_col).cast("string").alias("source"), cluster.cast("string").alias("cluster")), "sizes")
    n_pieces = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("long")
    count = d.agg(F.coalesce(F.sum(n_pieces), F.lit(0))).first()[0]
    shards = max(1, -(-count // shard_pieces))
    p = (d.withColumn("piece", F.explode(F.sequence(F.lit(0), (n_pieces - 1).cast("int"))))
          .withColumn("words", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity))
          .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit("pack")), F.lit(shards))))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (-r["words"], r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["n"],
                                 r["source"] or "", r["cluster"] or ""))
        # pieces of one document conflict like a cluster of its own
        source = _numbers([r["source"] for r in rows], False)
        group = [r["cluster"] if r["cluster"] is not None else (r["doc_id"], r["n"]) if r["n"] > capacity else None for r in rows]
        placed = best_fit([(r["words"], s, c) for r, s, c in zip(rows, source, _numbers(group, True))], capacity)
        shard = rows[0]["shard"]
        return pa.Table.from_pydict({
            "doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()),
            "piece": pa.array([r["piece"] for r in rows], pa.int32()),
            "words": pa.array([r["words"] for r in rows], pa.int64()),
            "bin_id": pa.array([f"{shard}-{b}" for b, _ in placed], pa.string()),
            "bin_offset": pa.array([o for _, o in placed], pa.int64()),
            "source": pa.array([r["source"] for r in rows], pa.string()),
            "cluster": pa.array([r["cluster"] for r in rows], pa.string())})

    return p.groupBy("shard").applyInArrow(run, SCHEMA)
