"""Source divergence audit: in-mapper stripes.

Every partition folds its whole documents into hash stripes, term -> (document
frequency, occurrences per source), and hands them on when they hold
``STRIPE_CELLS`` counts or the partition ends (a term may be handed on several
times). The stripes are merged by (language, term); the merged stripes of the
kept terms are written once, and the divergences of source pairs and of single
terms come from them, without the documents.

Rules. A null text, language or source counts as ''. A term is a maximal run
of ASCII letters and characters beyond ASCII, with A-Z lower-cased. Every
(language, source) that occurs is a group, also without terms. Repeated rows
count as often as they occur; other columns of the input are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import materialize
from scriptorium.llm.ngrams import Prefixes, class_table, number_texts, runs, slices, text_blocks, text_bytes

LEAST_DOCS = 10            # documents of a language that must hold a kept term
SCALE = 1_000_000_000
STRIPE_CELLS = 300_000     # counts that a partition holds before it hands its stripes on
BLOCK_BYTES = 2 << 20      # bytes of text folded at a time
TILE_SOURCES = 64          # sources on either side of a tile
TILE_TERMS = 16_384        # about so many terms in a tile
TERM = class_table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_CELL = "array<struct<source: string, n: bigint>>"
_STRIPES = f"lang string, term string, cells {_CELL}"


class Stripes:
    """language -> term -> {source: occurrences, None: documents}."""

    def __init__(self):
        self.held: dict[str, dict[bytes, dict]] = {}
        self.cells = 0

    def add(self, lang: str, texts: list[bytes], sources: list[str]) -> None:
        """Fold whole documents of one language."""
        held = self.held.setdefault(lang, {})
        names, source = np.unique(np.array(sources, dtype=object), return_inverse=True)
        names = names.tolist()
        for block, raw, bound in text_blocks(texts, BLOCK_BYTES):
            start, end = runs(TERM[raw])
            if not len(start):
                continue
            number, first = number_texts(raw, Prefixes(raw).fingerprints(start, end), start, end)
            doc = np.searchsorted(bound, start, side="right") - 1
            # one row per (term, document), then per (term, source)
            pair, times = np.unique(number.astype(np.int64) * len(block) + doc, return_counts=True)
            term, doc = np.divmod(pair, len(block))
            docs = np.bincount(term, minlength=len(first)).tolist()
            cell, back = np.unique(term * len(names) + source[block[0] + doc], return_inverse=True)
            count = np.bincount(back, weights=times).astype(np.int64).tolist()
            term, src = (x.tolist() for x in np.divmod(cell, len(names)))
            lo, hi = start[first].tolist(), end[first].tolist()
            data, last, stripe = raw.tobytes(), -1, None
            for t, s, n in zip(term, src, count):
                if t != last:
                    key, last = data[lo[t]:hi[t]], t
                    stripe = held.get(key)
                    if stripe is None:
                        stripe = held[key] = {None: 0}
                    before = len(stripe)
                    stripe[None] += docs[t]
                stripe[names[s]] = stripe.get(names[s], 0) + n
                self.cells += len(stripe) - before
                before = len(stripe)

    def take(self) -> Iterator[pa.RecordBatch]:
        """Hand the stripes on and forget them."""
        kind = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
        for lang, held in self.held.items():
            terms = list(held)
            for at in range(0, len(terms), 20_000):
                part = [held[t] for t in terms[at:at + 20_000]]
                offsets = np.cumsum([0, *map(len, part)])
                cells = pa.StructArray.from_arrays(
                    [pa.array([s for x in part for s in x], pa.string()), pa.array([n for x in part for n in x.values()], pa.int64())],
                    names=["source", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(terms[at:at + 20_000], pa.binary()).cast(pa.string()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells).cast(kind)], names=["lang", "term", "cells"])
        self.held, self.cells = {}, 0


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes = Stripes()
    for batch in (part for whole in batches for part in slices(whole)):
        by_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(batch["lang"].to_pylist()):
            by_lang.setdefault(lang, []).append(i)
        texts, sources = text_bytes(batch["text"]), batch["source"].to_pylist()
        for lang, at in by_lang.items():
            stripes.add(lang, [texts[i] for i in at], [sources[i] for i in at])
        if stripes.cells >= STRIPE_CELLS:
            yield from stripes.take()
    yield from stripes.take()


def merged_stripes(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(lang, term, docs, total, cells)`` of the kept terms: documents,
    occurrences, and occurrences per source (``docs`` has lang, source, text).

    One exchange by (lang, term): both aggregates below use its partitioning."""
    folded = docs.select("lang", "source", "text").mapInArrow(_fold, _STRIPES)
    cell = (folded.repartition("lang", "term").select("lang", "term", F.inline("cells"))
            .groupBy("lang", "term", "source").agg(F.sum("n").alias("n")))
    known = F.col("source").isNotNull()  # the cell without a source counts documents
    return (cell.groupBy("lang", "term")
                .agg(F.max(F.when(~known, F.col("n"))).alias("docs"), F.sum(F.when(known, F.col("n"))).alias("total"),
                     F.collect_list(F.when(known, F.struct("source", "n"))).alias("cells"))
                .where(F.col("docs") >= least_docs))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide((count + 2)) * wide(F.lit(SCALE)), wide(total + kept * 2))


def _source_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row per (lang, source) that occurs: occurrences of kept terms in it
    (``n``) and in its language (``lang_n``), kept terms of the language, and
    the source's place (``block``, ``at``) among the language's."""
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    per_source = kept.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    none = F.lit(0).cast("long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return (docs.select("lang", "source").distinct().join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
                .select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("n", "kept", "lang_n")], place.alias("place"))
                .select("*", F.expr(f"cast(place div {TILE_SOURCES} AS int)").alias("block"),
                        (F.col("place") % TILE_SOURCES).alias("at")))


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so 64 bits hold it."""
    d = p - q
    return d * d // (p + q)


_PARTS = "lang string, source string, item string, value bigint, seen bigint, rest bigint, kept bigint"


def _tile(key: tuple, cells: pa.Table, tiles: pa.Table) -> pa.Table:
    """Sums over the terms of one tile for all pairs of a source of one block
    with one of another. ``seen``: terms of the tile; ``rest``: what each term
    adds that occurs in neither block."""
    tile = tiles.to_pylist()[0]
    side = []
    number = np.zeros(0, np.int64)
    terms = 0
    if len(cells):
        codes = cells["term"].combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        number, terms = np.asarray(codes.indices), len(codes.dictionary)
    block, at, p = (np.asarray(cells[c]) for c in ("block", "at", "p"))
    for b, names, base in ((tile["b1"], tile["s1"], tile["p1"]), (tile["b2"], tile["s2"], tile["p2"])):
        m = np.repeat(np.array(base, np.int64)[None, :], terms, 0)
        mine = block == b
        m[number[mine], at[mine]] = p[mine]
        side.append((names, np.array(base, np.int64), m))
    (n1, base1, m1), (n2, base2, m2) = side
    out = {k: [] for k in ("source", "item", "value", "rest")}
    for i, name in enumerate(n1):
        sums = _divergence(m1[:, i, None], m2).sum(0).tolist()
        rest = _divergence(base1[i], base2).tolist()
        for j, other in enumerate(n2):
            if tile["b1"] == tile["b2"] and j <= i:
                continue
            for s, r in ((name, other), (other, name)):
                for k, v in zip(out, (s, r, sums[j], rest[j])):
                    out[k].append(v)
    n = len(out["source"])
    return pa.table({"lang": pa.array([tile["lang"]] * n, pa.string()), "source": pa.array(out["source"], pa.string()),
                     "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64()),
                     "seen": pa.array([terms] * n, pa.int64()), "rest": pa.array(out["rest"], pa.int64()),
                     "kept": pa.array([tile["kept"]] * n, pa.int64())})


def _pairs(cells: DataFrame, sources: DataFrame, salts: int) -> DataFrame:
    """``lang, source, item, value`` of all pairs of a language's sources.

    Sources stand in blocks of TILE_SOURCES; a tile is two blocks and a share
    of the terms. Only a term's cells in the two blocks travel to a tile;
    terms that occur in neither are added by their number."""
    base = _share(F.lit(0).cast("long"), F.col("n"), F.col("kept"))
    # kept = 0 leaves no term and no share: any number will do there
    base = F.when(F.col("kept") > 0, base).otherwise(F.lit(1))
    block = (sources.groupBy("lang", "block", "kept")
                    .agg(F.array_sort(F.collect_list(F.struct("at", "source", base.alias("p")))).alias("s")))
    one, two = (block.select(F.col("lang").alias(f"l{k}"), F.col("block").alias(f"b{k}"), F.col("s.source").alias(f"s{k}"),
                             F.col("s.p").alias(f"p{k}"), F.col("kept").alias(f"k{k}")) for k in (1, 2))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    tiles = (one.join(two, (F.col("l1") == F.col("l2")) & (F.col("b1") <= F.col("b2")))
                .select(F.col("l1").alias("lang"), "b1", "b2", "s1", "p1", "s2", "p2", F.col("k1").alias("kept"), every))
    blocks = sources.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    place = cells.join(blocks, "lang").select(
        "lang", "term", "block", "at", "p", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt"),
        F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    place = place.select("lang", "term", "block", "at", "p", "salt", F.least("block", "other").alias("b1"),
                         F.greatest("block", "other").alias("b2"))
    keys = ["lang", "b1", "b2", "salt"]
    part = place.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(_tile, _PARTS)
    value = F.sum("value") + (F.first("kept") - F.sum("seen")) * F.first("rest")
    return part.groupBy("lang", "source", "item").agg(value.cast("long").alias("value"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      least_docs: int = LEAST_DOCS, top_terms: int = 10) -> DataFrame:
    """Divergence of every source from the other sources of its language (part
    ``pair``: item is the other source, all ranks) and its ``top_terms`` terms
    most over-used against the language (part ``term``): ``lang, source, part,
    item, value, rank``, ranks by value descending, then item."""
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs = docs.select(empty(lang_col, "lang"), empty(source_col, "source"), empty(text_col, "text"))
    kept = materialize(merged_stripes(docs, least_docs), "stripes")
    sources = materialize(_source_table(docs, kept), "sources")
    cells = (kept.select("lang", "term", "total", F.inline("cells"))
                 .withColumnRenamed("n", "count")
                 .join(sources, ["lang", "source"])
                 .select("lang", "source", "term", "block", "at", _share(F.col("count"), F.col("n"), F.col("kept")).alias("p"),
                         _share(F.col("total"), F.col("lang_n"), F.col("kept")).alias("q")))
    salts = 1 + kept.count() // TILE_TERMS
    pairs = _pairs(cells, sources, salts)
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), F.asc("item"))).cast("int")
    gap = F.col("p") - F.col("q")
    terms = (cells.where("p > q").select("lang", "source", F.col("term").alias("item"),
                                         F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))
             # first inside shares of a group's terms, then among what is left of each
             .withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
             .withColumn("rank", best("lang", "source", "_salt")).where(F.col("rank") <= top_terms)
             .withColumn("rank", best("lang", "source")).where(F.col("rank") <= top_terms))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("rank", best("lang", "source")).withColumn("part", F.lit("pair")).select(*cols)
                 .unionByName(terms.withColumn("part", F.lit("term")).select(*cols)))
