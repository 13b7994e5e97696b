"""Substring dedup by recompression.

A text is parsed in rounds. The first round names runs of equal words, the
others name pairs: every symbol falls on a side by its own name, and a left
symbol merges with a right symbol that follows it. A name is a hash of what it
names, so all tasks give the same name to the same run or pair and no
dictionary has to be agreed on; the rounds of all texts run in parallel. What
a symbol becomes depends on its neighbours only, so equal substrings have
equal symbols except near their ends.

Symbols are at most MAX_SYMBOL words long and each round disturbs at most that
many words at either end, so every window of WINDOW words holds symbols that
its own words decide. Its anchor is the one of them with the smallest rank,
named together with the MARGIN words on either side (all inside the window).
Equal windows have equal anchors. Spark counts anchors over all documents;
only windows whose anchor is shared by two documents are named themselves
(128 bits, by naming pairs of halves), and the smallest document per window
name decides. Windows are never paired with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bounded_batches, materialize

WINDOW = 50
MAX_SYMBOL = 4
PAIR_ROUNDS = 3
MARGIN = MAX_SYMBOL * (1 + PAIR_ROUNDS)          # words disturbed at either end of a window
CHOICES = WINDOW - 2 * MARGIN - MAX_SYMBOL + 1   # places where a window's anchor can start
PIECE = 1 << 18                                  # windows of one text that are parsed together
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
POS_BITS = np.uint64(32)
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _name(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Name of the pair (a, b) at a level."""
    return _mix(_mix(a + np.uint64(level * 2 + 1)) + b)


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of every text, two 64-bit names of every word, and the number
    of words of every text. Words of up to 16 bytes are named from their bytes
    and length, longer ones by XXH3 (128 bits)."""
    joined = b" ".join([b"", *texts, bytes(16)])
    raw = np.frombuffer(joined, np.uint8)[:-16]
    space = SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # the first and the last byte are spaces
    start, end = edge[::2], edge[1::2]
    length = end - start
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))  # the 8 bytes from every byte on
    low = eight[start] & FIRST_BYTES[np.minimum(length, 8)]
    high = eight[start + np.minimum(length, 8)] & FIRST_BYTES[np.clip(length - 8, 0, 8)]
    n = length.astype(np.uint64)
    a, b = _name(_name(low, high, 500), n, 501), _name(_name(high, low, 502), n, 503)
    long = np.flatnonzero(length > 16)
    digests = b"".join([xxhash.xxh3_128_digest(joined[i:j]) for i, j in zip(start[long].tolist(), end[long].tolist())])
    a[long], b[long] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])   # where texts start
    first = np.searchsorted(start, at)
    return first[:-1], a, b, np.diff(first)


class Batch:
    """Words of some texts laid end to end, cut into pieces that overlap by a
    window less one word, so that every window lies in exactly one piece."""

    def __init__(self, texts: list[bytes]):
        first, a, b, self.n_words = word_names(texts)
        pieces = [(i, at) for i, n in enumerate(self.n_words.tolist()) for at in range(0, n - WINDOW + 1, PIECE)]
        self.owner, self.offset = (np.array(x, np.int64) for x in (zip(*pieces) if pieces else ((), ())))
        size = np.minimum(PIECE + WINDOW - 1, self.n_words[self.owner] - self.offset)
        self.base = np.concatenate(([0], np.cumsum(size)))
        flat = np.arange(self.base[-1]) + np.repeat(first[self.owner] + self.offset - self.base[:-1], size)
        self.a, self.b = a[flat], b[flat]
        self.piece = np.repeat(np.arange(len(pieces)), size)

    def parse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols after all rounds: name, first word, number of words."""
        name, piece = self.a, self.piece
        n = len(name)
        start, length = np.arange(n), np.ones(n, np.int64)
        if n:  # runs
            new = np.concatenate(([True], (name[1:] != name[:-1]) | (piece[1:] != piece[:-1])))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, n))
            merge = (count > 1) & (count <= MAX_SYMBOL)
            keep = new | ~np.repeat(merge, count)  # longer runs stay single symbols
            named = np.where(merge, _name(name[first], count.astype(np.uint64), 0), name[first])
            name = np.where(new, np.repeat(named, count), name)[keep]
            length = np.where(new, np.repeat(np.where(merge, count, 1), count), 1)[keep]
            start, piece = start[keep], piece[keep]
        for level in range(1, PAIR_ROUNDS + 1):
            if len(name) < 2:
                break
            left = (_mix(name + np.uint64(level)) & np.uint64(1)).astype(bool)
            join = (left[:-1] & ~left[1:] & (piece[1:] == piece[:-1]) & (length[:-1] + length[1:] <= MAX_SYMBOL))
            first = np.append(join, False)
            name = np.where(first, _name(name, np.append(name[1:], NONE), level), name)
            length = np.where(first, length + np.append(length[1:], 0), length)
            keep = np.concatenate(([True], ~join))
            name, start, length, piece = name[keep], start[keep], length[keep], piece[keep]
        return name, start, length

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every window: its piece, first word, and anchor (an index of the
        distinct anchors), and the anchors' names."""
        n = len(self.a)
        if n < WINDOW:
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros(0, np.uint64)
        name, start, length = self.parse()
        rank = np.full(n, NONE)
        rank[start] = (_mix(name ^ np.uint64(0x5851F42D4C957F2D)) >> POS_BITS << POS_BITS) | start.astype(np.uint64)
        # smallest rank (leftmost of equal ones) in CHOICES places, by doubling
        low, span = rank, 1
        while span * 2 <= CHOICES:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:len(low) - (CHOICES - span)], low[CHOICES - span:])
        w = np.flatnonzero(self.piece[:n - WINDOW + 1] == self.piece[WINDOW - 1:])
        at = (low[w + MARGIN] & ((np.uint64(1) << POS_BITS) - np.uint64(1))).astype(np.int64)
        place, index = np.unique(at, return_inverse=True)
        of = np.full(n, -1)
        of[start] = np.arange(len(start))
        side, span = self.a, 1  # names of MARGIN words in a row
        while span < MARGIN:
            side = _name(side[:-span], side[span:], 64 + span)
            span *= 2
        s = of[place]
        key = _name(_name(side[place - MARGIN], name[s], 200), side[place + length[s]], 201)
        return self.piece[w], w, index, key

    def window_names(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the windows that start at words ``w``."""
        out = []
        for h in (self.a, self.b):
            by = {1: h}
            span = 1
            while span * 2 <= WINDOW:
                by[span * 2] = _name(by[span][:-span], by[span][span:], 300 + span)
                span *= 2
            name, at = None, 0
            for span in sorted(by, reverse=True):
                if WINDOW & span:
                    part = by[span][w + at]
                    name = part if name is None else _name(name, part, 400 + span)
                    at += span
            out.append(name)
        return out[0], out[1]


assert MARGIN & (MARGIN - 1) == 0 and CHOICES >= MAX_SYMBOL


def _rows(table: pa.RecordBatch, column: int = 1) -> list[bytes]:
    return [t or b"" for t in table.column(column).cast(pa.binary()).to_pylist()]


def shared_anchors(docs: DataFrame) -> DataFrame:
    """``doc_id, keys, later``: for each document the names of its anchors
    that another document has as well, and of those that a document with a
    smaller id has (documents without any are left out)."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            ids = np.array(table.column(0).to_pylist(), np.int64)
            batch = Batch(_rows(table))
            piece, _, index, key = batch.anchors()
            if len(piece):
                of = np.empty(len(key), np.int64)  # an anchor lies in one piece
                of[index] = batch.owner[piece]
                pairs = np.unique(np.stack([of, key.view(np.int64)], 1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_pydict({"key": pa.array(pairs[:, 1]), "doc_id": pa.array(ids[pairs[:, 0]])})

    found = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(anchors, "key long, doc_id long")
    shared = materialize(found.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                              .where("lo < hi").select("key", "lo"), "anchors")
    return (found.join(shared, "key").groupBy("doc_id")
                 .agg(F.collect_list("key").alias("keys"),
                      F.collect_list(F.when(F.col("doc_id") > F.col("lo"), F.col("key"))).alias("later")))


PASS_SCHEMA = "doc_id long, rid int, n_words long, full_sha256 string, packed binary, at int, later boolean, h1 long, h2 long"
OUT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"


def _windows(with_keys: DataFrame) -> DataFrame:
    """One row per document (``at`` null; the packed text only if an anchor is
    shared) and one per window under a shared anchor; ``later`` if a document
    with a smaller id has the anchor, without which the window cannot repeat one."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PASS_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for table in batches:
            ids, packed, keys, later = (table.column(i).to_pylist() for i in range(4))
            texts = [unpack.decompress(p) for p in packed]
            rid = [xxhash.xxh32_intdigest(t) - (1 << 31) for t in texts]
            words = [t.split() for t in texts]
            full = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            n_words = [len(w) for w in words]
            del words
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                (ids, rid, n_words, full, [p if k else None for p, k in zip(packed, keys)], *[[None] * len(ids)] * 4), types)], names)
            some = [i for i, k in enumerate(keys) if k]
            batch = Batch([texts[i] for i in some])
            piece, w, index, key = batch.anchors()
            if not len(piece):
                continue
            # a window counts if its anchor is among its document's shared ones
            of = np.empty(len(key), np.int64)
            of[index] = batch.owner[piece]
            pairs = np.stack([of.astype(np.uint64), key], 1)
            as_rows = lambda x: np.ascontiguousarray(x).view("V16").ravel()

            def among(lists: list[list[int]]) -> np.ndarray:
                wanted = [np.stack([np.full(len(lists[i]), j, np.uint64), np.array(lists[i], np.int64).view(np.uint64)], 1)
                          for j, i in enumerate(some)]
                return np.isin(as_rows(pairs), as_rows(np.concatenate(wanted)))[index]

            hit = among(keys)
            w, d, repeats = w[hit], batch.owner[piece[hit]], among(later)[hit]
            if not len(w):
                continue
            at = w - batch.base[piece[hit]] + batch.offset[piece[hit]]
            h1, h2 = batch.window_names(w)
            for lo in range(0, len(w), 1 << 17):
                s = slice(lo, lo + (1 << 17))
                doc = np.array(some)[d[s]]
                none = pa.nulls(len(doc), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(ids)[doc].astype(np.int64)), pa.array(np.array(rid, np.int32)[doc]), none,
                    pa.nulls(len(doc), pa.string()), pa.nulls(len(doc), pa.binary()), pa.array(at[s].astype(np.int32)),
                    pa.array(repeats[s]), pa.array(h1[s].view(np.int64)), pa.array(h2[s].view(np.int64))], names)

    return with_keys.select("doc_id", "packed", "keys", "later").mapInArrow(run, PASS_SCHEMA)


def _pack(docs: DataFrame) -> DataFrame:
    """Texts as compressed bytes: what a shuffle moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for table in batches:
            yield pa.RecordBatch.from_arrays([table.column(0), pa.array([pack.compress(t) for t in _rows(table)], pa.binary())],
                                             ["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary")


def _finish(rows: DataFrame) -> DataFrame:
    """Cut the covered words out of the packed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for table in batches:
            out = []
            for doc_id, packed, starts in zip(*(table.column(i).to_pylist() for i in range(3))):
                words = unpack.decompress(packed).split()
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.array(starts or [], np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                [c.split()[0] for c in OUT_SCHEMA.split(", ")]) if out else pa.RecordBatch.from_pylist([], pa.schema(
                    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    return rows.select("doc_id", "packed", "starts").mapInArrow(run, OUT_SCHEMA)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, kept``.

    A word goes if a window of 50 consecutive words that covers it also starts
    in a document with a smaller id. ``kept`` is the rest, joined by single
    spaces, of documents that share an anchor with another, else null (nothing
    is removed there). A null text has no words. A row without an id is no
    source of repeats and loses nothing. Rows that repeat an id are not
    repeats of each other.
    """
    bounded_batches(docs.sparkSession, rows=1000, mb=2)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = materialize(_windows(_pack(d).join(shared_anchors(d).hint("shuffle_hash"), "doc_id", "left")), "windows")
    found = seen.where(F.col("at").isNotNull()).select("doc_id", "rid", "at", "later", "h1", "h2")
    first = materialize(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                             .where("lo < hi").select("h1", "h2", "lo"), "repeats")
    starts = (found.where("later").drop("later").join(first, ["h1", "h2"]).where(F.col("doc_id") > F.col("lo"))
                   .groupBy("doc_id", "rid").agg(F.collect_list("at").alias("starts")))
    texts = seen.where(F.col("at").isNull())
    cut = texts.where(F.col("packed").isNotNull()).select("doc_id", "rid", "packed")
    cut = _finish(cut.join(starts.hint("shuffle_hash"), ["doc_id", "rid"], "left"))
    whole = texts.where(F.col("packed").isNull()).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("full_sha256").alias("kept_sha256"),
        F.lit(None).cast("binary").alias("kept"))
    return whole.unionByName(cut)
