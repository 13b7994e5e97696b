"""Phrase collocation mining by Rabin-Karp fingerprints.

1. Partitions lay their texts end to end, lower-cased and with one space
   between the words of a piece, and hash every 1- and 2-gram from numpy prefix
   polynomials. Equal fingerprints are counted in the partition; the shuffle
   adds up a language's fingerprints and keeps what occurs often enough. A
   collision can only raise such a count, so no frequent phrase is lost.
2. The kept fingerprints go into a filter of a fixed number of bits, which is
   all that is broadcast. The texts are read again: where the filter holds an
   n-gram's fingerprint, all its occurrences in a block are compared, byte by
   byte, with the one that the fingerprint's pointer names, and the phrase is
   cut from the text at that pointer. Phrases are then counted by their text, so
   neither a collision nor a chance hit of the filter is left in any number.
   When the filter fills up, more n-grams are materialised and dropped by
   their count; the result stays the same.
3. 3-grams go the same way, only where both their 2-grams pass the filter of 2.

Scores, containment and ranks are joins over the frequent phrases, in exact
decimal arithmetic.

Rules. A null text is empty, a null language is ``und``. Pieces end at
``. , ; : ! ?`` and line breaks, words at spaces and tabs, only A-Z are
lower-cased. Repeated rows count as often as they occur, other columns of the
input are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import materialize
from scriptorium.llm.ngrams import Prefixes, number_texts, runs, slices, text_blocks, text_bytes

LEAST = 10                 # occurrences of a candidate
TOP = 2000                 # phrases returned of a language
BLOCK_BYTES = 1 << 20      # bytes of text hashed at a time
HELD = 1_000_000           # fingerprints that a partition holds before it hands them on
TEXTS_HELD = 200_000       # phrases likewise
FILTER_BITS = 1 << 26      # 8 MB
FILTER_PROBES = 3

# What ends a piece, and what ends a word inside a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

KIND = np.zeros(256, np.uint8)  # 0 word, 1 blank, 2 end of a piece
KIND[list(BLANKS)] = 1
KIND[list(PIECE_ENDS)] = 2

_WORD_END = re.compile(rb"[ \t.,;:!?\n\x0b-\r]")
_TWO_WORDS = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n\x0b-\r]+){0,2}")

_COUNTS = "fp bigint, n bigint"
_PHRASES = "lang string, phrase string, n bigint"


class Words:
    """Words of a block of texts, each piece's words one space apart. N-grams
    that start in a stretch of ``beyond`` are counted elsewhere."""

    def __init__(self, raw: np.ndarray, beyond: list[tuple[int, int]]):
        start, end = runs(KIND[raw] == 0)
        self.own = np.ones(len(start), bool)
        for lo, hi in beyond:
            self.own[np.searchsorted(start, lo):np.searchsorted(start, hi)] = False
        ends = np.cumsum(KIND[raw] == 2, dtype=np.int32)
        piece = ends[start] if len(start) else ends[:0]
        inside = KIND[raw] == 0
        last = end[:-1][piece[1:] == piece[:-1]]  # the byte after a word that another one of its piece follows
        keep = inside.copy()
        keep[last] = True
        raw = np.where(inside, raw, 32).astype(np.uint8)
        place = np.cumsum(keep) - 1
        self.raw = raw[keep]
        self.start, self.end = place[start], place[end - 1] + 1
        self.piece = piece

    def grams(self, n: int, own: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, start and end of all n-grams (``own``: of the block's own)."""
        size = len(self.start) - n + 1
        if size <= 0:
            return (np.zeros(0, np.int64),) * 3
        first = np.flatnonzero((self.piece[:size] == self.piece[n - 1:]) & (self.own[:size] | (not own)))
        return first, self.start[first], self.end[first + n - 1]


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, Words]]:
    """Blocks of a batch's texts by language."""
    for part in slices(batch):
        by_lang: dict[str, list[tuple[bytes, int]]] = {}
        for lang, text in zip(part["lang"].to_pylist(), text_bytes(part["text"])):
            by_lang.setdefault(lang, []).extend(_stretches(text))
        for lang, parts in by_lang.items():
            for numbers, raw, bound in text_blocks([p[0] for p in parts], BLOCK_BYTES):
                beyond = [(int(b) + parts[i][1], int(b) + len(parts[i][0])) for i, b in zip(numbers, bound)
                          if parts[i][1] < len(parts[i][0])]
                yield lang, Words(raw, beyond)


def _stretches(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text in stretches of about a block that end where a word does, each
    with up to two more words behind it, and its size without these."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        end = _WORD_END.search(text, at + BLOCK_BYTES)
        if end is None:
            break
        more = _TWO_WORDS.match(text, end.start())
        yield text[at:more.end()], end.start() - at
        at = end.start()
    yield text[at:], len(text) - at


def _own(fp: np.ndarray, lang: str, words: int) -> np.ndarray:
    """Fingerprints of one language's n-grams, apart from those of others."""
    h = fp ^ np.uint64((zlib.crc32(lang.encode("utf-8", "surrogatepass")) * 4 + words) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _bits(fp: np.ndarray) -> list[np.ndarray]:
    """Bits of the filter for fingerprints."""
    h, out = fp, []
    for _ in range(FILTER_PROBES):
        out.append((h % np.uint64(FILTER_BITS)).astype(np.int64))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out


def passes(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the fingerprints."""
    out = np.ones(len(fp), bool)
    for b in _bits(fp):
        out &= (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 != 0
    return out


class Counts:
    """Fingerprint counts of a partition, handed on when there are many."""

    def __init__(self):
        self.parts: list = []
        self.held = 0

    def add(self, fp: np.ndarray) -> None:
        fp, n = np.unique(fp, return_counts=True)
        self.parts.append((fp, n))
        self.held += len(fp)

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            fp = np.concatenate([p[0] for p in self.parts])
            by = np.argsort(fp)
            fp, n = fp[by], np.concatenate([p[1] for p in self.parts])[by]
            first = np.flatnonzero(np.concatenate((np.ones(min(len(fp), 1), bool), fp[1:] != fp[:-1])))
            fp, n = fp[first].view(np.int64), np.add.reduceat(n, first) if len(first) else n
            for at in range(0, len(fp), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(fp[at:at + 100_000]), pa.array(n[at:at + 100_000])], names=["fp", "n"])
        self.parts, self.held = [], 0


class Texts:
    """Phrase counts of a partition by language and text, handed on when there are many."""

    def __init__(self):
        self.parts: list[pa.Table] = []
        self.held = self.whole = 0

    def add(self, lang: str, phrase: pa.Array, n: np.ndarray) -> None:
        self.parts.append(pa.table({"lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(phrase), np.int32))),
                                    "phrase": phrase, "n": pa.array(n)}))
        self.held += len(phrase)
        if self.held >= TEXTS_HELD + 2 * self.whole:
            t = self._sum()
            self.parts, self.held, self.whole = [t], len(t), len(t)

    def _sum(self) -> pa.Table:
        t = pa.concat_tables(self.parts).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
        return t.rename_columns({"n_sum": "n"}).select(["lang", "phrase", "n"])

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self._sum().to_batches(max_chunksize=100_000)
        self.parts, self.held, self.whole = [], 0, 0


def _count(orders: tuple[int, ...], both=None):
    """Counts of n-gram fingerprints; of 3-grams, those whose 2-grams pass the
    filter ``both`` (a broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for lang, words in blocks(batch):
                hashes = Prefixes(words.raw)
                if both is not None:
                    first, start, end = words.grams(2, own=False)
                    good = np.zeros(len(words.start) + 1, bool)
                    good[first] = passes(both.value, _own(hashes.fingerprints(start, end), lang, 2))
                for n in orders:
                    first, start, end = words.grams(n)
                    if both is not None:
                        keep = good[first] & good[first + 1]
                        start, end = start[keep], end[keep]
                    counts.add(_own(hashes.fingerprints(start, end), lang, n))
                if counts.held >= HELD:
                    yield from counts.take()
        yield from counts.take()

    return run


def _cut(orders: tuple[int, ...], wanted):
    """Phrases whose fingerprints pass the filter ``wanted`` (a broadcast),
    counted by text; with 1-grams also the number of words, as phrase ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts()
        for batch in batches:
            for lang, words in blocks(batch):
                hashes = Prefixes(words.raw)
                for n in orders:
                    _, start, end = words.grams(n)
                    if n == 1:
                        texts.add(lang, pa.array([""]), np.array([len(start)]))
                    fp = hashes.fingerprints(start, end)
                    keep = passes(wanted.value, _own(fp, lang, n))
                    start, end = start[keep], end[keep]
                    number, first = number_texts(words.raw, fp[keep], start, end)
                    texts.add(lang, _strings(words.raw, start[first], end[first]), np.bincount(number, minlength=len(first)))
                if texts.whole >= TEXTS_HELD:
                    yield from texts.take()
        yield from texts.take()

    return run


def _strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches as strings, without a step per row."""
    length = end - start
    offsets = np.concatenate(([0], np.cumsum(length)))
    place = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[place]))


def _filter(kept: DataFrame):
    """Broadcast filter over ``fp``. The bits are set by Spark, so the driver
    gets at most FILTER_BITS / 64 numbers, whatever the table holds."""
    spark = kept.sparkSession

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_bits(np.asarray(batch["fp"]).view(np.uint64))))
            first = np.flatnonzero(np.diff(at >> 6, prepend=-1))
            bit = np.bitwise_or.reduceat(np.left_shift(np.int64(1), at & 63), first) if len(first) else at
            yield pa.RecordBatch.from_arrays([pa.array(at[first] >> 6), pa.array(bit)], names=["at", "bit"])

    got = (kept.select("fp").mapInArrow(bits, "at bigint, bit bigint")
               .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[np.asarray(got["at"].combine_chunks())] = np.asarray(got["bits"].combine_chunks())
    return spark.sparkContext.broadcast(out.view(np.uint8))


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(lang, words, phrase, n)`` of all phrases of 1 to 3 words that occur
    at least ``least`` times in their language, and ``(lang, n)``, the words
    of each language (``docs`` has lang, text)."""
    docs = docs.select("lang", "text")

    # partitions have added up what they hold: dealt out first, nothing is added up again before the exchange
    def often(orders: tuple[int, ...], both=None) -> DataFrame:
        counts = docs.mapInArrow(_count(orders, both), _COUNTS).repartition("fp")
        return materialize(counts.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "grams")

    def by_text(orders: tuple[int, ...], wanted) -> DataFrame:
        counts = docs.mapInArrow(_cut(orders, wanted), _PHRASES).repartition("lang", "phrase")
        return materialize(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
                                 .where((F.col("n") >= least) | (F.col("phrase") == "")), "phrases")

    two = _filter(often((1, 2)))
    short = by_text((1, 2), two)
    long = by_text((3,), _filter(often((3,), two)))
    size = F.size(F.split("phrase", " ")).alias("words")
    phrases = short.where("phrase <> ''").unionByName(long).select("lang", size, "phrase", "n")
    return phrases, short.where("phrase = '' AND n > 0").select("lang", "n")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of 2 and 3 words of each language: ``lang, rank,
    phrase, a, l, r, n, score`` (long). ``a`` occurrences; ``l`` and ``r``
    those of the two parts of the cut with the lowest score, which is
    floor(1000000 * a * a / (l * r)); ``n`` words of the language."""
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    phrases, words = frequent_phrases(docs, least)
    part = phrases.select(F.col("lang").alias("p_lang"), F.col("phrase").alias("part"), F.col("n").alias("f"))
    w = F.split("phrase", " ")
    cand = phrases.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), w.alias("w"))
    cuts = cand.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("head"),
                       F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w"))).alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = (cuts.join(part, (F.col("lang") == F.col("p_lang")) & (F.col(side) == F.col("part")))
                    .withColumnRenamed("f", name).drop("p_lang", "part"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    a2 = (wide("a") * wide("a")).cast("decimal(31,0)")
    score = F.call_function("div", (a2 * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"),
                            (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
                  .agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
                  .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    # the most frequent candidate that holds a candidate's words
    inner = F.explode(F.array(F.concat_ws(" ", F.slice("w", 1, 2)), F.concat_ws(" ", F.slice("w", 2, 2)))).alias("phrase")
    longer = cand.where("words = 3").select("lang", "a", inner).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = (scored.join(longer, ["lang", "phrase"], "left")
                  .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 50)))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    # first inside shares of a language, then among what is left of each
    ranked = (left.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(16)))
                  .withColumn("_r", best("lang", "_salt")).where(F.col("_r") <= top)
                  .withColumn("rank", best("lang").cast("long")).where(F.col("rank") <= top))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
