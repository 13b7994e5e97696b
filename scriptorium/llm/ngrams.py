"""Byte-level words and polynomial fingerprints in numpy, shared by the phrase
and the divergence operator.

Texts of a batch are laid end to end as bytes. Words are runs of bytes of one
class; a fingerprint of any stretch of bytes comes from two prefix values
(Rabin-Karp), so it costs the same for a word and for an n-gram. Equal
fingerprints are never taken for equal text: ``same_text`` compares the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# ASCII letters lower-cased, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15              # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
_STEP = 1 << 16
# a value per byte, so that short stretches already differ in all bits
VALUE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


def class_table(*outside: tuple[int, int]) -> np.ndarray:
    """Per byte whether it belongs to a word: all but the given ranges."""
    t = np.ones(256, bool)
    for lo, hi in outside:
        t[lo:hi + 1] = False
    return t


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows, so that its texts are not all held twice."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column (null: empty)."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last index of every run of true values."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    low = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(min(n, _STEP) - 1, base, np.uint64)))) if n else np.zeros(0, np.uint64)
    if n <= _STEP:
        return low
    high = _powers(pow(base, _STEP, 1 << 64), -(-n // _STEP))
    return (high[:, None] * low[None, :]).reshape(-1)[:n]


_known = {BASE: np.zeros(0, np.uint64), INVERSE: np.zeros(0, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """``_powers``, kept from block to block."""
    if len(_known[base]) < n:
        _known[base] = _powers(base, n)
    return _known[base][:n]


class Prefixes:
    """Prefix polynomials of a stretch of bytes: the fingerprint of bytes
    [start, end) is their difference, shifted back to power 0 and mixed."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(VALUE[raw] * powers(BASE, len(raw)), out=self.sums[1:])
        self.back = powers(INVERSE, len(raw) + 1)

    def fingerprints(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def same_text(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Whether the bytes [a, a + length) and [b, b + length) are equal, per row."""
    out = a == b
    todo = np.flatnonzero(~out)
    total = np.cumsum(length[todo])
    for lo in _cuts(total, block):
        at = todo[lo]
        n = length[at]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = raw[np.repeat(a[at], n) + place] == raw[np.repeat(b[at], n) + place]
        out[at] = np.logical_and.reduceat(equal, first) if len(at) else True
    return out


def _cuts(total: np.ndarray, block: int) -> Iterator[slice]:
    """Slices of rows with at most ``block`` bytes each (or one longer row)."""
    at = 0
    while at < len(total):
        before = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + block, side="right")))
        yield slice(at, end)
        at = end


def number_texts(raw: np.ndarray, fp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number the distinct texts of the stretches [start, end): ``(number of
    each stretch, index of a stretch of each number)``. Fingerprints propose,
    bytes decide: stretches that share a fingerprint but not the text get
    numbers of their own."""
    _, first, number = np.unique(fp, return_index=True, return_inverse=True)
    length = end - start
    rep = first[number]
    same = (length == length[rep])
    same[same] = same_text(raw, start[same], start[rep[same]], length[same])
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same):  # collisions of 64-bit fingerprints
        text = raw[start[i]:end[i]].tobytes()
        if text not in others:
            others[text] = len(first)
            first = np.append(first, i)
        number[i] = others[text]
    return number, first


def text_blocks(texts: list[bytes], limit: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts laid end to end with a line break after each, in blocks of about
    ``limit`` bytes: ``(numbers of the texts, bytes, start of each text)``. A
    longer text is a block of its own."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < limit):
            size += len(texts[end]) + 1
            end += 1
        part = texts[at:end]
        lengths = np.fromiter((len(t) + 1 for t in part), np.int64, len(part))
        yield list(range(at, end)), LOWER[np.frombuffer(b"\n".join(part) + b"\n", np.uint8)], np.cumsum(lengths) - lengths
        at = end
