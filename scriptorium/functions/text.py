"""Scalar text helpers shared by the operators.

All of them are built-in Spark expressions, except ``hit_offsets_udf``, an
Arrow-batched UDF that turns per-article arrays of piece lengths into hit
offsets in one vectorised numpy pass (Spark SQL has no linear array prefix
sum: ``aggregate`` + ``array_append`` is quadratic in the array size). Only
integer arrays cross into Python, never the article text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quote_regex(literal: str) -> str:
    r"""Java regex that matches ``literal`` verbatim (as ``Pattern.quote``):
    ``\Q...\E``, with any ``\E`` inside the literal split out."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def contains_term(text: Column, term: str) -> Column:
    """Case-sensitive, exact containment. An empty needle is never found
    (Spark's ``instr(s, '')`` is 1, so the empty case is guarded here)."""
    if term == "":
        return F.lit(False)
    # contains() is a byte-level scan; instr() walks characters
    return text.contains(term)


def count_nonoverlapping(text: Column, needle: str) -> Column:
    """Occurrences of ``needle`` in ``text``, non-overlapping, left to
    right, the cursor moving past each hit (a regex find loop over the
    quoted literal: the matcher skips ahead, nothing is copied). Texts
    without the needle cost one byte-level ``contains`` scan."""
    if needle == "":
        return F.lit(0).cast("long")
    return (F.when(text.contains(needle), F.regexp_count(text, F.lit(quote_regex(needle))).cast("long"))
            .otherwise(F.lit(0).cast("long")))


def smallest_period(term: str) -> int:
    """Smallest p > 0 with term[i] == term[i + p] for every i: two
    occurrences of ``term`` can start no closer than p characters apart
    ("erer": 2, "Deutschland": 11)."""
    n = len(term)
    return next(p for p in range(1, n + 1) if term[p:] == term[:n - p])


def split_at_hits(text: Column, term: str) -> Column:
    """``text`` cut at every occurrence of ``term``, overlapping ones
    included; k hits give k + 1 pieces, and hit i starts after pieces
    0..i-1 and i-1 copies of the consumed prefix ``term[:p]``.

    The pattern consumes the first p characters (p = smallest period) and
    checks the rest by lookahead: no occurrence can start inside the
    consumed part, so none is lost, and a pattern that opens with a literal
    lets Java's matcher skip ahead instead of trying a lookahead at every
    position."""
    p = smallest_period(term)
    rest = term[p:]
    pattern = quote_regex(term[:p]) + (f"(?={quote_regex(rest)})" if rest else "")
    return F.split(text, pattern, -1)


HIT_OFFSETS_TYPE = T.ArrayType(T.StructType([T.StructField("c", T.LongType()), T.StructField("b", T.LongType())]))


def hit_offsets_udf(c_add: int, b_add: int):
    """Arrow UDF: per row, the pieces' (characters, bytes) lengths -> the
    0-based (c, b) offsets of the hits between them. Hit i starts after
    pieces 0..i-1 plus i-1 consumed prefixes of ``c_add`` characters /
    ``b_add`` bytes. One vectorised numpy pass per Arrow batch."""

    @F.arrow_udf(HIT_OFFSETS_TYPE)
    def hit_offsets(pieces: pa.Array) -> pa.Array:
        if isinstance(pieces, pa.ChunkedArray):
            pieces = pieces.combine_chunks()
        offsets = np.asarray(pieces.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        flat = pieces.flatten()
        lens = np.diff(offsets)
        starts = offsets[:-1]
        row = np.repeat(np.arange(len(lens)), lens)
        keep = (np.arange(len(flat)) - starts[row]) >= 1  # piece 0 precedes the first hit
        cols = []
        for name, add in (("c", c_add), ("b", b_add)):
            v = np.asarray(flat.field(name).fill_null(0), dtype=np.int64) + add
            csum = np.concatenate(([0], np.cumsum(v)))
            exclusive = csum[:-1] - csum[starts][row]
            cols.append(pa.array((exclusive - add)[keep], pa.int64()))
        new_offsets = np.concatenate(([0], np.cumsum(np.maximum(lens - 1, 0))))
        return pa.ListArray.from_arrays(pa.array(new_offsets, pa.int32()),
                                        pa.StructArray.from_arrays(cols, names=["c", "b"]),
                                        mask=pieces.is_null())

    return hit_offsets
