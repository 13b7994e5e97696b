"""Keyword-in-context search (X1, X3, X4, F6) and its text sink.

Every occurrence of the term is a hit, overlapping ones included (the
reference moves its cursor one byte past each hit). The context is the hit
plus ``context`` units on each side, clipped to the article.

Plan per article, all inside one narrow stage (no shuffle):

1. byte-level ``contains`` filter, so articles without the term cost one scan;
2. cut the text at every hit with a pattern that consumes the term's first
   p characters (p = smallest period) and looks ahead for the rest, so
   overlapping hits survive and the pattern still opens with a literal; in
   byte units the text is read as one character per byte, so positions are
   those of the original bytes, whatever they are;
3. running offsets of the pieces (Arrow UDF on integer arrays; the text stays
   in the JVM);
4. groups of at most GROUP hits, each with the part of the text that its
   contexts need, are exploded; then every group's contexts. The bytes are
   bound to a lambda variable, which hands out slices without copying the
   whole text per hit, so work is linear in text and hits, and no more than
   one group's contexts are held at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scriptorium.functions.entities import decode_entities as decoded
from scriptorium.functions.text import contains_term, hit_offsets_udf, smallest_period, split_at_hits
from scriptorium.sources.dump import ORDER_KEY, order_cols
from scriptorium.sources.ordered import write_ordered

HIT_SCHEMA = "title string, match_no int, match_pos int, context string"


def _check(term: str, context: int) -> None:
    if not isinstance(context, int) or context < 0:
        raise ValueError(f"context must be a non-negative integer, got {context!r}")
    if not isinstance(term, str):
        raise TypeError("term must be a string")


GROUP = 256  # hits whose contexts are cut together


def _hit_offsets(text: Column, term: str, unit: str) -> Column:
    """Array of structs (c, b): 0-based character and byte offsets of every
    hit, in text order. The text is cut at every hit (``split_at_hits``,
    consuming the term's first p characters); one pass over the pieces takes
    their lengths, one Arrow UDF turns them into hit offsets. In byte units a
    character stands for a byte."""
    if unit == "bytes":
        text = F.decode(text.cast("binary"), "ISO-8859-1")
        term = term.encode("utf-8").decode("latin-1")
    p = smallest_period(term)
    size = F.length if unit == "bytes" else F.octet_length
    lengths = F.transform(split_at_hits(text, term), lambda x: F.struct(F.length(x).alias("c"), size(x).alias("b")))
    return hit_offsets_udf(p, len(term[:p].encode("latin-1" if unit == "bytes" else "utf-8")))(lengths)


def _slice(data: Column, fn) -> Column:
    """``fn`` of the bytes ``data`` bound to a lambda variable (a column would
    be copied out of its row at every use)."""
    return F.transform(F.array(data), fn)[0]


def search_kwic(articles: DataFrame, term: str, context: int = 100, unit: str = "chars",
                decode_entities: bool = False) -> DataFrame:
    """All hits of ``term`` with their context.

    ``unit="chars"``: positions and context width in characters, context is
    a string; an article with a hit that is not valid UTF-8 fails the job
    (characters are not defined there). ``unit="bytes"``: as the reference,
    positions and width in bytes of any text; the context is BINARY because a
    byte window can cut a character. Text is raw wikitext: search
    ``AT&amp;T`` to find ``AT&T``, or ask for ``decode_entities``, which
    searches, counts and cuts the text with its character references decoded.

    Columns: ``title, match_no, match_pos, context`` and the order key.
    """
    _check(term, context)
    if unit not in ("chars", "bytes"):
        raise ValueError("unit must be 'chars' or 'bytes'")
    if decode_entities:
        articles = articles.withColumn("text", decoded(F.col("text")))
    if term == "":
        # an empty term is never found
        return articles.filter(F.lit(False)).select(
            "title", F.lit(0).alias("match_no"), F.lit(0).alias("match_pos"),
            F.lit(None).cast("binary" if unit == "bytes" else "string").alias("context"), *order_cols(articles))

    kb = len(term.encode("utf-8"))
    # A window of N characters lies inside 4N + 3 bytes (UTF-8 characters are
    # at most 4 bytes): the byte window is cut first and trimmed by characters
    # after the explode. A cut through a character only ever falls outside the
    # kept part.
    span = context if unit == "bytes" else 4 * context + 4
    text = F.col("text") if unit == "bytes" else F.validate_utf8("text")
    key = order_cols(articles)
    hits = (articles
            .filter(contains_term(F.col("text"), term))
            .select("title", *key, F.col("text").cast("binary").alias("_bin"),
                    _hit_offsets(text, term, unit).alias("_hits")))

    def group(data: Column, g: Column) -> Column:
        own = F.slice("_hits", g * GROUP + 1, F.lit(GROUP))
        lo = F.greatest(F.element_at(own, 1)["b"] - span, F.lit(0))
        hi = F.element_at(own, -1)["b"] + kb + span
        return F.struct(F.substring(data, (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"), lo.alias("lo"),
                        own.alias("hits"), (g * GROUP).alias("no"))

    groups = F.sequence(F.lit(0), F.expr(f"(size(_hits) - 1) div {GROUP}").cast("int"))
    # outer explodes and filters on their output: an inferred size(..) > 0
    # filter would be pushed below the projection and evaluate it twice
    rows = (hits.select("title", *key, F.explode_outer(
                F.when(F.size("_hits") > 0, _slice(F.col("_bin"), lambda d: F.transform(groups, lambda g: group(d, g))))).alias("_g"))
            .filter(F.col("_g").isNotNull()))

    def cut(data: Column, h: Column) -> Column:
        at = h["b"] - F.col("_g.lo")
        b0 = F.greatest(at - span, F.lit(0))
        return F.struct(h["c" if unit == "chars" else "b"].alias("pos"),
                        F.substring(data, (b0 + 1).cast("int"), (at - b0 + kb + span).cast("int")).alias("ctx"),
                        (at - b0).cast("int").alias("k"))

    contexts = _slice(F.col("_g.part"), lambda d: F.transform(F.col("_g.hits"), lambda h: cut(d, h)))
    exploded = (rows.select("title", *key, F.col("_g.no").alias("_no"), F.posexplode_outer(contexts).alias("_i", "_h"))
                .filter(F.col("_h").isNotNull()))
    if unit == "bytes":
        ctx = F.col("_h.ctx")
    else:
        w, k = F.col("_h.ctx"), F.col("_h.k")
        before = F.substring(w, F.lit(1), k).cast("string")
        after = F.substring(w, k + 1, F.lit(kb + span)).cast("string")
        ctx = F.concat(F.right(before, F.lit(context)), F.left(after, F.lit(len(term) + context)))
    return exploded.select(
        "title",
        (F.col("_no") + F.col("_i") + 1).cast("int").alias("match_no"),
        (F.col("_h.pos") + 1).cast("int").alias("match_pos"),
        ctx.alias("context"),
        *key,
    )


def search_lines(hits: DataFrame) -> DataFrame:
    """The reference's text format, one value per hit:
    ``Article: <title>\n...<context>...\n`` (the writer's newline adds the
    blank line). Byte-mode contexts are carried over byte for byte (``concat``
    and the text writer do not decode), so a cut character is written as the
    reference writes it."""
    ctx = F.col("context")
    if dict(hits.dtypes)["context"] == "binary":
        ctx = ctx.cast("string")
    value = F.concat(F.lit("Article: "), F.col("title"), F.lit("\n..."), ctx, F.lit("...\n"))
    return hits.select(value.alias("value"), *order_cols(hits), "match_no")


def write_search_lines(hits: DataFrame, path: str, ordered: bool = False) -> int:
    """Write S4 lines from the scan's own tasks: one pass over the dump, no
    shuffle, hits of a task in file order. ``ordered``: a folder per split,
    whose names follow each other in dump order (``write_ordered``; hits without
    an order key are sorted by title). Returns the number of hits, counted
    while writing."""
    lines = search_lines(hits)
    if ordered and set(ORDER_KEY) <= set(lines.columns):
        return write_ordered(lines, path, "match_no")
    if ordered:
        lines = lines.orderBy(*(order_cols(lines) or ["title"]), "match_no")
    seen = Observation("search_lines")
    lines.observe(seen, F.count(F.lit(1)).alias("n")).select("value").write.mode("overwrite").text(path)
    return seen.get["n"]
