"""ISBN extraction in the two reference dialects (X5/F2 basic, X6/F3/X9
extended) and the ``title|isbn[|CHECKSUM_WRONG]`` line format (S3).

Plan: containment pre-filter, one regex pass per article that returns the
candidate tokens, format filter on the token array, then explode. Only the
title and the tokens leave the article row; the text never reaches the
explode or any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.entities import decode_entities as decoded
from scriptorium.functions.isbn import checksum_steps, format_ok, isbn_tokens, may_contain_isbn
from scriptorium.sources.dump import order_cols

# Fixed value: the flag the extended dialect appends to a wrong checksum.
CHECKSUM_WRONG = "CHECKSUM_WRONG"


def isbn_candidates(text: Column, dialect: str) -> Column:
    """Accepted ISBN values of one text, in text order."""
    return F.filter(isbn_tokens(text, dialect), lambda v: format_ok(v, dialect))


def isbn_count(text: Column, dialect: str = "extended") -> Column:
    """Number of ISBNs a text yields (A9's per-article increment)."""
    return F.when(may_contain_isbn(text, dialect), F.size(isbn_candidates(text, dialect))).otherwise(F.lit(0))


def extract_isbns(articles: DataFrame, dialect: str = "basic", decode_entities: bool = False,
                  strict: bool = False) -> DataFrame:
    """One row per ISBN found: ``title, hit_no, isbn, checksum_valid`` and the
    order key. ``checksum_valid`` is null in the basic dialect.

    ``decode_entities``: read the text with its character references decoded
    once; ``ISBN&nbsp;`` of the wikitext, which a dump stores as
    ``ISBN&amp;nbsp;``, is found only so. ``strict``: the verdict is of the
    value without spaces and hyphens around it, so that ``9780306406157 `` in
    a template is valid (without it, the reference's verdict: wrong).
    """
    if decode_entities:
        articles = articles.withColumn("text", decoded(F.col("text")))
    text = F.col("text")
    key = order_cols(articles)
    found = (articles
             .filter(may_contain_isbn(text, dialect))
             .select("title", *key, isbn_candidates(text, dialect).alias("_isbns"))
             # outer + filter keeps the inferred size() > 0 filter from being
             # pushed below the projection (which would run the regex twice)
             .select("title", *key, F.posexplode_outer("_isbns").alias("_i", "isbn"))
             .filter(F.col("isbn").isNotNull()))
    if dialect == "extended":
        # the verdict as a chain of small steps (see checksum_steps)
        found = found.selectExpr("*", *checksum_steps("isbn", "_verdict", strict))
        verdict = F.col("_verdict")
    else:
        verdict = F.lit(None).cast("boolean")
    return found.select(
        "title",
        (F.col("_i") + 1).cast("int").alias("hit_no"),
        "isbn",
        verdict.alias("checksum_valid"),
        *key,
    )


# what stands for a character that would end a line or a field
ESCAPES = {"\n": "\\n", "\r": "\\r", "|": "\\p"}


def escaped(field: Column) -> Column:
    """``field`` with backslashes, line breaks and ``|`` spelt out."""
    out = F.replace(field, F.lit("\\"), F.lit("\\\\"))
    for char, name in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def unescaped(field: Column) -> Column:
    """What ``escaped`` was given. Pieces between doubled backslashes hold no
    others than those of ESCAPES."""
    def plain(piece: Column) -> Column:
        for char, name in ESCAPES.items():
            piece = F.replace(piece, F.lit(name), F.lit(char))
        return piece

    return F.array_join(F.transform(F.split(field, r"\\\\", -1), plain), "\\")


def isbn_lines(isbns: DataFrame, escape: bool = False) -> DataFrame:
    """S3: ``title|isbn``, plus ``|CHECKSUM_WRONG`` for a failed checksum.

    A template value may contain a line break; it is written as a space so
    that one ISBN stays one line (the typed table is the master copy), or, with
    ``escape``, as ``\\n`` (``\\r``, ``\\p`` for ``|``, ``\\\\`` for a backslash), which
    ``read_isbn_lines`` turns back.
    """
    title, isbn = F.col("title"), F.regexp_replace("isbn", r"[\r\n]", " ")
    if escape:
        title, isbn = escaped(title), escaped(F.col("isbn"))
    flag = F.when(F.col("checksum_valid") == F.lit(False), F.lit(CHECKSUM_WRONG))
    return isbns.select(F.concat_ws("|", title, isbn, flag).alias("value"), *order_cols(isbns), "hit_no")
