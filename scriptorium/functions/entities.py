"""Character references of XML text (X1, X6): a decoder as a column.

A dump stores ``&`` as ``&amp;`` and so on; all operators read that stored
form unless asked to decode. Decoding is a single pass: what a reference
stands for is never read as part of another one (``&amp;lt;`` is ``&lt;``).
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The named references that XML knows by itself.
XML_NAMES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}

_LATIN = "ISO-8859-1"  # one character per byte


def bytes_view(text: Column) -> Column:
    """``text`` with one character per byte, whatever the bytes are."""
    return F.decode(text.cast("binary"), _LATIN)


def from_bytes_view(view: Column) -> Column:
    """The string whose ``bytes_view`` is ``view``."""
    return F.encode(view, _LATIN).cast("string")


def _of_code_point(n: Column) -> Column:
    """UTF-8 bytes of a code point, as a bytes view; null if there is none."""
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), F.decode(F.encode(char, "UTF-8"), _LATIN))


def decode_entities(text: Column, names: Mapping[str, str] = XML_NAMES) -> Column:
    """``text`` with its named, decimal and hexadecimal references decoded.

    ``names``: the named ones (default: those of XML; a dump's text may hold
    further names of HTML in wikitext, which stand after one decoding, as
    ``ISBN&nbsp;``). A number that is no character, an unknown name and a
    bare ``&`` stay as they are, and so do bytes that are no UTF-8. Texts
    without ``&`` cost one search; texts without ``&#`` are decoded by
    replacement, names first and ``&amp;`` last.
    """
    if not all(re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", k) for k in names):
        raise ValueError("a name is a letter, then letters and digits")
    amp = [k for k, v in names.items() if v == "&"]
    # replacement is only a single pass when no other value can start or continue a reference
    plain = text
    for k in [k for k in names if k not in amp] + amp:
        plain = F.replace(plain, F.lit(f"&{k};"), F.lit(names[k]))
    simple = len(amp) <= 1 and not any(set(v) & set("&;#") or re.search("[A-Za-z0-9]", v) for k, v in names.items() if k not in amp)

    listed = "|".join(sorted(names, key=len, reverse=True)) or "(?!)"
    pattern = F.lit(rf"&(?:(?:{listed})|#0*[0-9]{{1,7}}|#x0*[0-9A-Fa-f]{{1,6}});")
    view = bytes_view(text)

    def value(ref: Column) -> Column:
        decimal = F.regexp_extract(ref, "^&#([0-9]+);$", 1)
        hexadecimal = F.regexp_extract(ref, "^&#x0*([0-9A-Fa-f]+);$", 1)
        number = (F.when(decimal != "", decimal.try_cast("bigint"))
                  .when(hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("bigint")))
        out = F.when(number.isNotNull(), _of_code_point(number))
        for k, v in names.items():
            out = out.when(ref == f"&{k};", F.lit(v.encode("utf-8").decode("latin-1")))
        return F.coalesce(out, ref)

    values = F.transform(F.regexp_extract_all(view, pattern, F.lit(0)), value)
    pieces = F.split(view, rf"&(?:(?:{listed})|#0*[0-9]{{1,7}}|#x0*[0-9A-Fa-f]{{1,6}});", -1)
    joined = F.array_join(F.zip_with(pieces, values, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    exact = from_bytes_view(joined)
    needs = text.contains("&#") if simple else F.lit(True)
    return F.when(~text.contains("&"), text).when(needs, exact).otherwise(plain)


def decode_columns(df: DataFrame, columns: tuple[str, ...] = ("title", "text"), names: Mapping[str, str] = XML_NAMES) -> DataFrame:
    """``df`` with the references in ``columns`` decoded."""
    return df.withColumns({c: decode_entities(F.col(c), names) for c in columns if c in df.columns})
