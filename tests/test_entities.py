"""Character references, the strict checksum verdict and values of texts that
are not UTF-8, against plain versions over bytes."""

import random
import re

import pytest
from pyspark.sql import functions as F

import brute
from scriptorium.functions.entities import XML_NAMES, bytes_view, decode_columns, decode_entities, from_bytes_view
from scriptorium.operators.isbn import extract_isbns
from scriptorium.operators.search import search_kwic

SCHEMA = "title string, text string, file_path string, file_block_start long, seq long"
FRAGMENTS = ["&", "&amp;", "&lt;", "&gt;", "&quot;", "&apos;", "&nbsp;", "&#38;", "&#x26;", "&#0;", "&#xD800;", "&#x10FFFF;", "&#x110000;",
             "&#228;", "&#00065;", "&#x1F600;", "&#99999999;", "&#;", "&#x;", "&#xg;", "#", ";", "amp;", "lt;", "x", "ü", "中", "\n", "38;"]


def decoded(text: bytes, names=XML_NAMES) -> bytes:
    def one(m):
        ref = m[1].decode()
        if ref in names:
            return names[ref].encode()
        if not ref.startswith("#"):
            return m[0]
        n = int(ref[2:], 16) if ref[1] == "x" else int(ref[1:])
        return chr(n).encode() if 0 < n < 0x110000 and not 0xD800 <= n <= 0xDFFF else m[0]

    return re.sub(rb"&([A-Za-z][A-Za-z0-9]*|#[0-9]+|#x[0-9A-Fa-f]+);", one, text)


def _table(spark, texts):
    """Texts given as bytes, also such that are no UTF-8."""
    return spark.createDataFrame([(f"t{i}", bytes(t), "f", 0, i) for i, t in enumerate(texts)],
                                 SCHEMA.replace("text string", "text binary")).withColumn("text", F.col("text").cast("string"))


def _random(seed, fragments, n, size=25):
    rng = random.Random(seed)
    return [b"".join(rng.choice(fragments) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("names", [XML_NAMES, {"nbsp": " ", "amp": "&"}, {}, {"amp": "&", "and": "&amp"}, {"x": "lt;", "amp": "&", "lt": "<"}])
def test_decode_is_a_single_pass(spark, names):
    texts = _random(1, [f.encode() for f in FRAGMENTS] + [b"&and;", b"&x;"], 400)
    got = _table(spark, texts).orderBy("seq").select(decode_entities(F.col("text"), names).cast("binary").alias("d")).collect()
    assert [bytes(r.d) for r in got] == [decoded(t, names) for t in texts]


def test_decode_keeps_other_bytes(spark):
    texts = _random(2, [f.encode() for f in FRAGMENTS] + [b"\xff", b"\xf0", b"\xc3", b"\x80"], 300)
    df = _table(spark, texts)
    got = df.orderBy("seq").select(decode_entities(F.col("text")).cast("binary").alias("d"),
                                   from_bytes_view(bytes_view(F.col("text"))).cast("binary").alias("same")).collect()
    assert [bytes(r.d) for r in got] == [decoded(t) for t in texts] and [bytes(r.same) for r in got] == texts


def test_decode_null_and_bad_names(spark):
    df = spark.createDataFrame([(None, "A &amp; B")], "text string, title string")
    assert [tuple(r) for r in decode_columns(df).select("text", "title").collect()] == [(None, "A & B")]
    with pytest.raises(ValueError):
        decode_entities(F.col("text"), {"a;b": "x"})


def test_nbsp_marker_needs_decoding(spark):
    df = _table(spark, [b"ISBN&amp;nbsp;9783161484100", b"ISBN&#38;nbsp;9783161484100"])
    assert extract_isbns(df, "extended").count() == 0
    assert [r.isbn for r in extract_isbns(df, "extended", decode_entities=True).collect()] == ["9783161484100"] * 2


def test_search_in_decoded_text(spark):
    df = _table(spark, [b"x AT&amp;T &lt;y", "caf&#233; AT&T".encode()])
    assert [r.match_pos for r in search_kwic(df, "AT&T", 3).collect()] == [7 + 4] and search_kwic(df, "café", 3).count() == 0
    got = search_kwic(df, "AT&T", 3, decode_entities=True).orderBy("seq").collect()
    assert [(r.match_pos, r.context) for r in got] == [(3, "x AT&T <y"), (6, "fé AT&T")]
    units = search_kwic(df, "é", 1, "bytes", decode_entities=True).collect()
    assert [(r.match_pos, bytes(r.context)) for r in units] == [(4, "fé ".encode())]


def test_strict_verdict(spark):
    values = {"9780306406157 ": (False, True), "9783161484100 ": (True, True), "9780306406157": (True, True), "9780306406158 ": (False, False),
              " 0306406152": (True, True), "- 030640615X": (False, False), "080442957X -": (None, True)}
    df = _table(spark, [b"{{ISBN|" + v.encode() + b"}}" for v in values])
    plain, strict = ({r.isbn: r.checksum_valid for r in extract_isbns(df, "extended", strict=s).collect()} for s in (False, True))
    for v, (p, s) in values.items():
        found = v.lstrip(" ")
        assert (plain.get(found), strict.get(found)) == (p, s if p is not None else None), v


def test_values_are_cut_from_the_bytes(spark):
    fragments = [b"ISBN", b"ISBN ", b"ISBN:", b"ISBN=", b"isbn=", b"ISBN-10:", b"{{ISBN|", b"{{BibISBN|", b" ", b"-", b"X", b"x", b"|", b"}}", "é".encode(),
                 b"\xff", b"\xf0", b"\xc3", b"\x80", b"\xe2\x82", b"0", b"3", b"978316148410", b"9783161484100", b"316148410", b"0-8044-2957-X"]
    texts = _random(3, fragments, 600) + [b"{{ISBN|978316148410\xf00}}", b"{{ISBN|316148410\xf0X}}", b"{{ISBN|316148410X\xff}}", b"\xffISBN 9783161484100"]
    df = _table(spark, texts)
    for dialect in ("basic", "extended"):
        rows = (extract_isbns(df, dialect).withColumn("isbn", F.col("isbn").cast("binary")).orderBy("seq", "hit_no").collect())
        got = {i: [] for i in range(len(texts))}
        for r in rows:
            got[r.seq].append((bytes(r.isbn), r.checksum_valid))
        for i, t in enumerate(texts):
            want = [(v, None) for v in brute.basic_isbns(t)] if dialect == "basic" else brute.extended_isbns(t)
            assert got[i] == want, (dialect, t)
