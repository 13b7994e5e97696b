"""Both ISBN dialects, checksums and the line format."""

import random

import pytest

import brute
from scriptorium.operators.isbn import extract_isbns, isbn_lines

W = "CHECKSUM_WRONG"

# (text, basic, extended) from FIXTURES.md section 4.1; extended entries carry the flag
CASES = [
    ("ISBN 978-3-89821-357-8, x", ["978-3-89821-357-8"], ["978-3-89821-357-8"]),
    ("{{BibISBN|3-7913-2095-5}}", ["3-7913-2095-5"], ["3-7913-2095-5"]),
    ("{{BibISBN| 3-7913-2095-5}}", [" 3-7913-2095-5"], ["3-7913-2095-5"]),
    ("|ISBN=0-8131-1803-4|", ["0-8131-1803-4"], ["0-8131-1803-4"]),
    ("ISBN-13: 978-3-16-148410-0", [], ["978-3-16-148410-0"]),
    ("ISBN 0-8044-2957-X.", [], ["0-8044-2957-X"]),
    ("ISBN978-3-16-148410-0", ["978-3-16-148410-0"], []),
    ("isbn=9783161484100 2", [], []),
    ("{{ISBN|ISBN=3161484100}}", ["3161484100"], ["ISBN=3161484100 " + W, "3161484100 " + W]),
    ("{{ISBN|9780306406157 }}", [], ["9780306406157  " + W]),
    ("{{ISBN| 9783161484100 }}", [], ["9783161484100 "]),
    ("ISBN 3-16-148410-0 - ISBN: 3161484100 --", ["3-16-148410-0", "3161484100"],
     ["3-16-148410-0 " + W, "3161484100 " + W]),
    ("ISBN 3161484100 3161484101", [], []),
    ("ISBN&amp;nbsp;9783161484100", [], []),
]


def _ext_repr(r):
    return r.isbn + ("" if r.checksum_valid else " " + W)


def _run(spark, texts, dialect):
    df = spark.createDataFrame([(f"t{i}", t, "f", 0, i) for i, t in enumerate(texts)],
                               "title string, text string, file_path string, file_block_start long, seq long")
    rows = extract_isbns(df, dialect).orderBy("seq", "hit_no").collect()
    out = {i: [] for i in range(len(texts))}
    for r in rows:
        out[r.seq].append(r)
    return out


def test_fixture_cases(spark):
    texts = [c[0] for c in CASES]
    basic = _run(spark, texts, "basic")
    ext = _run(spark, texts, "extended")
    for i, (text, b, e) in enumerate(CASES):
        assert [r.isbn for r in basic[i]] == b, text
        assert all(r.checksum_valid is None for r in basic[i])
        assert [_ext_repr(r) for r in ext[i]] == e, text


def test_against_brute_force(spark):
    rng = random.Random(11)
    frags = ["ISBN", "ISBN ", "ISBN:", "ISBN=", "isbn=", "ISBN-10:", "ISBN-13 ", "ISBN-1", "{{ISBN|",
             "{{BibISBN|", "&nbsp;", " ", "-", "X", "x", ":", "=", "|", "}", "}}", "é", "\n", "0", "3",
             "978", "3-16-148410-0", "316148410", "9783161484100", "0-8044-2957-X", "abc"]
    texts = ["".join(rng.choice(frags) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    basic = _run(spark, texts, "basic")
    ext = _run(spark, texts, "extended")
    for i, t in enumerate(texts):
        tb = t.encode("utf-8")
        assert [r.isbn.encode() for r in basic[i]] == brute.basic_isbns(tb), t
        assert [(r.isbn.encode(), r.checksum_valid) for r in ext[i]] == brute.extended_isbns(tb), t
        assert [r.hit_no for r in ext[i]] == list(range(1, len(ext[i]) + 1))


def test_lines_format(spark):
    df = spark.createDataFrame(
        [("A", 1, "978-3-16-148410-0", True, "f", 0, 1), ("B", 1, "3161484100", False, "f", 0, 2),
         ("C", 1, "3-16\n148410-0", None, "f", 0, 3)],
        "title string, hit_no int, isbn string, checksum_valid boolean, file_path string, file_block_start long, seq long")
    got = [r.value for r in isbn_lines(df).orderBy("seq").collect()]
    assert got == ["A|978-3-16-148410-0", "B|3161484100|CHECKSUM_WRONG", "C|3-16 148410-0"]


def test_bad_dialect(spark):
    df = spark.createDataFrame([("t", "x", "f", 0, 0)], "title string, text string, file_path string, file_block_start long, seq long")
    with pytest.raises(ValueError):
        extract_isbns(df, "fancy")


def test_isbn_anchored_path_against_brute_force(spark):
    # texts without "isbn=" take the ISBN-anchored patterns; stress template
    # prefixes and markers packed next to each other
    rng = random.Random(23)
    frags = ["ISBN", "ISBN ", "ISBN:", "ISBN=", "ISBN-10:", "ISBN-13 ", "ISBN-10 ", "ISBN-13:", "{{ISBN|",
             "{{BibISBN|", "{{Bib", "{{", "{", "Bib", "&nbsp;", " ", "-", "X", "x", ":", "=", "|", "}",
             "0", "7", "978", "3-16-148410-0", "9783161484100", "0-8044-2957-X", "ü"]
    texts = ["".join(rng.choice(frags) for _ in range(rng.randint(1, 30))) for _ in range(1000)]
    assert not any("isbn=" in t for t in texts)
    basic = _run(spark, texts, "basic")
    ext = _run(spark, texts, "extended")
    for i, t in enumerate(texts):
        tb = t.encode("utf-8")
        assert [r.isbn.encode() for r in basic[i]] == brute.basic_isbns(tb), t
        assert [(r.isbn.encode(), r.checksum_valid) for r in ext[i]] == brute.extended_isbns(tb), t


def test_checksum_steps(spark):
    from scriptorium.functions.isbn import checksum_steps

    vals = ["3-16-148410-0", "3161484100", "0-8044-2957-X", "080442957x", "978-3-16-148410-0", "9783161484101",
            "9780306406157 ", "9783161484100 ", "12345678", "978316148410X", "ISBN=3161484100", "1-2-3-4-5-6-7-8-9-0"]
    df = spark.createDataFrame([(v,) for v in vals], "isbn string")
    steps = {r.isbn: r.checksum_valid for r in df.selectExpr("isbn", *checksum_steps()).collect()}
    for v in vals:
        assert steps[v] == brute.checksum(v.encode()), v
