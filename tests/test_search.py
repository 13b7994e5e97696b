"""Overlapping keyword-in-context search."""

import random

import pytest

import brute
from scriptorium.operators.search import search_kwic, search_lines

SCHEMA = "title string, text string, file_path string, file_block_start long, seq long"


def _df(spark, texts):
    return spark.createDataFrame([(f"t{i}", t, "f", 0, i) for i, t in enumerate(texts)], SCHEMA)


def _hits(spark, texts, term, n, unit="chars"):
    rows = search_kwic(_df(spark, texts), term, n, unit).orderBy("seq", "match_no").collect()
    out = {i: [] for i in range(len(texts))}
    for r in rows:
        out[r.seq].append((r.match_no, r.match_pos, r.context))
    return out


def test_edges(spark):
    got = _hits(spark, ["ererer", "aüüb", "abc", "no hit"], "erer", 1)
    assert got[0] == [(1, 1, "erere"), (2, 3, "rerer")]
    assert _hits(spark, ["aüüb"], "üb", 1)[0] == [(1, 3, "üüb")]
    assert _hits(spark, ["aüüb"], "üb", 1, "bytes")[0] == [(1, 4, bytes.fromhex("BCC3BC62"))]
    assert _hits(spark, ["abc"], "abc", 0)[0] == [(1, 1, "abc")]
    assert _hits(spark, ["abc"], "", 5) == {0: []}
    with pytest.raises(ValueError):
        search_kwic(_df(spark, ["x"]), "x", -1)


def test_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = ["e", "r", "er", "ü", "é", "中", "😀", " ", "\n", "a"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for term, n in (("erer", 3), ("ü", 2), ("é中", 0), ("e", 5), ("ee", 1), ("erere", 2), ("rer", 0)):
        got = _hits(spark, texts, term, n)
        gotb = _hits(spark, texts, term, n, "bytes")
        k, kb = len(term), len(term.encode())
        for i, t in enumerate(texts):
            exp = []
            for j, p in enumerate(brute.hits(t, term)):
                ctx = t[max(0, p - n):p + k + n]
                exp.append((j + 1, p + 1, ctx))
                assert term in ctx
            assert got[i] == exp, (term, t)
            tb = t.encode()
            expb = []
            for j, p in enumerate(brute.hits(t, term)):
                b = len(t[:p].encode())
                expb.append((j + 1, b + 1, tb[max(0, b - n):b + kb + n]))
            assert gotb[i] == expb, (term, t)


def test_lines(spark):
    hits = search_kwic(_df(spark, ["xx erer yy"]), "erer", 2)
    assert [r.value for r in search_lines(hits).collect()] == ["Article: t0\n...x erer y...\n"]


def test_self_overlap_rule():
    from scriptorium.functions.text import smallest_period
    assert [smallest_period(t) for t in ("erer", "aa", "abcab", "e", "Deutschland", "abab")] == [2, 1, 3, 1, 11, 2]


def test_term_at_both_ends_and_regex_chars(spark):
    texts = ["Deutschland und Deutschland", "a.b(a.b)a.b", "x\\Ey\\Ex"]
    got = _hits(spark, texts, "Deutschland", 2)
    assert got[0] == [(1, 1, "Deutschland u"), (2, 17, "d Deutschland")]
    assert [h[1] for h in _hits(spark, texts, "a.b", 0)[1]] == [1, 5, 9]
    assert [h[1] for h in _hits(spark, texts, "\\E", 0)[2]] == [2, 5]


def test_random_terms_over_small_alphabet(spark):
    # two letters give every kind of self-overlap: "aa", "aba", "abab", "aabaa", ...
    rng = random.Random(17)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(120)]
    df = _df(spark, texts)
    terms = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(40)})
    for term in terms[:16]:
        rows = search_kwic(df, term, 2).orderBy("seq", "match_no").collect()
        got = {}
        for r in rows:
            got.setdefault(r.seq, []).append((r.match_pos, r.context))
        for i, t in enumerate(texts):
            exp = [(p + 1, t[max(0, p - 2):p + len(term) + 2]) for p in brute.hits(t, term)]
            assert got.get(i, []) == exp, (term, t)


def test_bytes_that_are_not_utf8(spark):
    raw = b"ab\xff\xffcd erer tail \xc3erer"
    df = spark.createDataFrame([("t", raw, "f", 0, 0)], "title string, text binary, file_path string, file_block_start long, seq long")
    df = df.selectExpr("title", "cast(text AS string) AS text", "file_path", "file_block_start", "seq")
    got = [(r.match_pos, r.context) for r in search_kwic(df, "erer", 2, "bytes").orderBy("match_no").collect()]
    assert got == [(8, raw[5:13]), (19, raw[16:])]
    with pytest.raises(Exception, match="INVALID_UTF8_STRING"):
        search_kwic(df, "erer", 2).collect()


def test_many_hits_in_groups(spark):
    text = "aab" * 700
    for unit in ("chars", "bytes"):
        got = _hits(spark, [text], "a", 5, unit)[0]
        exp = [(j + 1, p + 1, text[max(0, p - 5):p + 6]) for j, p in enumerate(brute.hits(text, "a"))]
        assert [(a, b, c if unit == "chars" else bytes(c).decode()) for a, b, c in got] == exp
