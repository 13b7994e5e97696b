"""POSIX extended expressions against the grep of this machine, and ties and
distinct titles by collation."""

import random
import re
import subprocess

import pytest

from scriptorium.functions.ere import to_java
from scriptorium.operators import reports

LINES = ["", "a", "ab", "aab", "abc", "b*", "a{1", "a{1}", "{", "}", "x]y", "-", "a-c", "\\", "a\\b", "^a", "a$", "(a)", "a|b", "Berlin|978-3-16", "Berlin",
         "ä", "Ä1", "foo bar", "foo_bar", "9", "a\tb", "A.B", "aaa", "abab", "bab", "caab", "[", "a]", "12:34", "x\r", "ß", "é-É", "日本", "a.b", "Zz"]


def _matches(spark, java):
    df = spark.createDataFrame([(i, x, x) for i, x in enumerate(LINES)], "i int, value string, title string")
    from pyspark.sql import functions as F
    return [r.i for r in df.where(F.col("value").rlike(java)).orderBy("i").collect()]


def _grep(pattern, locale="C.UTF-8"):
    """Lines that grep -E matches; None if it takes the pattern for an error."""
    got = subprocess.run(["grep", "-n", "-E", "-e", pattern], input="\n".join(LINES) + "\n", capture_output=True, text=True, encoding="utf-8",
                         env={"LC_ALL": locale, "PATH": "/usr/bin:/bin"}, timeout=20)
    return None if got.returncode > 1 else [int(x.split(":", 1)[0]) - 1 for x in got.stdout.split("\n") if x]


CASES = ["", "a", "^$", "^a", "a$", "b\\*", "a{2}", "a{2,}", "a{,2}b", "a{,}b", "{}", "a{1,2}b", "a*+b", "a+?b", "(ab)+", "(ab|c)a*b", "a|^b", "()", "a||b", "(a|)b", "[]x]", "[^]x]y",
         "[a-c]{3}", "[[:alpha:]]", "[[:digit:]]+", "[^[:alnum:]]", "[[:upper:][:digit:]]", "[[:space:]]", "[[:punct:]]", "[\\]", "[a\\]b", "[-a]", "[a-]", "x\\]", "\\(a\\)",
         "\\{", "a\\{1", "\\^a", "a\\$", "\\\\", "[.]", "a.b", "\\.", "\\bbar", "\\<foo\\>", "foo\\B", "\\w+\\W\\w+", "\\s", "[[=a=]]b", "[[.-.]]", "a{1", "x$y", "a^b", "^^a", "}",
         "]", "-", "[&&a]", "[a&&b]", "[^^]", "[$]", "[[:blank:]]", "Berlin\\|97[89]", "[[:xdigit:]]{2}", "é|É", "(^a|b$)", "ab*c", "[[:lower:]]$"]


def test_like_grep(spark):
    for p in CASES:
        assert _matches(spark, to_java(p)) == _grep(p), p
    for p in ("[[:alpha:]]", "[[:upper:]]", "^[[:alnum:]]+$", "[[:punct:]]"):
        ascii_only = [i for i in _grep(p, "C") if LINES[i].isascii()]
        assert [i for i in _matches(spark, to_java(p, ascii_classes=True)) if LINES[i].isascii()] == ascii_only, p


def test_random_patterns_like_grep(spark):
    rng = random.Random(6)
    parts = ["a", "b", "c", ".", "*", "+", "?", "|", "(", ")", "^", "$", "[ab]", "[^a]", "[a-c]", "[[:digit:]]", "{2}", "{1,2}", "{", "\\.", "\\*", "]", "}", "-", " "]
    seen = both = 0
    for _ in range(250):
        p = "".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))
        try:
            java = to_java(p)
        except ValueError:
            continue
        want = _grep(p)
        seen += 1
        if want is None:
            continue
        both += 1
        assert _matches(spark, java) == want, p
    assert both >= 60 and both == seen


@pytest.mark.parametrize("bad", ["(", "(a", "a)", "[a", "[[:nope:]]", "[[.ab.]]", "[[:alpha:", "*a", "a|*b", "+", "a\\", "(a)\\1", "\\d", "a{2,1}", "a{}", "a{99999}", "^*", "[b-a]", "[[:digit:]-z]"])
def test_what_has_no_counterpart_is_an_error(bad):
    with pytest.raises(ValueError):
        to_java(bad)


def test_filter_syntax(spark):
    df = spark.createDataFrame([(x, x.split("|")[0]) for x in ("Köln 2|978", "Köln|12", "abc|3")], "value string, title string")
    got = lambda **k: sorted(r.value for r in reports.isbn_filter(df, **k).collect())
    assert got(pattern="^[[:alpha:]]+$", on="title", syntax="ere") == ["Köln|12", "abc|3"]
    assert got(pattern="^[[:alpha:]]+$", on="title", syntax="ere", ascii_classes=True) == ["abc|3"]
    assert got(pattern="\\|[[:digit:]]{2,}$", syntax="ere") == ["Köln 2|978", "Köln|12"]
    with pytest.raises(ValueError):
        reports.isbn_filter(df, "a", syntax="perl")
    with pytest.raises(ValueError):
        reports.isbn_filter(df, "a", on="isbn")


def test_collation_decides_ties_and_distinct_titles(spark):
    titles = ["Zoo", "Äpfel", "Apfel", "apfel", "Öl", "Ofen", "Straße", "Strasse", "ohne", "zoo"]
    df = spark.createDataFrame([(t + "|1", t) for t in titles] + [("B|1", "B"), ("B|2", "B")], "value string, title string")
    names = lambda **k: [r.title for r in reports.isbn_top_articles(df, 20, **k).collect()]
    assert names() == ["B"] + sorted(titles, key=lambda t: t.encode(), reverse=True)
    rising = ["apfel", "Apfel", "Äpfel", "Ofen", "ohne", "Öl", "Strasse", "Straße", "zoo", "Zoo"]  # German dictionary order
    assert names(collation="de") == ["B"] + rising[::-1]
    same = spark.createDataFrame([("a|1", "a"), ("A|1", "A"), ("ä|1", "ä"), ("ä|1", "ä")], "value string, title string")
    assert reports.isbn_stats(same).collect()[0].articles == 4
    assert reports.isbn_stats(same, collation="UNICODE").collect()[0].articles == 3  # one letter, composed or not
    assert reports.isbn_filter_summary(same, collation="UNICODE_CI").collect()[0].articles == 2
