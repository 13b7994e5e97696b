"""S6, A3-A8, T1, T2, F4, F5 over an ISBN line file."""

from conftest import write_files

from scriptorium.operators import reports
from scriptorium.sources.isbn_file import read_isbn_lines

LINES = [
    "Berlin|978-3-16-148410-0",
    "Berlin|3161484100|CHECKSUM_WRONG",
    "Alpha|0-8044-2957-X",
    "Alpha|978 3 16 148410 0",
    "Beta|9783161484100",
    "Gamma|979-10-90636-07-1",
    "Berliner Dom|3-7913-2095-5",
]


def _lines(spark, folder):
    write_files(folder, {"isbns.txt": "\n".join(LINES) + "\n"})
    return read_isbn_lines(spark, folder)


def test_source_fields(spark, tmpdir_run):
    rows = _lines(spark, tmpdir_run).orderBy("seq").collect()
    assert [r.title for r in rows] == [x.split("|")[0] for x in LINES]
    assert rows[1].isbn == "3161484100" and rows[1].flag == "CHECKSUM_WRONG" and rows[0].flag is None


def test_stats_top_distribution(spark, tmpdir_run):
    lines = _lines(spark, tmpdir_run)
    s = reports.isbn_stats(lines).collect()[0]
    assert (s.total, s.articles, s.avg_per_article) == (7, 5, 1.4)
    top = [(r.title, r["count"]) for r in reports.isbn_top_articles(lines, 3).collect()]
    assert top == [("Berlin", 2), ("Alpha", 2), ("Gamma", 1)]  # ties: title descending
    d = reports.isbn_format_distribution(lines).collect()[0]
    assert (d.isbn13, d.other) == (3, 4)
    assert (d.isbn13_pct, d.other_pct) == (42.85, 57.14)  # truncated, not rounded
    assert [r.value for r in reports.isbn_sample(lines, 2).collect()] == LINES[:2]


def test_filters(spark, tmpdir_run):
    lines = _lines(spark, tmpdir_run)
    assert reports.isbn_filter(lines, "^Berlin$").count() == 0  # whole line: never matches
    assert reports.isbn_filter(lines, "^Berlin$", on="title").count() == 2
    assert reports.isbn_filter(lines, "148410").count() == 4  # digits of the ISBN match too
    summ = reports.isbn_filter_summary(reports.isbn_filter(lines, "Berlin")).collect()[0]
    assert (summ.isbns, summ.articles) == (3, 2)
    none = reports.isbn_filter_summary(reports.isbn_filter(lines, "nomatch")).collect()[0]
    assert (none.isbns, none.articles) == (0, 0)


def test_empty_file(spark, tmpdir_run):
    write_files(tmpdir_run, {"isbns.txt": ""})
    lines = read_isbn_lines(spark, tmpdir_run)
    s = reports.isbn_stats(lines).collect()[0]
    assert (s.total, s.articles, s.avg_per_article) == (0, 0, None)
    d = reports.isbn_format_distribution(lines).collect()[0]
    assert (d.isbn13, d.other, d.isbn13_pct, d.other_pct) == (0, 0, None, None)
    assert reports.isbn_top_articles(lines, 5).count() == 0
    assert reports.isbn_sample(lines).count() == 0


def test_line_without_separator_is_all_title(spark, tmpdir_run):
    write_files(tmpdir_run, {"isbns.txt": "no separator here\nT|123\n"})
    rows = read_isbn_lines(spark, tmpdir_run).orderBy("seq").collect()
    assert [(r.title, r.isbn, r.flag) for r in rows] == [("no separator here", None, None), ("T", "123", None)]
