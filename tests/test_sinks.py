"""The written text formats, in file order."""

import glob
import os

from conftest import write_files

from scriptorium.operators.articles import read_articles
from scriptorium.operators.categories import category_stats, format_category_stats
from scriptorium.operators.isbn import extract_isbns
from scriptorium.operators.search import search_kwic, write_search_lines
from scriptorium.sources.isbn_file import read_isbn_lines, write_isbn_lines

T = '<text xml:space="preserve">'


def _dump(folder):
    pages = [("Alpha", "ISBN 3161484100 and ISBN 978-3-16-148410-0 [[Kategorie:X]]"),
             ("Beta", "{{BibISBN|0-8044-2957-X}} Deutschland"),
             ("Gamma", "Deutschland, Deutschland [[Kategorie:X]][[Kategorie:Y]]")]
    body = "<mediawiki>\n" + "".join(f"  <page>\n    <title>{t}</title>\n    <revision>{T}{x}</text></revision>\n  </page>\n"
                                     for t, x in pages) + "</mediawiki>\n"
    write_files(folder, {"dump.xml": body})
    return folder


def _read_text(folder):
    parts = sorted(glob.glob(os.path.join(folder, "part-*")))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def test_isbn_file_round_trip(spark, tmpdir_run):
    os.makedirs(os.path.join(tmpdir_run, "dump"))
    dump = _dump(os.path.join(tmpdir_run, "dump"))
    out = os.path.join(tmpdir_run, "isbns")
    assert write_isbn_lines(extract_isbns(read_articles(spark, dump), "extended"), out) == 3
    assert _read_text(out) == ("Alpha|3161484100|CHECKSUM_WRONG\n"
                               "Alpha|978-3-16-148410-0\n"
                               "Beta|0-8044-2957-X\n")
    back = read_isbn_lines(spark, out).orderBy("file_path", "file_block_start", "seq").collect()
    assert [(r.title, r.isbn, r.flag) for r in back] == [
        ("Alpha", "3161484100", "CHECKSUM_WRONG"), ("Alpha", "978-3-16-148410-0", None), ("Beta", "0-8044-2957-X", None)]
    basic = os.path.join(tmpdir_run, "basic")
    write_isbn_lines(extract_isbns(read_articles(spark, dump), "basic"), basic)
    assert _read_text(basic) == "Alpha|3161484100\nAlpha|978-3-16-148410-0\n"


def test_search_file_format(spark, tmpdir_run):
    os.makedirs(os.path.join(tmpdir_run, "dump"))
    dump = _dump(os.path.join(tmpdir_run, "dump"))
    out = os.path.join(tmpdir_run, "search-Deutschland.txt")
    write_search_lines(search_kwic(read_articles(spark, dump), "Deutschland", 3), out)
    assert _read_text(out) == ("Article: Beta\n...}} Deutschland...\n\n"
                               "Article: Gamma\n...Deutschland, D...\n\n"
                               "Article: Gamma\n...d, Deutschland [[...\n\n")


def test_summary_text(spark, tmpdir_run):
    os.makedirs(os.path.join(tmpdir_run, "dump"))
    dump = _dump(os.path.join(tmpdir_run, "dump"))
    text = format_category_stats(category_stats(read_articles(spark, dump)))
    assert text == ("Category Statistics:\n"
                    "Total articles: 3\n"
                    "Articles with categories: 2 (66.7%)\n"
                    "Total categories: 3\n"
                    "Average categories per article: 1.50\n"
                    "Maximum categories: 2 in article \"Gamma\"\n")


def test_search_file_bytes_keeps_cut_characters(spark, tmpdir_run):
    os.makedirs(os.path.join(tmpdir_run, "dump"))
    write_files(os.path.join(tmpdir_run, "dump"), {"d.xml": f"<page><title>Ü</title>{T}aüüb</text></page>\n"})
    out = os.path.join(tmpdir_run, "s")
    write_search_lines(search_kwic(read_articles(spark, os.path.join(tmpdir_run, "dump")), "üb", 1, unit="bytes"), out)
    data = b"".join(open(p, "rb").read() for p in sorted(glob.glob(out + "/part-*")))
    assert data == "Article: Ü\n...".encode() + bytes.fromhex("BCC3BC62") + b"...\n\n"


def _many(folder, n=60):
    """Two dumps, the second one cut off, with articles of several hits and values with line breaks."""
    pages = [(f"T{i}|a\\b" if i % 9 == 0 else f"T{i}", f"ISBN 3161484100, ISBN 978-3-16-148410-0 {{{{ISBN|3-16\n148410-{i % 10}}}}} Deutschland" * (i % 3))
             for i in range(n)]
    xml = [f"  <page><title>{t}</title><revision>{T}{x}</text></revision></page>\n" for t, x in pages]
    write_files(folder, {"b.xml": "".join(xml[n // 2:]) + "<page><title>open", "a.xml": "<m>" + "".join(xml[:n // 2]) + "</m>"})
    return pages


def test_ordered_output_needs_no_exchange_and_one_scan(spark, tmpdir_run):
    os.makedirs(os.path.join(tmpdir_run, "dump"))
    pages = _many(os.path.join(tmpdir_run, "dump"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("128MB", "500"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            articles = read_articles(spark, os.path.join(tmpdir_run, "dump"))
            isbns, out = extract_isbns(articles, "extended"), os.path.join(tmpdir_run, f"isbns{split}")
            n = write_isbn_lines(isbns, out, ordered=True, escape=True)
            want = [(t, v) for t, x in pages for v in _isbns(x)]
            back = read_isbn_lines(spark, out, escaped=True).orderBy("file_path", "file_block_start", "seq").collect()
            assert n == len(want) and [(r.title, r.isbn) for r in back] == want, split
            text = "".join(open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(out + "/*/*/part-*")))
            assert text.split("\n")[:-1] == [r.value for r in back] and text.count("\n") == n
            hits, found = search_kwic(articles, "Deutschland", 2), os.path.join(tmpdir_run, f"hits{split}")
            write_search_lines(hits, found, ordered=True)
            text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(found + "/*/*/part-*")))
            assert [x.split("\n")[0] for x in text.split("Article: ")[1:]] == [t for t, x in pages for _ in range(x.count("Deutschland"))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def _isbns(text):
    import brute

    return [v.decode() for v, _ in brute.extended_isbns(text.encode())]


def test_ordered_plan(spark, tmpdir_run):
    os.makedirs(os.path.join(tmpdir_run, "dump"))
    _many(os.path.join(tmpdir_run, "dump"))
    plans = []
    isbns = extract_isbns(read_articles(spark, os.path.join(tmpdir_run, "dump")), "basic")
    text = type(isbns.write).text
    try:
        def spy(writer, path, *a, **k):
            plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
            return text(writer, path, *a, **k)

        type(isbns.write).text = spy
        write_isbn_lines(isbns, os.path.join(tmpdir_run, "o"), ordered=True)
    finally:
        type(isbns.write).text = text
    assert len(plans) == 1 and plans[0].count("FileScan text") == 1
    assert "Exchange hashpartitioning" not in plans[0] and "Exchange rangepartitioning" not in plans[0]


def test_escape_is_reversible(spark):
    import random

    from pyspark.sql import functions as F

    from scriptorium.operators.isbn import escaped, unescaped

    rng = random.Random(3)
    texts = ["".join(rng.choice(["\\", "\n", "\r", "|", "n", "r", "p", "x", "ü"]) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not set(r.e) & set("\n\r|")
