"""The command line front end over the operators."""

import glob
import os

from conftest import write_files

from scriptorium.__main__ import main

T = '<text xml:space="preserve">'


def test_cli_actions(spark, tmpdir_run, capsys):
    dump = os.path.join(tmpdir_run, "dump")
    os.makedirs(dump)
    pages = [("Berlin", "ISBN 978-3-16-148410-0 [[Kategorie:Stadt]] Spree"), ("Bonn", "{{BibISBN|3161484100}} Rhein")]
    write_files(dump, {"d.xml": "<mediawiki>\n" + "".join(
        f"  <page>\n    <title>{t}</title>\n    {T}{x}</text>\n  </page>\n" for t, x in pages) + "</mediawiki>\n"})
    assert main(["count-cats", dump]) == 0
    out = capsys.readouterr().out
    assert "Total articles: 2\n" in out and 'Maximum categories: 1 in article "Berlin"' in out
    isbns = os.path.join(tmpdir_run, "isbns")
    main(["extract-isbns", dump, "--out", isbns])
    text = "".join(open(p).read() for p in sorted(glob.glob(isbns + "/part-*")))
    assert text == "Berlin|978-3-16-148410-0\nBonn|3161484100\n"
    capsys.readouterr()
    main(["isbn-stats", isbns, "1"])
    out = capsys.readouterr().out
    assert "Total ISBNs found: 2" in out and "Average ISBNs per article: 1.00" in out
    assert "ISBN-13 format (starts with 978/979): 1 (50.00%)" in out
    main(["isbn-filter", isbns, "^Bonn"])
    assert "Found 1 ISBNs in 1 articles matching '^Bonn'" in capsys.readouterr().out
    hits = os.path.join(tmpdir_run, "hits")
    main(["search", dump, "Rhein", "2", "--out", hits])
    text = "".join(open(p).read() for p in sorted(glob.glob(hits + "/part-*")))
    assert text == "Article: Bonn\n...} Rhein...\n\n"


def test_cli_options(spark, tmpdir_run, capsys):
    dump = os.path.join(tmpdir_run, "dump")
    os.makedirs(dump)
    write_files(dump, {"d.xml": f"<page><title>\u00c4</title>{T}ISBN&amp;nbsp;9783161484100, {{{{ISBN|9780306406157 }}}} A&amp;B</text></page>\n"
                                f"<page><title>Z</title>{T}ISBN 3161484100</text></page>\n"})
    isbns = os.path.join(tmpdir_run, "isbns")
    main(["extract-isbns", dump, "--out", isbns, "--dialect", "extended", "--decode", "--strict", "--ordered"])
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(isbns + "/*/*/part-*")))
    assert text == "\u00c4|9783161484100\n\u00c4|9780306406157 \nZ|3161484100|CHECKSUM_WRONG\n"
    capsys.readouterr()
    main(["isbn-filter", isbns, "^[[:upper:]]\\|97", "--syntax", "ere"])
    assert "Found 2 ISBNs in 1 articles" in capsys.readouterr().out
    main(["isbn-stats", isbns, "--collation", "de"])
    assert "      2 \u00c4\n      1 Z\n" in capsys.readouterr().out
    hits = os.path.join(tmpdir_run, "hits")
    main(["search", dump, "A&B", "1", "--out", hits, "--decode", "--ordered"])
    assert "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(hits + "/*/*/part-*"))) == "Article: \u00c4\n... A&B...\n\n"
