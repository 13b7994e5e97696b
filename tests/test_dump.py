"""Page split, page index and title/text extraction."""

import random

from conftest import write_files

import brute
from scriptorium.operators.articles import extract_articles, read_articles, scan_counters
from scriptorium.sources.dump import page_index, read_pages

T = '<text bytes="1" xml:space="preserve">'


def page(title, text):
    return f"  <page>\n    <title>{title}</title>\n    <ns>0</ns>\n    <revision>\n      {T}{text}</text>\n    </revision>\n  </page>\n"


def articles_of(spark, folder, **kw):
    key = ["file_path", "file_block_start", "seq"]
    rows = extract_articles(read_pages(spark, folder, **kw)).orderBy(*key).collect()
    direct = read_articles(spark, folder, **kw).orderBy(*key).collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in direct]  # same rows, same order key
    return [(r.title, r.text) for r in rows]


def test_edge_pages(spark, tmpdir_run):
    body = (
        "<mediawiki><title>before first page</title>\n"
        + page("A &amp; B", "text with &lt;b&gt;")
        + "  <page><title>selfclosing</title><revision><text bytes=\"0\" /></revision></page>\n"
        + "  <page><title>empty</title><revision><text></text></revision></page>\n"
        + "  <page><ns>0</ns><revision><text>no title</text></revision></page>\n"
        + "  <page><title>two</title><revision><text>first</text></revision><revision><text>second</text></revision></page>\n"
        + "  <page><title>late</title><text a=\"1\" /></revision><revision><text>late</text></page>\n"
        + "  </page>\n"  # stray closing tag
        + "  <page><title></title><text>untitled</text></page>\n"
        + "  <page><title>spill</title><text>x</page> <text>after the page</text>\n"
        + "  <page><title>cut off</title><text>complete text</text>\n"  # no </page>: truncated file
    )
    write_files(tmpdir_run, {"dump.xml": body})
    got = articles_of(spark, tmpdir_run)
    assert got == [
        ("A &amp; B", "text with &lt;b&gt;"),
        ("empty", ""),
        ("two", "first"),
        ("late", "</revision><revision><text>late"),
        ("", "untitled"),
    ]
    counters = scan_counters(read_pages(spark, tmpdir_run)).collect()[0]
    assert (counters.pages_found, counters.articles) == (8, 5)


def test_leading_fragment_guard(spark, tmpdir_run):
    # a file that starts in the middle of a page
    body = "<title>X</title><text>inside</text></page>\n" + page("B", "b")
    write_files(tmpdir_run, {"tail.xml": body})
    assert articles_of(spark, tmpdir_run) == [("B", "b")]
    idx = page_index(spark, tmpdir_run).collect()
    start = body.encode().find(b"<page>")
    assert [(r.start_pos, r.length) for r in idx] == [(start, len(body.encode()) - start - 1)]


def _random_dump(rng, n):
    words = ["alpha", "Beta", "ISBN 3-16-148410-0", "&amp;", "ü", "[[Kategorie:X]]", "\n", "<b>"]
    parts = ["<mediawiki>\n  <siteinfo>x</siteinfo>\n"]
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        parts.append(page(f"P{i} é", text.replace("<", "&lt;")))
    parts.append("</mediawiki>\n")
    return "".join(parts).encode("utf-8")


def test_split_size_does_not_change_results(spark, tmpdir_run):
    rng = random.Random(7)
    data_a, data_b = _random_dump(rng, 120), _random_dump(rng, 40)[:-30]  # second file cut off
    write_files(tmpdir_run, {"a.xml": data_a, "b.xml": data_b})
    expected = {}
    for name, data in (("a.xml", data_a), ("b.xml", data_b)):
        expected[name] = [(s, len(p)) for s, p in brute.split_pages(data)]
    exp_articles = [brute.extract(p) for d in (data_a, data_b) for _, p in brute.split_pages(d)]
    exp_articles = [(t.decode(), x.decode()) for t, x in (a for a in exp_articles if a)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("128MB", "4096", "300"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert articles_of(spark, tmpdir_run) == exp_articles, split
            idx = page_index(spark, tmpdir_run).orderBy("file_path", "file_block_start", "seq").collect()
            got = {}
            for r in idx:
                got.setdefault(r.file_path.rsplit("/", 1)[1], []).append((r.start_pos, r.length))
            assert got == expected, split
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_multistream_bz2_matches_plain(spark, tmpdir_run):
    import bz2
    import os

    rng = random.Random(5)
    data = _random_dump(rng, 400)
    # multistream layout: independent bz2 streams, concatenated
    cuts = [0] + sorted(rng.sample(range(1, len(data)), 6)) + [len(data)]
    packed = b"".join(bz2.compress(data[a:b], 1) for a, b in zip(cuts, cuts[1:]))
    plain_dir, bz_dir = os.path.join(tmpdir_run, "plain"), os.path.join(tmpdir_run, "bz")
    os.makedirs(plain_dir)
    os.makedirs(bz_dir)
    write_files(plain_dir, {"d.xml": data})
    write_files(bz_dir, {"d.xml.bz2": packed})
    expected = [brute.extract(p) for _, p in brute.split_pages(data)]
    expected = [(t.decode(), x.decode()) for t, x in (a for a in expected if a)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        expected_index = [(s0, len(p)) for s0, p in brute.split_pages(data)]
        for split in ("128MB", "2048"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            assert articles_of(spark, plain_dir) == expected, split
            assert articles_of(spark, bz_dir) == expected, split
            idx = page_index(spark, bz_dir).orderBy("file_block_start", "seq").collect()
            assert [(r.start_pos, r.length) for r in idx] == expected_index, split
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_observed_counters(spark, tmpdir_run):
    from scriptorium.operators.articles import read_articles_observed
    from scriptorium.operators.isbn import extract_isbns

    body = page("A", "ISBN 978-3-16-148410-0") + page("B", "x") + "  <page><title>C</title></page>\n"
    write_files(tmpdir_run, {"d.xml": body})
    arts, obs = read_articles_observed(spark, tmpdir_run)
    n_isbns = extract_isbns(arts, "basic").count()
    assert n_isbns == 1
    assert obs.get == {"pages_found": 3, "articles": 2}


def test_split_summaries_carry_across_batches():
    import pandas as pd

    from scriptorium.sources.dump import _split_summaries

    rows = [(1, 1, 10), (1, 2, 20), (1, 3, 30), (2, 9, 5), (3, 4, 7), (3, 5, 8)]
    df = pd.DataFrame(rows, columns=["split", "seq", "w"]).assign(page_at=0, length=1, file_path="f", file_block_start=0, file_size=9)
    for cut in range(0, len(rows) + 1):
        out = pd.concat(list(_split_summaries(iter([df.iloc[:cut], df.iloc[cut:]]))))
        pages, sums = out[out["bytes"].isna()], out[out["bytes"].notna()]
        assert pages["local_off"].tolist() == [0, 10, 30, 0, 0, 7], cut
        assert sums[["split", "bytes", "seq"]].astype(int).values.tolist() == [[1, 60, 3], [2, 5, 9], [3, 15, 5]], cut


def test_missing_close_tag_mid_file(spark, tmpdir_run):
    # page A runs on to the next closing tag
    body = "<page><title>A</title><text>a</text> " + page("B", "b") + page("C", "c")
    write_files(tmpdir_run, {"m.xml": body})
    assert articles_of(spark, tmpdir_run) == [("A", "a"), ("C", "c")]


def test_ends_of_files(spark, tmpdir_run):
    whole = page("A", "a").strip()
    files = {"exact.xml": whole,                                   # ends at </page>
             "cut.xml": whole + "<page><title>B</title><text>b</text>",     # ends inside a page
             "same.xml": whole + "\n" + whole[:-len("</page>")],           # an open end equal to a page
             "bom.xml": b"\xef\xbb\xbf" + ("<m>" + whole + "\n</m>").encode(),
             "none.xml": "<mediawiki></mediawiki>", "empty.xml": ""}
    write_files(tmpdir_run, files)
    assert articles_of(spark, tmpdir_run) == [("A", "a")] * 4
    got = {}
    for r in page_index(spark, tmpdir_run).collect():
        got.setdefault(r.file_path.rsplit("/", 1)[1], []).append((r.start_pos, r.length))
    for name, data in files.items():
        data = data if isinstance(data, bytes) else data.encode()
        assert got.get(name, []) == [(s, len(p)) for s, p in brute.split_pages(data)], name


def test_malformed_pages_against_brute_force(spark, tmpdir_run):
    # tags in random order, repeated or missing: the byte fast path must hand
    # every page it cannot prove to the exact rule
    rng = random.Random(29)
    frags = ["<title>", "</title>", "<text>", "<text a='1'>", "<text/>", "</text>", "</page>", ">", "<",
             "x", "ü", " ", "\n", "<textarea>", "</tit", "le>", "Kategorie"]
    pages_ = []
    for _ in range(300):
        body = "".join(rng.choice(frags) for _ in range(rng.randint(0, 14)))
        if rng.random() < 0.8:
            body = "<title>T" + body
        pages_.append("<page>" + body + ("</page>\n" if rng.random() < 0.9 else "\n"))
    data = ("<mediawiki>\n" + "".join(pages_) + "</mediawiki>\n").encode("utf-8")
    write_files(tmpdir_run, {"r.xml": data})
    got_rows = articles_of(spark, tmpdir_run)
    expected = [brute.extract(p) for _, p in brute.split_pages(data)]
    assert got_rows == [(t.decode(), x.decode()) for t, x in (a for a in expected if a)]


def test_text_tag_length(spark, tmpdir_run):
    # start tags around the 512 bytes that the fast path looks through
    pages_ = "".join(f"<page><title>T{n}</title><text a='{'y' * n}'>x{n}</text></page>\n" for n in range(490, 530))
    write_files(tmpdir_run, {"t.xml": pages_})
    assert articles_of(spark, tmpdir_run) == [(f"T{n}", f"x{n}") for n in range(490, 530)]


def _scans(df):
    """Text scans of the executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return final.count("FileScan text")


def test_plain_dump_is_scanned_once(spark, tmpdir_run):
    write_files(tmpdir_run, {"whole.xml": "<m>" + page("A", "a") * 3 + "</m>", "cut.xml": page("B", "b") + "<page><title>C</title><text>c</text>"})
    assert _scans(read_articles(spark, tmpdir_run)) == 1
    assert articles_of(spark, tmpdir_run) == [("B", "b")] + [("A", "a")] * 3
    assert _scans(page_index(spark, tmpdir_run)) == 0  # its one scan is in the checkpoint it wrote


def test_open_end_equal_to_earlier_pages(spark, tmpdir_run):
    one = "\n<page><title>A</title><text>a</text>"
    whole = "</page>".join([one] * 40)
    files = {"a.xml": "<m>" + whole, "b.xml": whole, "c.xml": b"\xef\xbb\xbf" + one[1:].encode() + b"</page>" + one[1:].encode()}
    write_files(tmpdir_run, files)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("128MB", "300", "97"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = read_pages(spark, tmpdir_run).orderBy("file_path", "file_block_start", "seq").collect()
            got = {}
            for r in page_index(spark, tmpdir_run).orderBy("file_path", "file_block_start", "seq").collect():
                got.setdefault(r.file_path.rsplit("/", 1)[1], []).append((r.start_pos, r.length))
            for name, data in files.items():
                data = data if isinstance(data, bytes) else data.encode()
                want = brute.split_pages(data)
                assert [r.page.encode() for r in rows if r.file_path.endswith(name)] == [p for _, p in want], (split, name)
                assert got.get(name, []) == [(s, len(p)) for s, p in want], (split, name)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_many_files_ends_are_read_by_tasks(spark, tmpdir_run, monkeypatch):
    from scriptorium.sources import dump

    files = {f"f{i:03}.xml": page(f"P{i}", "x") + (page("open", "y")[:-12] if i % 7 == 0 else "") for i in range(90)}
    write_files(tmpdir_run, files)
    ends = dump.file_ends(spark, tmpdir_run)
    assert sorted(e.path.rsplit("/", 1)[1] for e in ends) == [n for i, n in enumerate(files) if i % 7 == 0] and not any(e.twin for e in ends)
    want = [(f"P{i}", "x") for i in range(90)]
    assert articles_of(spark, tmpdir_run) == want
    monkeypatch.setattr(dump, "LISTED_ENDS", 5)  # too many for a list: a table
    assert articles_of(spark, tmpdir_run) == want


def test_ends_of_unreadable_and_packed_files_are_scanned(spark, tmpdir_run, monkeypatch):
    import gzip

    from scriptorium.sources import dump

    cut = page("A", "a") + page("B", "b") + "<page><title>C</title><text>c</text>"
    write_files(tmpdir_run, {"a.xml.gz": gzip.compress(cut.encode()), "b.xml": cut, "c.xml": page("D", "d"), "d.xml": "no page"})

    def no(uri):
        raise OSError("not from here")

    monkeypatch.setattr(dump, "_open", no)
    assert articles_of(spark, tmpdir_run) == [("A", "a"), ("B", "b")] * 2 + [("D", "d")]
    assert page_index(spark, tmpdir_run).count() == 5


def test_file_end_reads_back_to_the_last_closing_tag(tmpdir_run):
    import hashlib

    from scriptorium.sources.dump import file_end

    rng = random.Random(8)
    for i in range(300):
        data = b"".join(rng.choice([b"<page>", b"</page>", b"x", b"\n", b"</pa", b"<page", b"\xef\xbb\xbf"]) for _ in range(rng.randint(0, 30)))
        name = f"{i}.xml"
        write_files(tmpdir_run, {name: data})
        got = file_end(f"file:{tmpdir_run}/{name}", 10, block=rng.choice([1, 3, 64]))
        cut = data.rfind(b"</page>")
        rest = data[cut + 7:] if cut >= 0 else data.removeprefix(b"\xef\xbb\xbf")
        if b"<page>" not in rest:
            assert got is None, data
        else:
            assert (got.start, got.size, got.digest) == (cut + 7 if cut >= 0 else 0, len(rest), hashlib.md5(rest).hexdigest()), data
