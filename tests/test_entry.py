"""Driver contract, the streaming variant and the per-article hook."""

import os

import duckdb

import __spark_entry__ as E
from scriptorium.plans.catalog import QUERIES
from scriptorium.plans.fixtures import fixture_dump
from scriptorium.sources.dump import read_pages
from scriptorium.operators.articles import extract_articles
from scriptorium.streaming.articles import start_article_sink

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    r = E.entry(spark).collect()
    assert len(r) == 1 and r[0].total_articles == 200


def test_keys_match():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracles_small(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in QUERIES:
        df = E.queries()[name](spark, SF)
        got = sorted(tuple(str(v) for v in r) for r in df.select(sorted(df.columns)).collect())
        rel = con.sql(E.oracle_sql()[name])
        cols = rel.columns
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        exp = sorted(tuple(str(r[i]) for i in order) for r in rel.fetchall())
        assert got == exp, name


def test_stream_matches_batch(spark, tmpdir_run):
    dump = fixture_dump(spark, SF)
    q = start_article_sink(spark, dump, f"{tmpdir_run}/sink", f"{tmpdir_run}/ckpt")
    q.awaitTermination(300)
    streamed = sorted((r.title, r.text) for r in spark.read.parquet(f"{tmpdir_run}/sink").collect())
    batch = sorted((r.title, r.text) for r in extract_articles(read_pages(spark, dump)).collect())
    assert streamed == batch and len(batch) == 200


def test_stream_drops_open_ends_and_keeps_the_order_key(spark, tmpdir_run):
    import os

    from conftest import write_files
    from scriptorium.operators.articles import read_articles
    from scriptorium.sources.articles_table import read_articles_table

    folder = os.path.join(tmpdir_run, "in")
    os.makedirs(folder)
    page = "<page><title>{0}</title><text>t{0}</text></page>\n"
    write_files(folder, {"a.xml": page.format("A") + page.format("B"), "b.xml": page.format("C") + "<page><title>cut</title><text>x</text>",
                         "c.xml": page.format("D") + page.format("D")[:-8]})
    q = start_article_sink(spark, folder, f"{tmpdir_run}/sink", f"{tmpdir_run}/ckpt", max_files_per_trigger=1)
    q.awaitTermination(300)
    got = read_articles_table(spark, f"{tmpdir_run}/sink")
    want = read_articles(spark, folder)
    rows = lambda df: sorted((r.file_path.rsplit("/", 1)[1], r.title, r.text) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(want)) == 4
    assert got.where("file_path LIKE '%a.xml'").orderBy("seq").first().title == "A"


def test_queries_work_without_a_package_of_the_optional_part():
    import subprocess
    import sys

    code = ("import sys, warnings; sys.modules['xxhash'] = None\n"
            "with warnings.catch_warnings(record=True) as w:\n    warnings.simplefilter('always')\n    import __spark_entry__ as E\n"
            "print(len(E.queries()), 'op2_simhash' in E.queries(), len(w))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)
    assert out.stdout.split() == [str(len(QUERIES)), "False", "1"], out.stderr[-500:]
