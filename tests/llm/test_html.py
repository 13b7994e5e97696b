"""Block parsing on hand-written pages, gradients of the labeller, accuracy on
layouts it has not seen, and the whole operator against the SQL of the given
pages and on nulls, empty, damaged and very long pages."""

import random

import duckdb
import numpy as np
import pytest

from scriptorium.llm import htmltext
from scriptorium.llm.htmlblocks import page_blocks
from scriptorium.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
POOL = [[f"{a}{b}" for a in "bdfgklm" for b in ("a", "en", "ou.", "ité", "er,")], "The quick brown fox jumps over the lazy dog.".split()]


@pytest.fixture(scope="module")
def net(spark):
    return htmltext.fit(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("page, texts", [
    (None, []), ("", []), ("plain  text\n", ["plain text"]),
    ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
    ("<ul><li>x<li>y <b>z</ul>t", ["x", "y z", "t"]),
    ("a<br>b<hr>c", ["a b", "c"]),
    ("<script>if(a<b){}</script>ok<style>p{}</style> on<script>open <p>", ["ok on"]),
    ("<title>t</title><!-- <p> -->z<!-- open <p>q", ["z"]),
    ("a &lt;b&gt; &amp;amp; &#252;&nbsp;&am &amp", ["a <b> &amp; ü &am &"]),
    ("<a title='x > y'>q</a> 3 < 4 <p", ["q 3 < 4 <p"]),
    ("</div></p>x</b>", ["x"]), ("<TD>1<td>2<TR><td>3", ["1", "2", "3"]),
    ("<p><b>one<br></article><p>two", ["one", "two"]),
    ("<noscript>hidden</noscript>x<noscript>shown", ["xshown"])])
def test_blocks(page, texts):
    assert [b.text for b in page_blocks(page)] == texts


def test_paths_and_links():
    b = page_blocks('<nav id="main-nav"><a href=x>go</a> on</nav><div class="siteFooter x">y<p>z</div>')
    assert [sorted(x.node.path) for x in b] == [[".main", ".nav", "nav"], [".footer", ".site", ".x", "div"], [".footer", ".site", ".x", "div", "p"]]
    assert [x.links for x in b] == [2, 0, 0]


@pytest.mark.parametrize("page", ["<a " * 200_000, "<div>" * 50_000 + "</x>" * 50_000, "<p><b>" * 50_000, "<ul><li><b>" * 30_000, "<noscript>" * 20_000,
                                  "<!--" * 50_000, "&" * 100_000, "<p class='" * 50_000])
def test_odd_pages_end(page):
    page_blocks(page)


def test_gradients():
    samples = htmltext.invented(POOL, 3, seed=4)
    f, y = htmltext._join(samples, np.random.default_rng(0))
    net = htmltext.Labeller()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.gradients(f, y)
    for k, x in g.items():
        i = np.unravel_index(np.abs(x).argmax(), x.shape)
        old, e, loss = net.p[k][i], 1e-4, []
        for d in (e, -e):
            net.p[k][i] = old + d
            loss.append(net.gradients(f, y)[0])
        net.p[k][i] = old
        assert abs((loss[0] - loss[1]) / (2 * e) - x[i]) < 1e-4 + 0.01 * abs(x[i]), k


def test_unseen_layouts(net):
    test = htmltext.invented(POOL, 200, seed=1234)
    right = sum(int(((net.scores(f) >= 0.5) == y).sum()) for f, y in test)
    assert right / sum(len(y) for _, y in test) >= 0.97


def test_hand_written_page(net):
    words = random.Random(3)
    prose = lambda n: " ".join(words.choice(POOL[0]) for _ in range(n))
    keep = [prose(6), prose(60), prose(40), prose(2) + " &", prose(80)]
    page = (f"<html><head><title>{keep[0]}</title><style>x</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=1>{prose(1)}</a>"
            f"<li><a href=2>{prose(1)}</a></ul></nav><div class='cookie-notice'>We use cookies</div><article><h1>{keep[0]}</h1><p>{keep[1]}"
            f"<div class=advert>{prose(9)}</div><p>{keep[2]}<br></p><h2>{prose(0)}{keep[3].replace('&', '&amp;')}</h2><p>{keep[4]}</p></article>"
            f"<section class=comments><p>{prose(12)}</p><form>Name <input><button>Send</button></form></section>"
            f"<aside class=sidebar><ul><li>{prose(3)}</li></ul></aside><footer>&copy; {prose(4)}</footer></body></html>")
    assert htmltext.main_texts([page], net) == ["\n\n".join(keep)]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    df = QUERIES["op11_html"](spark, SF)
    rel = con.sql(ORACLES["op11_html"])
    assert df.columns == rel.columns and df.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_edges(spark, net):
    long = "<article>" + "".join(f"<p>word {i} of a long text, and more of it.</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "u", None, 1, "t"), (1, "u", None, 1, "t"), (2, None, "", 2, None), (None, None, "<nav><a href=x>menu</a></nav>", 3, "x"),
            (None, None, "<nav><a href=x>menu</a></nav>", 3, "x"), (3, "v", long, 4, "text"), (4, "v", "<script>x", 5, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = htmltext.extract_text(df, net)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    r = sorted((x["page_id"] or 0, x["text"], x["n_chars"]) for x in got.collect())
    assert [x[:2] for x in r if x[0] != 3] == [(0, ""), (0, ""), (1, ""), (1, ""), (2, ""), (4, "")]
    text = next(x for x in r if x[0] == 3)[1]
    assert text.count("\n\n") == 29_999 and text.endswith("word 29999 of a long text, and more of it.")
    none = df.where("false")
    assert htmltext.extract_text(none, htmltext.fit(none)).collect() == []


def test_fit_again_is_equal(spark, net):
    again = htmltext.fit(spark.read.parquet(f"{SF}/pages.parquet").repartition(5))
    assert all(np.array_equal(net.p[k], again.p[k]) for k in net.p)
