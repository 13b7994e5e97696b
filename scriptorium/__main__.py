"""Command line: the reference's actions and reports as Spark jobs.

    python -m scriptorium count-cats    <dump>
    python -m scriptorium search        <dump> <term> <context> [--out DIR] [--bytes]
    python -m scriptorium extract-isbns <dump> [--out DIR] [--dialect basic|extended]
    python -m scriptorium isbn-stats    <isbn-lines> [top_n]
    python -m scriptorium isbn-filter   <isbn-lines> <pattern> [--out DIR] [--on line|title]

(or through ``spark-submit``). Results that grow with the input (hits, ISBN
lines, filtered lines) are written as text folders; only one-row summaries,
the top-N list and the 10-line sample are printed.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import time

from scriptorium.operators import reports
from scriptorium.operators.articles import read_articles_observed
from scriptorium.operators.categories import category_stats, format_category_stats
from scriptorium.operators.isbn import extract_isbns
from scriptorium.operators.search import search_kwic, write_search_lines
from scriptorium.session import build_session
from scriptorium.sources.isbn_file import read_isbn_lines, write_isbn_lines


def _rate(label: str, obs, seconds: float) -> None:
    m = obs.get
    print(f"{label}: {m.get('articles', 0)} articles of {m.get('pages_found', 0)} pages in {seconds:.1f} s "
          f"({m.get('articles', 0) / max(seconds, 1e-9):,.0f} articles/s)")


def _count_cats(spark, a) -> None:
    t0 = time.time()
    arts, obs = read_articles_observed(spark, a.dump)
    print(format_category_stats(category_stats(arts)), end="")
    _rate("scan", obs, time.time() - t0)


def _search(spark, a) -> None:
    if a.context < 0:
        raise SystemExit("context must be >= 0")
    out = a.out or "search-" + re.sub(r"[^\w.-]", "_", a.term) + ".txt"
    t0 = time.time()
    arts, obs = read_articles_observed(spark, a.dump)
    n = write_search_lines(search_kwic(arts, a.term, a.context, unit="bytes" if a.bytes else "chars",
                                       decode_entities=a.decode), out, ordered=a.ordered)
    _rate(f"{n} hits in {out}", obs, time.time() - t0)


def _extract(spark, a) -> None:
    t0 = time.time()
    arts, obs = read_articles_observed(spark, a.dump)
    n = write_isbn_lines(extract_isbns(arts, a.dialect, decode_entities=a.decode, strict=a.strict), a.out, ordered=a.ordered)
    _rate(f"{n} ISBNs in {a.out}", obs, time.time() - t0)


# The labels of the two report scripts, here and in _filter.
def _stats(spark, a) -> None:
    lines = read_isbn_lines(spark, a.file)
    s = reports.isbn_stats(lines).collect()[0]
    print("=== ISBN Statistics ===\n")
    print(f"Total ISBNs found: {s.total}")
    print(f"Articles containing ISBNs: {s.articles}")
    if s.avg_per_article is not None:
        print(f"Average ISBNs per article: {s.avg_per_article:.2f}")
    print(f"\n=== Top {a.top_n} Articles by ISBN Count ===")
    for r in reports.isbn_top_articles(lines, a.top_n, collation=a.collation).collect():
        print(f"{r['count']:7d} {r['title']}")
    d = reports.isbn_format_distribution(lines).collect()[0]
    print("\n=== ISBN Format Distribution ===\n")
    pct = (lambda v: "n/a" if v is None else f"{v:.2f}")
    print(f"ISBN-13 format (starts with 978/979): {d.isbn13} ({pct(d.isbn13_pct)}%)")
    print(f"Other formats (likely ISBN-10): {d.other} ({pct(d.other_pct)}%)")
    print("\n=== Sample ISBNs ===")
    for r in reports.isbn_sample(lines, 10).collect():
        print(r.value)


def _filter(spark, a) -> None:
    matched = reports.isbn_filter(read_isbn_lines(spark, a.file), a.pattern, on=a.on, syntax=a.syntax)
    if a.out:
        matched.orderBy("file_path", "file_block_start", "seq").select("value").write.mode("overwrite").text(a.out)
    s = reports.isbn_filter_summary(matched).collect()[0]
    print(f"=== ISBNs from Articles Matching: '{a.pattern}' ===\n")
    if s.isbns == 0:
        print(f"No matches found for pattern: '{a.pattern}'")
        return
    print(f"Found {s.isbns} ISBNs in {s.articles} articles matching '{a.pattern}'")
    if a.out:
        print(f"Matching lines in {a.out}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scriptorium", description=__doc__.split("\n\n")[0])
    sub = p.add_subparsers(dest="action", required=True)
    c = sub.add_parser("count-cats")
    c.add_argument("dump")
    s = sub.add_parser("search")
    s.add_argument("dump")
    s.add_argument("term")
    s.add_argument("context", type=int)
    s.add_argument("--out")
    s.add_argument("--bytes", action="store_true", help="context in bytes, as the reference (may cut a character)")
    s.add_argument("--decode", action="store_true", help="search the text with its character references decoded")
    s.add_argument("--ordered", action="store_true", help="a folder per split, in dump order")
    e = sub.add_parser("extract-isbns")
    e.add_argument("dump")
    e.add_argument("--out", default="isbns.txt")
    e.add_argument("--dialect", choices=["basic", "extended"], default="basic")
    e.add_argument("--decode", action="store_true", help="read the text with its character references decoded")
    e.add_argument("--strict", action="store_true", help="check digits of the value without blanks and hyphens around it")
    e.add_argument("--ordered", action="store_true", help="a folder per split, in dump order")
    st = sub.add_parser("isbn-stats")
    st.add_argument("file")
    st.add_argument("top_n", nargs="?", type=int, default=10)
    st.add_argument("--collation", help="order of titles with as many ISBNs, as de or UNICODE (default: by bytes)")
    f = sub.add_parser("isbn-filter")
    f.add_argument("file")
    f.add_argument("pattern")
    f.add_argument("--out")
    f.add_argument("--on", choices=["line", "title"], default="line")
    f.add_argument("--syntax", choices=list(reports.SYNTAXES), default="java", help="ere: POSIX extended expressions")
    a = p.parse_args(argv)
    spark = build_session(master=os.environ.get("SCRIPTORIUM_MASTER"))
    {"count-cats": _count_cats, "search": _search, "extract-isbns": _extract,
     "isbn-stats": _stats, "isbn-filter": _filter}[a.action](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
