"""Benchmark: the reference's three per-article jobs (and the two reports)
over a MediaWiki dump derived from ``$BENCH_SF_DIR``, on ``local[$BENCH_CPUS]``.

The dump holds ``$BENCH_ARTICLES`` articles (default one million): the
documents of the table, repeated under distinct ids. Every timed run is the
whole job, dump scan included: read the XML, split pages, extract title and
text, run the job, and consume every result row with Spark's ``noop`` sink (no
collect to the driver). Writing the dump is set-up and not timed. All jobs run
on the small dump of the table first (code compilation), then once on the
large one, timed. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from scriptorium.operators import reports  # noqa: E402
from scriptorium.operators.articles import read_articles  # noqa: E402
from scriptorium.operators.categories import category_stats, category_usage  # noqa: E402
from scriptorium.operators.isbn import extract_isbns  # noqa: E402
from scriptorium.operators.search import search_kwic  # noqa: E402
from scriptorium.plans.catalog import report_lines  # noqa: E402
from scriptorium.plans.fixtures import fixture_dump, wikitext, write_dump  # noqa: E402
from scriptorium.session import build_session, scratch_root  # noqa: E402
from scriptorium.sources.articles_table import read_articles_table, write_articles  # noqa: E402
from scriptorium.sources.dump import page_index  # noqa: E402

SEARCH_TERM = "erer"
SEARCH_CONTEXT = 100


def _sf_value(sf_dir: str):
    name = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        return float(name)
    except ValueError:
        return name


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def repeated(spark, sf_dir: str, articles: int, path: str) -> int:
    """Dump of ``articles`` articles at ``path``: the table's wikitext under new ids and titles."""
    wt = wikitext(spark, sf_dir).select("doc_id", "title", "text")
    n = wt.count()
    times = max(1, -(-articles // n))
    wt = wt.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select(
        (F.col("k") * n + F.col("doc_id")).alias("doc_id"), F.concat("title", F.lit(" "), F.col("k")).alias("title"), "text")
    write_dump(wt, path, pages_per_file=25_000)
    return n * times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    small = fixture_dump(spark, sf_dir)
    large = f"{scratch_root(spark)}/scriptorium/bench_dump"
    n_articles = repeated(spark, sf_dir, int(os.environ.get("BENCH_ARTICLES", "1000000")), large)
    size = sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in spark.read.text(large).inputFiles())
    lines = report_lines(spark, sf_dir)

    # the articles as Parquet, written once (not timed)
    tables = {d: write_articles(read_articles(spark, d), f"{d}-articles") for d in (small, large)}

    def reports_of(df: DataFrame) -> None:
        consume(reports.isbn_stats(df))
        consume(reports.isbn_top_articles(df, 10))
        consume(reports.isbn_format_distribution(df))

    jobs = {
        "scan_extract": lambda d: consume(read_articles(spark, d).select(F.octet_length("text").alias("n"))),
        "category_stats": lambda d: consume(category_stats(read_articles(spark, d))),
        "category_usage": lambda d: consume(category_usage(read_articles(spark, d))),
        "search_kwic": lambda d: consume(search_kwic(read_articles(spark, d), SEARCH_TERM, SEARCH_CONTEXT)),
        "search_kwic_bytes": lambda d: consume(search_kwic(read_articles(spark, d), SEARCH_TERM, SEARCH_CONTEXT, unit="bytes")),
        "isbn_basic": lambda d: consume(extract_isbns(read_articles(spark, d), "basic")),
        "isbn_extended": lambda d: consume(extract_isbns(read_articles(spark, d), "extended")),
        "page_index": lambda d: consume(page_index(spark, d)),
        "category_stats_parquet": lambda d: consume(category_stats(read_articles_table(spark, tables[d]))),
        "isbn_report": lambda d: reports_of(lines),
    }
    for fn in jobs.values():
        fn(small)
    results = {}
    for name, fn in jobs.items():
        t0 = time.perf_counter()
        fn(large)
        results[name] = round(time.perf_counter() - t0, 3)
    headline = ["category_stats", "search_kwic", "isbn_basic", "isbn_extended"]
    rates = {f"{k}_articles_per_s": round(n_articles / results[k]) for k in [*headline, "search_kwic_bytes", "scan_extract", "page_index", "category_stats_parquet"]}
    print(json.dumps({
        "metric": "dump_jobs_total_sec",
        "value": round(sum(results[k] for k in headline), 3),
        "unit": "sec",
        "queries": results,
        "sf": _sf_value(sf_dir),
        "articles": n_articles,
        "dump_mb": round(size / 1e6),
        "scan_mb_per_s": round(size / 1e6 / results["scan_extract"]),
        "cpus": int(cpus),
        "headline": headline,
        **rates,
    }))


if __name__ == "__main__":
    main()
