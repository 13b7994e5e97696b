"""Jobs with state, byte-bounded batches, and number formatting in the plan."""

import math
import random
import struct

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.numbers import c_format
from scriptorium.operators.articles import aggregate_articles, byte_batches, per_article
from scriptorium.operators.categories import (category_stats, category_stats_by_state, category_summary, format_category_stats)

SCHEMA = "title string, text string, file_path string, file_block_start long, seq long"


def _numbers():
    rng = random.Random(5)
    out = [0.0, -0.0, 0.25, 0.5, 1.5, 2.5, 0.125, 0.375, 2.675, 1.005, 0.05, 0.15, 0.95, 9.995, 99.95, 0.1, 1 / 3, 1e-5, 5e-324, 1e-300, 123456789.125,
           2.0**52 + 0.5, 2.0**53, 2.0**62, 2.0**63, 2.0**64 + 2**20, 1e22, 1e30, 8e37, math.nan, math.inf, -math.inf, -0.25, -2.675, 100.0, 66.66666666666667,
           0.5 - 2**-54, 0.5 + 2**-53, 0.04999999999999999]
    out += [rng.uniform(-1000, 1000) for _ in range(300)] + [rng.randint(0, 10**6) / 2**rng.randint(0, 12) for _ in range(300)]
    while len(out) < 1200:
        x = struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0]
        if not math.isnan(x) and (abs(x) < 2.0**126):
            out.append(x)
    return out


@pytest.mark.parametrize("digits", [0, 1, 2, 6, 15])
def test_c_format_rounds_the_binary_value(spark, digits):
    xs = _numbers()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r.s for r in df.select("i", c_format(F.col("x"), digits).alias("s")).orderBy("i").collect()]
    bad = [(x, g, f"{x:.{digits}f}") for x, g in zip(xs, got) if g != f"{x:.{digits}f}"]
    assert not bad, bad[:5]


def test_c_format_edges(spark):
    df = spark.createDataFrame([(None,), (1e300,)], "x double")
    assert [r.s for r in df.select(c_format(F.col("x"), 2).alias("s")).collect()] == [None, None]
    for bad in (-1, 16, 1.5):
        with pytest.raises(ValueError):
            c_format(F.col("x"), bad)


def _articles(spark, n, parts):
    rng = random.Random(n)
    rows = [(f"T{rng.randint(0, 30)}", "x [[Kategorie:A]] " * rng.randint(0, 4), "f" if i < n // 2 else "g", i % 3, i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_category_stats_by_state(spark):
    for n, parts in ((0, 1), (1, 1), (40, 7), (400, 30)):
        a = _articles(spark, n, parts)
        assert category_stats_by_state(a).collect() == category_stats(a).collect(), n
    none = spark.createDataFrame([("t", "no link", "f", 0, 1)], SCHEMA)
    assert category_stats_by_state(none).collect() == category_stats(none).collect()


def test_states_are_merged_in_order_and_a_few_at_a_time(spark):
    """Concatenation is not commutative; each merge tells how many it has seen."""
    a = spark.range(0, 300, 1, 50).select(F.col("id").cast("string").alias("title"), F.lit("").alias("text"))
    got = aggregate_articles(a, list, lambda s, b: s + b["title"].tolist(), lambda x, y: x + y,
                             lambda s: pd.DataFrame({"all": [" ".join(s)]}), "all string", fan_in=3, levels=4).collect()
    assert [r["all"] for r in got] == [" ".join(str(i) for i in range(300))]
    plan = aggregate_articles(a, list, lambda s, b: s, lambda x, y: x, lambda s: pd.DataFrame({"n": [1]}), "n long", fan_in=3, levels=4)
    assert plan._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == 4
    with pytest.raises(ValueError):
        aggregate_articles(a, list, None, None, None, "n long", fan_in=1)


def test_byte_batches():
    sizes = [10, 2000, 10, 10, 5000, 1, 1, 900, 900, 900]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes])], names=["text"])
    parts = list(byte_batches(iter([batch]), 1000))
    assert [len(t) for p in parts for t in p["text"].to_pylist()] == sizes
    assert all(p.num_rows == 1 or p.nbytes <= 1000 for p in parts) and len(parts) < len(sizes)


def test_per_article_leaves_the_session_alone(spark):
    a = spark.createDataFrame([(f"t{i}", "x" * i) for i in range(50)], "title string, text string")
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    got = per_article(a, lambda b: pd.DataFrame({"n": b["text"].str.len(), "t": b["title"]}), "t string, n long")
    assert sorted((r.n, r.t) for r in got.collect()) == [(i, f"t{i}") for i in range(50)]
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before


def test_summary(spark):
    rows = [(f"A{i}", "[[Kategorie:x]]" * n, "f", 0, i) for i, n in enumerate([1, 0, 3, 0, 2, 0, 0, 1])]
    stats = category_stats(spark.createDataFrame(rows, SCHEMA))
    text = category_summary(stats).collect()[0].summary
    assert text == format_category_stats(stats) == (
        'Category Statistics:\nTotal articles: 8\nArticles with categories: 4 (50.0%)\nTotal categories: 7\n'
        'Average categories per article: 1.75\nMaximum categories: 3 in article "A2"\n')
