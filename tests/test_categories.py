"""Category counts, statistics, usage."""

from scriptorium.operators.categories import category_counts, category_stats, category_usage

SCHEMA = "title string, text string, file_path string, file_block_start long, seq long"


def _df(spark, rows):
    return spark.createDataFrame([(t, x, p, b, s) for t, x, p, b, s in rows], SCHEMA)


def test_stats_and_first_max(spark):
    rows = [
        ("none", "plain", "a", 0, 0),
        ("two-late", "[[Kategorie:A]] [[Kategorie:B]]", "b", 0, 0),
        ("two-first", "[[Kategorie:A]][[Kategorie:C|x]]", "a", 0, 5),
        ("one", "[[Kategorie:A]] [[kategorie:lower]] [[Category:en]]", "a", 100, 1),
    ]
    r = category_stats(_df(spark, rows)).collect()[0]
    assert (r.total_articles, r.articles_with_cats, r.total_categories, r.max_categories) == (4, 3, 5, 2)
    assert r.max_cat_article == "two-first"  # first in file order among the maxima
    assert r.pct_with_cats == 75.0 and abs(r.avg_per_article_with_cats - 5 / 3) < 1e-12
    usage = {x.category: x.n for x in category_usage(_df(spark, rows)).collect()}
    assert usage == {"A": 3, "B": 1, "C": 1}
    counts = {x.title: x.n for x in category_counts(_df(spark, rows)).collect()}
    assert counts == {"none": 0, "two-late": 2, "two-first": 2, "one": 1}


def test_stats_without_categories(spark):
    r = category_stats(_df(spark, [("x", "no links", "a", 0, 0)])).collect()[0]
    assert (r.articles_with_cats, r.total_categories, r.max_categories, r.max_cat_article) == (0, 0, 0, "")
    assert (r.pct_with_cats, r.avg_per_article_with_cats) == (0.0, 0.0)
    empty = category_stats(_df(spark, [("x", "y", "a", 0, 0)]).filter("false")).collect()[0]
    assert (empty.total_articles, empty.pct_with_cats, empty.max_cat_article) == (0, 0.0, "")


def test_custom_tag_non_overlapping(spark):
    r = category_counts(_df(spark, [("x", "aaaa", "a", 0, 0)]), tag="aa").collect()[0]
    assert r.n == 2


def test_stats_from_materialised_table(spark, tmpdir_run):
    from scriptorium.sources.articles_table import read_articles_table, write_articles

    rows = [("b", "[[Kategorie:A]][[Kategorie:B]]", "f2", 0, 1), ("a", "[[Kategorie:A]][[Kategorie:B]]", "f1", 0, 7),
            ("c", "none", "f1", 0, 3)]
    path = write_articles(_df(spark, rows), f"{tmpdir_run}/articles")
    direct = category_stats(_df(spark, rows)).collect()
    table = category_stats(read_articles_table(spark, path)).collect()
    assert direct == table and table[0].max_cat_article == "a"


def test_plain_title_text_table(spark):
    from scriptorium.operators.isbn import extract_isbns
    from scriptorium.operators.search import search_kwic

    df = spark.createDataFrame([("b", "[[Kategorie:A]] ISBN 3-16-148410-0"), ("a", "[[Kategorie:B]]")], "title string, text string")
    r = category_stats(df).collect()[0]
    assert (r.total_articles, r.max_categories, r.max_cat_article) == (2, 1, "a")
    assert [x.isbn for x in extract_isbns(df, "basic").collect()] == ["3-16-148410-0"]
    assert search_kwic(df, "Kategorie", 1).count() == 2


def test_usage_sums_to_the_links(spark):
    from scriptorium.operators.categories import category_stats, category_usage

    df = spark.createDataFrame([("t", "[[Kategorie:[[Kategorie:X]] [[Kategorie:Y|Z]]"), ("u", "none")], "title string, text string")
    used = {r.category: r.n for r in category_usage(df).collect()}
    assert sum(used.values()) == category_stats(df).collect()[0].total_categories == 3
    assert used["X"] == used["Y"] == 1
