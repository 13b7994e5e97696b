"""A second derived wikitext with what real dumps hold beside the plain
notations: several and overlapping ISBNs an article, values with blanks
behind them, character references, category links with sort keys and inside
each other, and pages with a later revision. Queries over its dump, and their
oracles, which state the expected rows from what was planted.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.entities import decode_columns
from scriptorium.functions.isbn import checksum_steps
from scriptorium.operators.articles import read_articles
from scriptorium.functions.numbers import c_format
from scriptorium.operators import reports
from scriptorium.operators.categories import (category_counts, category_stats, category_stats_by_state, category_summary,
                                              category_usage)
from scriptorium.operators.isbn import extract_isbns
from scriptorium.operators.search import search_kwic, write_search_lines
from scriptorium.plans.fixtures import (DUMP_FOOTER, DUMP_HEADER, ISBN_SQL, _exists, _stamp, code_tag, dump_tasks,
                                        file_part, wikitext_sql)
from scriptorium.session import scratch_root
from scriptorium.sources.isbn_file import read_isbn_lines, write_isbn_lines

# (condition on doc_id, stored line, line with its references decoded)
_LINES = (
    ("true", "concat('ISBN ', i13, '; ISBN-10: ', i10, '.')", None),
    ("doc_id % 3 = 0", "concat('ISBN&amp;nbsp;', k13, ',')", "concat('ISBN&nbsp;', k13, ',')"),
    ("doc_id % 4 = 1", "concat('{{ISBN|ISBN=', i10, '}}')", None),
    ("doc_id % 5 = 2", "concat('{{ISBN|', k13, ' }}')", None),
    ("doc_id % 7 = 3", "concat('ISBN ', k13, ' -- y')", None),
    ("doc_id % 6 = 4", "concat('isbn=', i13, '|')", None),
    ("true", "'R&amp;D &#233;t&#xE9; &lt;b&gt; &amp;amp;'", "'R&D été <b> &amp;'"),
    ("true", "repeat(concat('[[Kategorie:', source, '|Sort ', cast(doc_id AS varchar(20)), ']]', chr(10)), cast(doc_id % 3 AS int))", None),
    ("doc_id % 8 = 5", "'[[Kategorie:[[Kategorie:inner]]]]'", None),
)

# Values found in text order: (line, condition, value, verdict, strict verdict), per way of reading.
_LAST10 = "c10 <> 10"  # the basic dialect takes no value that ends in X
_EXTENDED = ((0, "true", "i13", "true"), (0, "true", "i10", "true"), (2, "doc_id % 4 = 1", "concat('ISBN=', i10)", "true"),
             (2, "doc_id % 4 = 1", "i10", "true"), (3, "doc_id % 5 = 2", "concat(k13, ' ')", "right(k13, 1) = '0'"),
             (4, "doc_id % 7 = 3", "k13", "true"), (5, "doc_id % 6 = 4", "i13", "true"))
_DECODED = tuple(sorted((*_EXTENDED, (1, "doc_id % 3 = 0", "k13", "true")), key=lambda x: x[0]))
_BASIC = ((0, "true", "i13", "CAST(NULL AS BOOLEAN)"), (2, f"doc_id % 4 = 1 AND {_LAST10}", "i10", "CAST(NULL AS BOOLEAN)"),
          (4, "doc_id % 7 = 3", "k13", "CAST(NULL AS BOOLEAN)"))

LATER = "<revision><text>ISBN 3161484100 [[Kategorie:Later]] R&amp;D</text></revision>"
TERM = "R&D été"
CONTEXT = 12
FILTER_ERE = "^Q&amp;A [[:digit:]]*[05]\\|978-?[[:digit:]]+(-[0-9]{1,4}){2,}+|[Xx]$"


_TITLE = "concat('Q&amp;A ', cast(doc_id AS varchar(20)))"
_STORED, _READ = (" || ".join(f"CASE WHEN {when} THEN {line} || chr(10) ELSE '' END" for when, line in
                              ((w, (a if k == 0 else b or a)) for w, a, b in _LINES)) for k in (0, 1))
_TEXT = f"replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || {_STORED}"


def rich_sql(documents: str = "documents") -> str:
    """Portable SQL (Spark and DuckDB): ``doc_id, title, text, decoded, source,
    i10, i13, k13, c10``; ``text`` as stored in a dump, ``decoded`` as read."""
    return (f"WITH w AS ({wikitext_sql(documents)}), o AS (SELECT doc_id AS d, coalesce(text, '') AS body FROM {documents}), "
            f"k AS (SELECT w.*, o.body, replace(i13, '-', '') AS k13 FROM w JOIN o ON w.doc_id = o.d) "
            f"SELECT doc_id, {_TITLE} AS title, "
            f"{_TEXT} AS text, "
            f"body || chr(10) || {_READ} AS decoded, source, i10, i13, k13, c10 FROM k")


def dump_lines(documents: DataFrame, tasks: int) -> DataFrame:
    """``part, value``: the lines of the rich dump's files, each file whole and
    in order within one partition. The pages are those of ``rich_sql``, whose
    join of the documents with themselves gives a doc_id that m rows share a
    page for each of their m texts with each of their m sources.

    A text is shuffled and sorted once: in its file's task the sources of a
    doc_id are put beside it, and the file's first and last rows get its
    header and footer. ``tasks`` bounds what a task sorts.
    """
    in_file, in_doc = Window.partitionBy("part").orderBy("doc_id"), Window.partitionBy("part", "doc_id")
    rows = (documents.where("doc_id IS NOT NULL").select(file_part().alias("part"), "doc_id", "text", "source")
                     .repartition(tasks, "part")
                     .withColumn("opens", F.lag("doc_id").over(in_file).isNull())
                     .withColumn("closes", F.lead("doc_id").over(in_file).isNull())
                     # in structs: a list of plain values would lose the nulls
                     .withColumn("sources", F.collect_list(F.struct("source")).over(in_doc)["source"]))
    view = "scriptorium_rich_" + uuid.uuid4().hex
    rows.createOrReplaceTempView(view)
    isbns = ISBN_SQL.format(documents=view, more=", part, opens, closes, sources")
    k = rows.sparkSession.sql(f"{isbns} SELECT *, coalesce(text, '') AS body, replace(i13, '-', '') AS k13 FROM e")
    rows.sparkSession.catalog.dropTempView(view)
    page = (f"concat('  <page><title>', {_TITLE}, '</title><id>', doc_id, '</id><revision><text xml:space=\"preserve\">', {_TEXT}, "
            f"'</text></revision>', CASE WHEN doc_id % 6 = 1 THEN '{LATER}' ELSE '' END, '</page>')")
    # a page that comes out null is an empty line
    pages = F.expr(f"array_join(transform(sources, source -> coalesce({page}, '')), chr(10))")
    value = F.concat(F.when(F.col("opens"), DUMP_HEADER + "\n").otherwise(""), pages, F.when(F.col("closes"), "\n" + DUMP_FOOTER).otherwise(""))
    return k.sortWithinPartitions("part", "doc_id").select("part", value.alias("value"))


def rich_dump(spark: SparkSession, sf_dir: str) -> str:
    """Path of the rich dump for ``sf_dir`` in the shared scratch folder,
    written once per scratch folder, input version and writer code."""
    table = sf_dir.rstrip("/") + "/documents.parquet"
    tag = f"{_stamp(spark, table)}|{code_tag('plans/fixtures.py', 'plans/rich.py')}"
    path = f"{scratch_root(spark)}/scriptorium/dumps/rich-{hashlib.sha1(tag.encode()).hexdigest()[:16]}"
    if not _exists(spark, path + "/_SUCCESS"):
        dump_lines(spark.read.parquet(table), dump_tasks(spark, table)).write.mode("overwrite").partitionBy("part").text(path)
    return path


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_articles(spark, rich_dump(spark, sf_dir))


def q_isbn_dense(spark, sf_dir):
    """Several and overlapping ISBNs an article, with the reference's verdict
    and the strict one."""
    found = extract_isbns(_articles(spark, sf_dir), "extended")
    return found.selectExpr("*", *checksum_steps("isbn", "checksum_strict", strict=True)).select(
        "title", "hit_no", "isbn", "checksum_valid", "checksum_strict")


def q_isbn_dense_basic(spark, sf_dir):
    return extract_isbns(_articles(spark, sf_dir), "basic").select("title", "hit_no", "isbn", "checksum_valid")


def q_isbn_decoded(spark, sf_dir):
    """``ISBN&nbsp;`` is found in decoded text only; strict verdicts."""
    return extract_isbns(_articles(spark, sf_dir), "extended", decode_entities=True, strict=True).select(
        "title", "hit_no", "isbn", "checksum_valid")


def q_entity_decode(spark, sf_dir):
    return decode_columns(_articles(spark, sf_dir)).select("title", "text")


def q_search_decoded(spark, sf_dir):
    """A term that the stored text does not hold."""
    return search_kwic(_articles(spark, sf_dir), TERM, CONTEXT, decode_entities=True).select(
        "title", "match_no", "match_pos", "context")


def q_category_counts_rich(spark, sf_dir):
    return category_counts(_articles(spark, sf_dir)).select("title", "n")


def q_category_usage_rich(spark, sf_dir):
    return category_usage(_articles(spark, sf_dir))


def q_category_summary(spark, sf_dir):
    """The summary text, rounded in the plan."""
    return category_summary(category_stats(_articles(spark, sf_dir)))


def q_category_stats_state(spark, sf_dir):
    """The statistics through a job with state."""
    return category_stats_by_state(_articles(spark, sf_dir))


def q_number_format(spark, sf_dir):
    """Numbers of the documents, many of them halfway between two decimals."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    n = F.col("n_chars")
    return docs.select("doc_id", c_format(n / 8, 1).alias("eighths_1"), c_format(n / 8, 2).alias("eighths_2"),
                       c_format(n / 1000, 2).alias("thousandths_2"), c_format(-n / 7, 6).alias("sevenths_6"), c_format(n / 2, 0).alias("halves_0"))


def q_isbn_filter_ere(spark, sf_dir):
    """Lines by a POSIX expression with classes, intervals and repeats of repeats."""
    lines = _lines(spark, sf_dir)
    return reports.isbn_filter(lines, FILTER_ERE, syntax="ere").select("value", "title")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_isbn_lines(spark, rich_lines(spark, sf_dir))


def rich_lines(spark: SparkSession, sf_dir: str) -> str:
    """ISBN lines of the rich dump in the shared scratch folder, in dump order
    and escaped; written once per dump and code."""
    dump = rich_dump(spark, sf_dir)
    code = code_tag("sources/dump.py", "operators/articles.py", "functions/isbn.py", "operators/isbn.py", "sources/isbn_file.py",
                    "sources/ordered.py")
    path = f"{scratch_root(spark)}/scriptorium/isbn_lines/rich-{hashlib.sha1((dump + code).encode()).hexdigest()[:16]}"
    if not _exists(spark, path + "/_SUCCESS"):
        write_isbn_lines(extract_isbns(_articles(spark, sf_dir), "extended"), path, ordered=True, escape=True)
    return path


def q_isbn_lines_ordered(spark, sf_dir):
    """Lines written in dump order, read back with their place in the files."""
    lines = _lines(spark, sf_dir)
    place = F.row_number().over(Window.orderBy(*reports.LINE_ORDER)).cast("long")
    return lines.select(place.alias("line_no"), "value")


def q_search_lines_ordered(spark, sf_dir):
    """Search output written in dump order, read back line by line."""
    hits = search_kwic(_articles(spark, sf_dir), TERM, CONTEXT, decode_entities=True)
    path = f"{scratch_root(spark)}/scriptorium/search_lines/{uuid.uuid4().hex}"
    write_search_lines(hits, path, ordered=True)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"),
                                         F.col("_metadata.file_block_start").alias("file_block_start"),
                                         F.monotonically_increasing_id().alias("seq"))
    place = F.row_number().over(Window.orderBy(*reports.LINE_ORDER)).cast("long")
    return lines.where("value LIKE 'Article: %'").select(place.alias("hit"), "value")


def _hits_sql(values: tuple, strict: bool = False) -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, title, {i} AS k, {value} AS isbn, {ok} AS ok FROM fx WHERE {when}"
                              for i, (_, when, value, ok) in enumerate(values))
    return (f"WITH fx AS ({rich_sql()}), v AS ({rows}) SELECT title, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS hit_no, "
            f"isbn, {'true' if strict else 'ok'} AS checksum_valid FROM v")


_LINKS = "doc_id % 3 + CASE WHEN doc_id % 8 = 5 THEN 2 ELSE 0 END"
_POS = f"instr(decoded, '{TERM}')"

_ROWS = " UNION ALL ".join(f"SELECT doc_id, title, {i} AS k, {value} AS isbn, {ok} AS ok FROM fx WHERE {when}"
                           for i, (_, when, value, ok) in enumerate(_EXTENDED))
_LINES_SQL = (f"WITH fx AS ({rich_sql()}) SELECT doc_id, k, title, title || '|' || isbn || CASE WHEN ok THEN '' ELSE '|CHECKSUM_WRONG' END AS value "
              f"FROM ({_ROWS})")
_STATS_SQL = (
    f"n AS (SELECT doc_id, title, {_LINKS} AS n FROM ({rich_sql()})), "
    "s AS (SELECT count(*) AS total_articles, count(*) FILTER (WHERE n > 0) AS articles_with_cats, CAST(sum(n) AS BIGINT) AS total_categories, "
    "CAST(max(n) AS BIGINT) AS max_categories, (SELECT title FROM n WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 1) AS max_cat_article, "
    "count(*) FILTER (WHERE n > 0) / count(*) * 100.0 AS pct_with_cats, CAST(sum(n) AS DOUBLE) / count(*) FILTER (WHERE n > 0) "
    "AS avg_per_article_with_cats FROM n)")

QUERIES = {"isbn_dense": q_isbn_dense, "isbn_dense_basic": q_isbn_dense_basic, "isbn_decoded": q_isbn_decoded,
           "entity_decode": q_entity_decode, "search_decoded": q_search_decoded,
           "category_counts_rich": q_category_counts_rich, "category_usage_rich": q_category_usage_rich,
           "category_summary": q_category_summary, "category_stats_state": q_category_stats_state, "number_format": q_number_format,
           "isbn_filter_ere": q_isbn_filter_ere, "isbn_lines_ordered": q_isbn_lines_ordered,
           "search_lines_ordered": q_search_lines_ordered}

ORACLES = {
    "isbn_dense": f"SELECT *, true AS checksum_strict FROM ({_hits_sql(_EXTENDED)})",
    "isbn_dense_basic": _hits_sql(_BASIC),
    "isbn_decoded": _hits_sql(_DECODED, strict=True),
    "entity_decode": f"SELECT replace(title, '&amp;', '&') AS title, decoded AS text FROM ({rich_sql()})",
    "search_decoded": (
        f"SELECT title, CAST(1 AS INTEGER) AS match_no, CAST({_POS} AS INTEGER) AS match_pos, "
        f"substr(decoded, greatest(1, {_POS} - {CONTEXT}), {_POS} + {len(TERM) + CONTEXT} - greatest(1, {_POS} - {CONTEXT})) AS context "
        f"FROM ({rich_sql()})"),
    "category_counts_rich": f"SELECT title, CAST({_LINKS} AS BIGINT) AS n FROM ({rich_sql()})",
    "category_usage_rich": (
        f"WITH fx AS ({rich_sql()}) SELECT category, CAST(sum(n) AS BIGINT) AS n FROM ("
        "SELECT source AS category, doc_id % 3 AS n FROM fx UNION ALL "
        "SELECT unnest(['', 'inner']), CASE WHEN doc_id % 8 = 5 THEN 1 ELSE 0 END FROM fx) GROUP BY 1 HAVING sum(n) > 0"),
    "number_format": (
        "SELECT doc_id, printf('%.1f', n_chars / 8) AS eighths_1, printf('%.2f', n_chars / 8) AS eighths_2, "
        "printf('%.2f', n_chars / 1000) AS thousandths_2, printf('%.6f', -n_chars / 7) AS sevenths_6, "
        "printf('%.0f', n_chars / 2) AS halves_0 FROM documents"),
    "category_stats_state": f"WITH {_STATS_SQL} SELECT * FROM s",
    "category_summary": (
        f"WITH {_STATS_SQL} SELECT 'Category Statistics:' || chr(10) || 'Total articles: ' || total_articles || chr(10) || "
        "'Articles with categories: ' || articles_with_cats || ' (' || printf('%.1f', pct_with_cats) || '%)' || chr(10) || "
        "'Total categories: ' || total_categories || chr(10) || 'Average categories per article: ' || "
        "printf('%.2f', avg_per_article_with_cats) || chr(10) || 'Maximum categories: ' || max_categories || ' in article \"' || "
        "max_cat_article || '\"' || chr(10) AS summary FROM s"),
    # the same lines in RE2's spelling
    "isbn_filter_ere": (
        f"SELECT value, title FROM ({_LINES_SQL}) WHERE regexp_matches(value, "
        "'^Q&amp;A [0-9]*[05]\\|978-?[0-9]+(?:(?:-[0-9]{1,4}){2,})+|[Xx]$')"),
    "isbn_lines_ordered": f"SELECT row_number() OVER (ORDER BY doc_id, k) AS line_no, value FROM ({_LINES_SQL})",
    "search_lines_ordered": (
        f"SELECT row_number() OVER (ORDER BY doc_id) AS hit, 'Article: ' || title AS value FROM ({rich_sql()})"),
}
