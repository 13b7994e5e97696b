"""Test input built from the given tables: a wikitext table derived from
``documents`` and its MediaWiki XML dump.

The wikitext SQL is portable (Spark SQL and DuckDB run the same text), so
the DuckDB oracles can rebuild the exact input. It only plants category
links and ISBN notations into each document by ``doc_id`` arithmetic; all
parsing, counting and extraction is done by the library on the dump.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import scratch_root

TITLE_PLAIN = "concat('Doc ', cast(doc_id AS varchar(20)), CASE WHEN doc_id % 10 = 0 THEN ' Berlin' ELSE '' END)"
# titles shared by several pages (so that per-title ISBN reports rank something)
TITLE_GROUPED = ("concat('Doc ', cast(doc_id % 50 AS varchar(20)), "
                 "CASE WHEN doc_id % 10 = 0 THEN ' Berlin' ELSE '' END)")

# ISBN values of a document, from its doc_id; ``{more}`` names further columns to carry.
ISBN_SQL = """
WITH a AS (SELECT doc_id, text, source{more}, lpad(cast((doc_id*7919+13) % 1000000000 AS varchar(20)), 9, '0') AS b9 FROM {documents}),
b AS (SELECT *, concat('978', b9) AS b12 FROM a),
c AS (SELECT *,
  (11 - ((cast(substr(b9,1,1) AS int)*10 + cast(substr(b9,2,1) AS int)*9 + cast(substr(b9,3,1) AS int)*8 + cast(substr(b9,4,1) AS int)*7 + cast(substr(b9,5,1) AS int)*6 + cast(substr(b9,6,1) AS int)*5 + cast(substr(b9,7,1) AS int)*4 + cast(substr(b9,8,1) AS int)*3 + cast(substr(b9,9,1) AS int)*2) % 11)) % 11 AS c10,
  (10 - ((cast(substr(b12,1,1) AS int)*1 + cast(substr(b12,2,1) AS int)*3 + cast(substr(b12,3,1) AS int)*1 + cast(substr(b12,4,1) AS int)*3 + cast(substr(b12,5,1) AS int)*1 + cast(substr(b12,6,1) AS int)*3 + cast(substr(b12,7,1) AS int)*1 + cast(substr(b12,8,1) AS int)*3 + cast(substr(b12,9,1) AS int)*1 + cast(substr(b12,10,1) AS int)*3 + cast(substr(b12,11,1) AS int)*1 + cast(substr(b12,12,1) AS int)*3) % 10)) % 10 AS c13 FROM b),
e AS (SELECT *,
  concat(b9, CASE WHEN c10 = 10 THEN 'X' ELSE cast(c10 AS varchar(2)) END) AS i10,
  concat('978-', substr(b9,1,1), '-', substr(b9,2,4), '-', substr(b9,6,4), '-', cast(c13 AS varchar(2))) AS i13,
  concat(b12, cast((c13 + 1) % 10 AS varchar(2))) AS bad13 FROM c)
"""
# Planted ISBN notations, one class per doc_id % 12.
WIKITEXT_SQL = ISBN_SQL + """SELECT doc_id,
  {title} AS title,
  concat(replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;'), chr(10),
    repeat(concat('[[Kategorie:', source, ']]', chr(10)), cast(doc_id % 4 AS int)),
    CASE doc_id % 12
      WHEN 0 THEN concat('ISBN ', i13, ', S. 5')
      WHEN 1 THEN concat('{{{{BibISBN|', i10, '}}}}')
      WHEN 2 THEN concat('|ISBN=', i10, '|')
      WHEN 3 THEN concat('ISBN-13: ', i13, '.')
      WHEN 4 THEN concat('ISBN-10 ', i10, ';')
      WHEN 5 THEN concat('{{{{ISBN|', i13, '}}}}')
      WHEN 6 THEN concat('isbn=', i13, '|')
      WHEN 7 THEN concat('ISBN: ', bad13, ')')
      WHEN 8 THEN concat('ISBN ', i13, ' 2')
      WHEN 9 THEN concat('ISBN', i13, ',')
      WHEN 10 THEN concat('ISBN&nbsp;', i13, ',')
      ELSE '' END, chr(10)) AS text,
  source, i10, i13, bad13, c10
FROM e
"""

# Fixed layout of the written dump (whitespace as in MediaWiki exports).
DUMP_HEADER = ('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/" xml:lang="de">\n'
               '  <siteinfo>\n    <sitename>Fixture</sitename>\n  </siteinfo>')
DUMP_FOOTER = "</mediawiki>"
PAGE_PREFIX = "  <page>\n    <title>"
PAGES_PER_FILE = 1000


def wikitext_sql(documents: str = "documents", grouped_titles: bool = False) -> str:
    return WIKITEXT_SQL.format(documents=documents, more="", title=TITLE_GROUPED if grouped_titles else TITLE_PLAIN)


def page_xml_sql(title: str = "title", text: str = "text", doc_id: str = "doc_id",
                 nbytes: str = "octet_length") -> str:
    """One page of the dump as a SQL expression (one written line).
    ``nbytes`` names the byte-length function (DuckDB: ``strlen``)."""
    return (f"concat('{PAGE_PREFIX}', {title}, '</title>', chr(10), '    <ns>0</ns>', chr(10), "
            f"'    <id>', cast({doc_id} AS varchar(20)), '</id>', chr(10), '    <revision>', chr(10), "
            f"'      <text bytes=\"', cast({nbytes}({text}) AS varchar(20)), '\" xml:space=\"preserve\">', "
            f"{text}, '</text>', chr(10), '    </revision>', chr(10), '  </page>')")


def wikitext(spark: SparkSession, sf_dir: str, grouped_titles: bool = False) -> DataFrame:
    """The derived wikitext table (doc_id, title, text, source, i10, i13, bad13, c10)."""
    view = "scriptorium_documents_" + hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
    spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).createOrReplaceTempView(view)
    return spark.sql(wikitext_sql(view, grouped_titles))


# Every DROPPED_EVERY-th document is followed by two pages that yield no
# article: one without a title and one whose text element is self-closing.
DROPPED_EVERY = 50
DROPPED_PAGES = ("  <page><ns>0</ns><revision><text>no title</text></revision></page>",
                 "  <page><title>Dropped</title><revision><text bytes=\"0\" /></revision></page>")


def file_part(doc_id: str = "doc_id", pages_per_file: int = PAGES_PER_FILE) -> Column:
    """The file of a page: ``pages_per_file`` consecutive doc_ids share one."""
    return F.lpad((F.col(doc_id) / F.lit(pages_per_file)).cast("long").cast("string"), 8, "0")


def write_dump(wt: DataFrame, path: str, pages_per_file: int = PAGES_PER_FILE, dropped: bool = False,
               tasks: int | None = None) -> str:
    """Write ``wt`` (doc_id, title, text) as a MediaWiki XML dump, in ``tasks``
    tasks (``dump_tasks``; default: Spark's number of shuffle partitions).

    One file per ``pages_per_file`` consecutive doc_ids, pages in doc_id
    order, each file with header and footer, with ``dropped`` also pages that
    yield no article. Files are named by their first page, so path order is
    page order.
    """
    part = file_part("doc_id", pages_per_file)
    pages = wt.select(part.alias("part"), F.col("doc_id").cast("double").alias("k"),
                      F.expr(page_xml_sql()).alias("value"))
    parts = pages.select("part").distinct()
    edges = (parts.select("part", F.lit(float("-inf")).alias("k"), F.lit(DUMP_HEADER).alias("value"))
             .unionByName(parts.select("part", F.lit(float("inf")).alias("k"), F.lit(DUMP_FOOTER).alias("value"))))
    if dropped:
        more = F.explode(F.array(*[F.struct(F.lit((i + 1) / 4).alias("d"), F.lit(x).alias("x")) for i, x in enumerate(DROPPED_PAGES)]))
        edges = edges.unionByName(wt.where(F.col("doc_id") % DROPPED_EVERY == 0).select("doc_id", part.alias("part"), more.alias("m"))
                                    .select("part", (F.col("doc_id") + F.col("m.d")).alias("k"), F.col("m.x").alias("value")))
    (pages.unionByName(edges)
        .repartition(*([tasks] if tasks else []), "part")
        .sortWithinPartitions("part", "k")
        .select("part", "value")
        .write.mode("overwrite").partitionBy("part").text(path))
    return path


def code_tag(*modules: str) -> str:
    """Short hash of package source files (paths relative to the package):
    cached outputs are keyed by the code that wrote them."""
    base = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for m in modules:
        with open(os.path.join(base, m), "rb") as f:
            h.update(f.read())
    return h.hexdigest()[:12]


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path in it."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists; an error of the file system is an error here."""
    fs, hpath = _file_system(spark, path)
    return bool(fs.exists(hpath))


def _stamp(spark: SparkSession, path: str) -> str:
    """Qualified path, size and newest change of a file or folder."""
    fs, hpath = _file_system(spark, path)
    newest = max([fs.getFileStatus(hpath).getModificationTime(), *[f.getModificationTime() for f in fs.listStatus(hpath)]])
    return f"{fs.makeQualified(hpath)}|{fs.getContentSummary(hpath).getLength()}|{newest}"


# Of the input's bytes to a task that sorts and writes pages: some 40 MB of rows, so that no task spills.
DUMP_TASK_BYTES = 16 << 20


def dump_tasks(spark: SparkSession, path: str) -> int:
    """Tasks to write a dump made from the table at ``path``: their number,
    not their size, grows with the input."""
    fs, hpath = _file_system(spark, path)
    return max(spark.sparkContext.defaultParallelism, -(-fs.getContentSummary(hpath).getLength() // DUMP_TASK_BYTES))


def fixture_dump(spark: SparkSession, sf_dir: str, grouped_titles: bool = False) -> str:
    """Path of the fixture dump for ``sf_dir`` in the shared scratch folder,
    written once per scratch folder, input version and writer code."""
    tag = f"{_stamp(spark, sf_dir.rstrip('/') + '/documents.parquet')}|{grouped_titles}|{code_tag('plans/fixtures.py')}"
    key = hashlib.sha1(tag.encode()).hexdigest()[:16]
    path = f"{scratch_root(spark)}/scriptorium/dumps/{key}"
    if not _exists(spark, path + "/_SUCCESS"):
        write_dump(wikitext(spark, sf_dir, grouped_titles), path, dropped=True,
                   tasks=dump_tasks(spark, sf_dir.rstrip("/") + "/documents.parquet"))
    return path
