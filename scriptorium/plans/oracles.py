"""DuckDB oracles for the registered queries.

Each string rebuilds the fixture wikitext from the ``documents`` view with
the same portable SQL, then states the expected result independently of the
library: category and ISBN results follow from what was planted in each
document (not from re-running the extraction rules), searches use DuckDB's
own string search, and page offsets add up the written line lengths.
"""

from __future__ import annotations

from scriptorium.plans import catalog, rich
from scriptorium.plans.fixtures import DROPPED_EVERY, DROPPED_PAGES, DUMP_HEADER, PAGES_PER_FILE, page_xml_sql, wikitext_sql


def _fx(grouped: bool = False) -> str:
    return f"fx AS ({wikitext_sql('documents', grouped)})"


# ISBN value planted per doc_id % 12 and what each dialect must return.
_EXT_ISBN = ("CASE doc_id % 12 WHEN 0 THEN i13 WHEN 1 THEN i10 WHEN 2 THEN i10 WHEN 3 THEN i13 "
             "WHEN 4 THEN i10 WHEN 5 THEN i13 WHEN 6 THEN i13 WHEN 7 THEN bad13 WHEN 10 THEN i13 END")
_EXT_WHERE = "doc_id % 12 IN (0, 1, 2, 3, 4, 5, 6, 7, 10)"
_BASIC_ISBN = "CASE doc_id % 12 WHEN 0 THEN i13 WHEN 1 THEN i10 WHEN 2 THEN i10 WHEN 7 THEN bad13 WHEN 9 THEN i13 END"
# an ISBN-10 ending in X has nine digits: the basic format rule rejects it
_BASIC_WHERE = "(doc_id % 12 IN (0, 7, 9) OR (doc_id % 12 IN (1, 2) AND c10 <> 10))"


def _ext(grouped: bool = False) -> str:
    return (f"WITH {_fx(grouped)}, ext AS (SELECT doc_id, title, {_EXT_ISBN} AS isbn, "
            f"(doc_id % 12) <> 7 AS checksum_valid, c10, CAST(right(i13, 1) AS INTEGER) AS c13 "
            f"FROM fx WHERE {_EXT_WHERE})")


def _lines(grouped: bool = True) -> str:
    return (_ext(grouped) + ", lines AS (SELECT doc_id, title, isbn, "
            "CASE WHEN checksum_valid THEN NULL ELSE 'CHECKSUM_WRONG' END AS flag, "
            "concat(title, '|', isbn, CASE WHEN checksum_valid THEN '' ELSE '|CHECKSUM_WRONG' END) AS value FROM ext)")


def _hits(term: str, context: int) -> str:
    """All (overlapping) occurrences by repeated instr from one past the
    previous hit, on the fixture text."""
    k = len(term)
    q = term.replace("'", "''")
    return (f"WITH RECURSIVE {_fx()}, h AS ("
            f"SELECT title, text, CAST(instr(text, '{q}') AS BIGINT) AS pos, 1 AS k FROM fx WHERE instr(text, '{q}') > 0 "
            f"UNION ALL SELECT title, text, pos + instr(substr(text, pos + 1), '{q}'), k + 1 FROM h "
            f"WHERE instr(substr(text, pos + 1), '{q}') > 0), "
            f"hits AS (SELECT title, CAST(k AS INTEGER) AS match_no, CAST(pos AS INTEGER) AS match_pos, "
            f"substr(text, greatest(1, pos - {context}), least(length(text), pos + {k - 1} + {context}) - greatest(1, pos - {context}) + 1) AS context, "
            f"CAST(strlen(substr(text, 1, pos - 1)) + 1 AS BIGINT) AS bpos, text FROM h)")


def _sql() -> dict[str, str]:
    term, n = catalog.SEARCH_TERM, catalog.SEARCH_CONTEXT
    kb = len(term.encode("utf-8"))
    page = page_xml_sql(nbytes="strlen")
    hlen = len(DUMP_HEADER.encode("utf-8"))
    with_cats = "count(*) FILTER (WHERE doc_id % 4 > 0)"
    # the written lines of all pages, those that yield no article included
    lines = (f"pagelines AS (SELECT doc_id, 0 AS d, {page} AS line FROM fx" + "".join(
        f" UNION ALL SELECT doc_id, {i + 1}, '{x}' FROM fx WHERE doc_id % {DROPPED_EVERY} = 0"
        for i, x in enumerate(DROPPED_PAGES)) + ")")
    # Fixed value: the reports' ISBN-13 line pattern.
    is13 = r"regexp_matches(value, '\|97[89][-0-9]{10,14}$')"
    return {
        "dump_scan": f"WITH {_fx()}, {lines} SELECT substr(line, 3) AS page FROM pagelines",
        "page_index": (
            f"WITH {_fx()}, {lines}, l AS (SELECT doc_id, d, doc_id // {PAGES_PER_FILE} AS part, strlen(line) AS n FROM pagelines) "
            f"SELECT CAST({hlen} + 1 + coalesce(sum(n + 1) OVER (PARTITION BY part ORDER BY doc_id, d "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 AS BIGINT) AS start_pos, "
            f"CAST(n - 2 AS BIGINT) AS length FROM l"),
        "article_extract": f"WITH {_fx()} SELECT title, text FROM fx",
        "html_title": (
            "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages "
            "WHERE regexp_matches(html, '(?s)<title>.*?</title>')"),
        "scan_counters": (
            f"WITH {_fx()} SELECT count(*) + {len(DROPPED_PAGES)} * count(*) FILTER (WHERE doc_id % {DROPPED_EVERY} = 0) "
            f"AS pages_found, count(*) AS articles, "
            f"count(*) FILTER (WHERE {_EXT_WHERE}) AS isbns FROM fx"),
        "category_counts": f"WITH {_fx()} SELECT title, CAST(doc_id % 4 AS BIGINT) AS n FROM fx",
        "category_stats": (
            f"WITH {_fx()} SELECT count(*) AS total_articles, {with_cats} AS articles_with_cats, "
            f"CAST(coalesce(sum(doc_id % 4), 0) AS BIGINT) AS total_categories, "
            f"CAST(coalesce(max(doc_id % 4), 0) AS BIGINT) AS max_categories, "
            f"coalesce((SELECT title FROM fx WHERE doc_id % 4 > 0 AND doc_id % 4 = (SELECT max(doc_id % 4) FROM fx) "
            f"ORDER BY doc_id LIMIT 1), '') AS max_cat_article, "
            f"CASE WHEN count(*) > 0 THEN CAST({with_cats} AS DOUBLE) / count(*) * 100 ELSE 0.0 END AS pct_with_cats, "
            f"CASE WHEN {with_cats} > 0 THEN CAST(sum(doc_id % 4) AS DOUBLE) / {with_cats} ELSE 0.0 END "
            f"AS avg_per_article_with_cats FROM fx"),
        "category_usage": (
            f"WITH {_fx()} SELECT source AS category, CAST(sum(doc_id % 4) AS BIGINT) AS n FROM fx "
            f"GROUP BY source HAVING sum(doc_id % 4) > 0"),
        "search_kwic": _hits(term, n) + " SELECT title, match_no, match_pos, context FROM hits",
        "search_kwic_bytes": (
            _hits(term, n) + f" SELECT title, match_no, CAST(bpos AS INTEGER) AS match_pos, "
            f"hex(encode(text)[greatest(1, bpos - {n}) : least(strlen(text), bpos + {kb - 1} + {n})]) AS context_hex FROM hits"),
        "search_lines": (
            _hits(term, n) + " SELECT concat('Article: ', title, chr(10), '...', context, '...', chr(10)) AS value FROM hits"),
        "isbn_extract_basic": (
            f"WITH {_fx()} SELECT title, CAST(1 AS INTEGER) AS hit_no, {_BASIC_ISBN} AS isbn, "
            f"CAST(NULL AS BOOLEAN) AS checksum_valid FROM fx WHERE {_BASIC_WHERE}"),
        "isbn_extract_extended": _ext() + " SELECT title, CAST(1 AS INTEGER) AS hit_no, isbn, checksum_valid FROM ext",
        "isbn_lines": _lines(False) + " SELECT value FROM lines",
        "isbn_checksum": (
            _ext() + " SELECT title, isbn, checksum_valid, "
            "CAST(CASE WHEN doc_id % 12 IN (1, 2, 4) THEN c10 ELSE c13 END AS INTEGER) AS check_value FROM ext"),
        "isbn_file_source": _lines() + " SELECT title, isbn, flag FROM lines",
        "isbn_stats": (
            _lines() + " SELECT count(*) AS total, count(DISTINCT title) AS articles, "
            "CASE WHEN count(DISTINCT title) > 0 THEN floor(count(*) * 100 / count(DISTINCT title)) / 100 END "
            "AS avg_per_article FROM lines"),
        "isbn_top_articles": (
            _lines() + f" SELECT title, count(*) AS count FROM lines GROUP BY title "
            f"ORDER BY count DESC, title DESC LIMIT {catalog.TOP_N}"),
        "isbn_format_distribution": (
            _lines() + f" SELECT count(*) FILTER (WHERE {is13}) AS isbn13, count(*) FILTER (WHERE NOT {is13}) AS other, "
            f"CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (WHERE {is13}) * 100 * 100 / count(*)) / 100 END AS isbn13_pct, "
            f"CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (WHERE NOT {is13}) * 100 * 100 / count(*)) / 100 END AS other_pct "
            f"FROM lines"),
        "isbn_sample": _lines() + f" SELECT value FROM lines ORDER BY doc_id LIMIT {catalog.SAMPLE_N}",
        "isbn_filter_line": (
            _lines() + f" SELECT value, title FROM lines WHERE regexp_matches(value, '{catalog.FILTER_LINE_PATTERN}')"),
        "isbn_filter_title": (
            _lines() + f" SELECT value, title FROM lines WHERE regexp_matches(title, '{catalog.FILTER_TITLE_PATTERN}')"),
        "isbn_filter_summary": (
            _lines() + f" SELECT count(*) AS isbns, count(DISTINCT title) AS articles FROM lines "
            f"WHERE regexp_matches(value, '{catalog.FILTER_LINE_PATTERN}')"),
        "per_article": (
            f"WITH {_fx()} SELECT title, CAST(strlen(title) AS BIGINT) AS title_bytes, "
            f"CAST(strlen(text) AS BIGINT) AS text_bytes FROM fx"),
    }


ORACLES: dict[str, str] = {**_sql(), **rich.ORACLES}
