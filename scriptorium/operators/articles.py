"""Articles: title/text extraction (P1, F1), run counters (S7, A9) and the
custom per-article job hook (U1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scriptorium.sources.dump import ORDER_KEY, PAGE_CLOSE, page_records

# The tags the reference looks for, byte for byte.
TITLE_OPEN = "<title>"
TITLE_CLOSE = "</title>"
TEXT_OPEN = "<text"
TEXT_CLOSE = "</text>"


def _keep_found(df: DataFrame, found: F.Column, keep: list[str], marker: str) -> DataFrame:
    """Rows where ``found`` (a struct, null = drop) is set, its fields as
    columns; ``marker`` names a field that is never null in a set struct.

    The struct goes through ``inline_outer`` of a one-element array: a filter
    on generator output stays above the Generate, so the positions are
    computed once per row instead of being inlined into a pushed-down filter.
    """
    return (df.select(F.inline_outer(F.array(found)), *keep)
              .filter(F.col(marker).isNotNull()))


def extract_title(df: DataFrame, col: str = "page") -> DataFrame:
    """The title rule alone (first <title> to the first </title> after it);
    rows without a complete title are dropped. Adds column ``title``."""
    pos = df.selectExpr(
        "*",
        f"nullif(instr({col}, '{TITLE_OPEN}'), 0) AS _ts",
        f"nullif(locate('{TITLE_CLOSE}', {col}, _ts + {len(TITLE_OPEN)}), 0) AS _te")
    title = F.expr(f"substring({col}, _ts + {len(TITLE_OPEN)}, _te - _ts - {len(TITLE_OPEN)})")
    found = F.when(F.col("_te").isNotNull(), F.struct(title.alias("title")))
    return _keep_found(pos, found, [c for c in df.columns if c != "title"], "title")


ARTICLE_BATCH_BYTES = 16 << 20  # of a Python batch

# Longest ``<text ...>`` start tag the fast path looks through for its '>'.
TEXT_TAG_WINDOW = 512


def _article_columns(df: DataFrame, col: str) -> tuple[DataFrame, F.Column]:
    """Helper columns and the ``found`` struct (title, text; null = no
    article) for every page in ``col``: a page string that ends at its first
    ``</page>``, or (``value``) a record that holds no ``</page>``, whose end
    is the page's end. ``_lp >= 0`` marks a page.

    Fast path, in byte offsets: the page end and the text end are found from
    the back (``substring_index(.., -1)``; they sit at the end of a page), the
    title tags by short forward searches, and the slices are cut from the
    bytes. It is only taken when it provably equals the reference rule: the
    last ``</page>`` is also the first, the tags are in order, and the text
    holds no ``</text>`` (so the last one is the first after the text tag).
    Other pages (several revisions, malformed XML) take the exact rule in
    character positions; its columns are null, and cost nothing, on rows the
    fast path settled.
    """
    v = col
    n = len
    record = col == "value"
    page_end = "_n" if record else f"_n - octet_length(substring_index({v}, '{PAGE_CLOSE}', -1)) - {n(PAGE_CLOSE)}"
    no_close = "" if record else (
        f"AND NOT contains(_ftext, '{PAGE_CLOSE}') "
        f"AND NOT contains(cast(substring(_bin, 1, _gt + 1) AS string), '{PAGE_CLOSE}') "
        f"AND NOT contains(cast(substring(_bin, _lx + 1, _lp - _lx) AS string), '{PAGE_CLOSE}')")
    before_end = "true" if record else f"coalesce(_xxe < nullif(instr({v}, '{PAGE_CLOSE}'), 0), false)"
    # One projection list with lateral column aliases (each expression may
    # name the ones before it): analysed once, where a withColumn chain would
    # re-analyse the plan per column.
    cols = [
        ("_n", f"octet_length({v})"),
        # last </page> and last </text> (backward byte search), first <title>,
        # </title>, <text (forward byte search), all as 0-based byte offsets
        ("_lp", page_end),
        ("_lx", f"_n - octet_length(substring_index({v}, '{TEXT_CLOSE}', -1)) - {n(TEXT_CLOSE)}"),
        ("_ts", f"octet_length(substring_index({v}, '{TITLE_OPEN}', 1))"),
        ("_te", f"octet_length(substring_index({v}, '{TITLE_CLOSE}', 1))"),
        ("_tt", f"octet_length(substring_index({v}, '{TEXT_OPEN}', 1))"),
        ("_bin", f"cast({v} AS binary)"),
        ("_w", f"cast(substring(_bin, _tt + 1, {TEXT_TAG_WINDOW}) AS string)"),
        ("_wl", "octet_length(substring_index(_w, '>', 1))"),
        ("_gt", "_tt + _wl"),
        ("_ftext", "if(_gt < _lx, cast(substring(_bin, _gt + 2, _lx - _gt - 1) AS string), null)"),
        # the fast path equals the reference rule when the tags are in order
        # inside the page and no </page> precedes the last one (checked on the
        # head, the text and the tail) and the text holds no </text>
        ("_fast", f"coalesce(_lp >= 0 AND _ts < _te AND _te < _tt AND _tt < _lp AND _wl < octet_length(_w) "
                  f"AND _lx + {n(TEXT_CLOSE)} <= _lp "
                  f"AND NOT contains(_ftext, '{TEXT_CLOSE}') {no_close}, false)"),
        # exact rule (1-based characters); locate() with a null start is 0
        ("_xts", f"if(_fast, null, nullif(instr({v}, '{TITLE_OPEN}'), 0))"),
        ("_xte", f"nullif(locate('{TITLE_CLOSE}', {v}, _xts + {n(TITLE_OPEN)}), 0)"),
        ("_xtt", f"nullif(locate('{TEXT_OPEN}', {v}, _xte), 0)"),
        ("_xgt", f"nullif(locate('>', {v}, _xtt), 0)"),
        ("_xxe", f"nullif(locate('{TEXT_CLOSE}', {v}, _xgt + 1), 0)"),
        ("_xok", f"if(_xxe IS NULL, false, {before_end})"),
    ]
    x = df.selectExpr("*", *[f"{e} AS {k}" for k, e in cols])
    found = F.expr(
        f"CASE WHEN _fast THEN named_struct("
        f"'title', cast(substring(_bin, _ts + {n(TITLE_OPEN) + 1}, _te - _ts - {n(TITLE_OPEN)}) AS string), "
        f"'text', _ftext) "
        f"WHEN _xok THEN named_struct("
        f"'title', substring({v}, _xts + {n(TITLE_OPEN)}, _xte - _xts - {n(TITLE_OPEN)}), "
        f"'text', substring({v}, _xgt + 1, _xxe - _xgt - 1)) END")
    return x, found


def _articles(df: DataFrame, col: str) -> DataFrame:
    x, found = _article_columns(df, col)
    return _keep_found(x, found, [c for c in ORDER_KEY if c in df.columns], "text")


def extract_articles(pages: DataFrame) -> DataFrame:
    """P1 + F1: (title, raw wikitext) of the first revision of each page.

    Text is not entity-decoded. Pages without a title or without a complete
    first ``<text ...>...</text>`` are dropped; empty titles and empty texts
    are kept. Columns: ``title, text`` and the order key.
    """
    return _articles(pages, "page")


def articles_from_records(records: DataFrame) -> DataFrame:
    """P1 + F1 on raw records (``value``: what stands between the page tags),
    batch or streaming."""
    return _articles(records, "value")


def read_articles(spark: SparkSession, path: str | list[str], *, recursive: bool = True) -> DataFrame:
    """S1 + P1 + F1 in one pass: ``extract_articles(read_pages(...))`` without
    materialising the page string. Same rows, fewer passes over the text."""
    recs = page_records(spark, path, recursive=recursive)
    return _articles(recs, "value")


def read_articles_observed(spark: SparkSession, path: str | list[str], *, recursive: bool = True) -> tuple[DataFrame, Observation]:
    """``read_articles`` plus S7's counters, gathered while any job runs over
    the articles (``DataFrame.observe``: no extra pass). After the job's
    action, ``observation.get`` holds ``pages_found`` and ``articles``.
    Rates are these counts over the job's wall time, taken by the caller."""
    recs = page_records(spark, path, recursive=recursive)
    x, found = _article_columns(recs, "value")
    obs = Observation("scan_counters")
    x = x.withColumn("_found", found).observe(
        obs,
        F.count_if(F.col("_lp") >= 0).alias("pages_found"),
        F.count_if(F.col("_found").isNotNull()).alias("articles"))
    return _keep_found(x, F.col("_found"), [c for c in ORDER_KEY if c in recs.columns], "text"), obs


def scan_counters(pages: DataFrame,
                  per_text: Callable[[F.Column], F.Column] | None = None,
                  name: str = "isbns") -> DataFrame:
    """S7 / A9 as one global aggregate (a single row), over ``read_pages``
    or ``page_records`` output.

    ``pages_found``: pages the scan located (the extended program's
    "articles" counter counts these); ``articles``: pages that yielded an
    article (the basic program's counter); optionally ``name``: the sum of
    ``per_text(text)`` over the articles, e.g. the ISBNs found.
    """
    col = "page" if "page" in pages.columns else "value"
    x, found = _article_columns(pages, col)
    x = x.withColumn("_found", found)
    aggs = [F.count_if(F.col("_lp") >= 0).alias("pages_found"),
            F.count_if(F.col("_found").isNotNull()).alias("articles")]
    if per_text is not None:
        aggs.append(F.coalesce(F.sum(per_text(F.col("_found.text"))), F.lit(0)).cast("long").alias(name))
    return x.agg(*aggs)


def byte_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``most`` bytes, or of one row."""
    for batch in batches:
        if batch.nbytes <= most or batch.num_rows <= 1:
            yield batch
            continue
        half = batch.num_rows // 2
        yield from byte_batches(iter([batch.slice(0, half), batch.slice(half)]), most)


def per_article(articles: DataFrame,
                fn: Callable[[pd.DataFrame], pd.DataFrame],
                schema: StructType | str) -> DataFrame:
    """Run user Python over (title, text) batches, 0..n rows per article.

    ``fn`` takes a pandas DataFrame with the articles' columns and returns a
    pandas DataFrame of ``schema``. Batches are parts of one partition, so the
    work is spread like the scan; they are bounded by bytes (a longer article
    is a batch of its own), in the task, whatever the session's Arrow settings
    are. A job with state is ``aggregate_articles``.
    """
    out = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, ARTICLE_BATCH_BYTES):
            got = fn(batch.to_pandas())
            yield from pa.Table.from_pandas(got[list(arrow.names)], schema=arrow, preserve_index=False).to_batches()

    return articles.mapInArrow(run, out)


def aggregate_articles(articles: DataFrame,
                       init: Callable[[], Any],
                       step: Callable[[Any, pd.DataFrame], Any],
                       merge: Callable[[Any, Any], Any],
                       finish: Callable[[Any], pd.DataFrame],
                       schema: StructType | str,
                       fan_in: int = 64, levels: int = 4) -> DataFrame:
    """U1 with state: a custom job over all articles whose state is any
    Python object that can be pickled.

    ``init()`` makes a state, ``step(state, batch)`` adds a pandas batch of
    articles and returns the state, ``merge(a, b)`` joins the states of two
    parts (``a`` stands before ``b``), ``finish(state)`` gives the rows of
    ``schema``. Every partition folds its articles into one state; states are
    merged ``fan_in`` at a time, in partition order, in ``levels`` rounds, so no
    task sees more than ``fan_in`` states (for up to ``fan_in ** levels``
    partitions) and only states cross the network. The reference's shared
    struct and its lock become this. No article at all: ``finish(init())``.
    """
    if fan_in < 2 or levels < 1:
        raise ValueError("fan_in must be at least 2, levels at least 1")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen = init(), False
        for batch in byte_batches(batches, ARTICLE_BATCH_BYTES):
            state, seen = step(state, batch.to_pandas()), True
        if seen:
            yield _state_rows([TaskContext.get().partitionId()], [state])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("no")
        states = [cloudpickle.loads(s) for s in part["state"]]
        state = states[0]
        for other in states[1:]:
            state = merge(state, other)
        return pd.DataFrame({"no": [int(part["no"].iloc[0]) // fan_in], "state": [cloudpickle.dumps(state)]})

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch["state"]:
                yield finish(cloudpickle.loads(s))

    kind = "no long, state binary"
    states = articles.mapInArrow(fold, kind)
    for _ in range(levels):
        states = states.groupBy(F.expr(f"no div {fan_in}").alias("part")).applyInPandas(merged, kind)
    none = articles.sparkSession.createDataFrame([(1 << 62, cloudpickle.dumps(init()))], kind)
    # the empty state stands behind all others and is dropped, unless it is alone
    last = states.unionByName(none).groupBy().agg(F.min_by("state", "no").alias("state"))
    return last.mapInPandas(end, schema)


def _state_rows(numbers: list[int], states: list[Any]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([cloudpickle.dumps(s) for s in states], pa.binary())],
                                      names=["no", "state"])
