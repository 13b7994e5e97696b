"""Dump source (S1) and page offset index.

A MediaWiki export is split by the file reader itself: records are delimited
by the literal ``</page>`` tag, so every split of a (possibly compressed,
splittable) dump is parsed in parallel and no record ever crosses a task. A
record is a page when it contains ``<page>``; the page runs from its first
``<page>`` to the delimiter. That is the reference's scan (first ``<page>``
from the cursor, then the first ``</page>`` after it) also for damaged files:
a page whose closing tag is missing runs on into the next one, a stray closing
tag or a file that starts inside a page yields nothing.

Only the end of a file needs more than its own record: what stands behind the
last closing tag is no page, even if it opens one. A plain file's end is read
by byte range, from the last bytes back to the last closing tag, one small
read per file (``file_ends``), so a dump is scanned once, cut off or not. Files
whose bytes cannot be read so (compressed ones, or in a store that only
Spark reads) are scanned a second time, by ``<page>``.

Every page keeps an order key ``(file_path, file_block_start, seq)`` taken
on the scan itself: sorting by it gives file order, which decides ties.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import scratch_root

# The tags the reference searches for, byte for byte.
PAGE_OPEN = "<page>"
PAGE_CLOSE = "</page>"

ORDER_KEY = ["file_path", "file_block_start", "seq"]


def order_cols(df: DataFrame) -> list[str]:
    """The order-key columns ``df`` carries (all of them for data read by
    this library; none for a plain title/text table)."""
    return [c for c in ORDER_KEY if c in df.columns]


def read_records(spark: SparkSession, path: str | list[str], *, recursive: bool = True,
                 separator: str = PAGE_CLOSE) -> DataFrame:
    """Raw records between ``separator`` tags, with the order key.

    Columns: ``value, file_path, file_block_start, seq, file_size,
    file_block_length``.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = _reader(spark, recursive).option("lineSep", separator).text(paths)
    return df.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_length").alias("file_block_length"),
    )


def _reader(spark: SparkSession, recursive: bool):
    return spark.read.option("recursiveFileLookup", "true") if recursive else spark.read


def _after_open(value: Column) -> Column:
    """What follows the first ``<page>`` of a record (empty without one)."""
    at = F.octet_length(F.substring_index(value, PAGE_OPEN, 1)) + len(PAGE_OPEN)
    return F.substring(value.cast("binary"), at + 1, F.octet_length(value)).cast("string")


class FileEnd(NamedTuple):
    """What stands behind the last closing tag of a file and opens a page:
    its first byte, size, MD5, and whether an equal record may stand before it
    in the same split. ``start`` is -1 where the file was scanned; size and
    hash are then those of what follows the last ``<page>``."""
    path: str
    start: int
    size: int
    digest: str
    twin: bool


DRIVER_FILES = 64      # so many files' ends are read by the driver itself, more of them by tasks
LISTED_ENDS = 10_000   # so many open ends are handed to the scan's tasks as a list
COMPRESSED = re.compile(r"\.(bz2|gz|deflate|zst|lz4|snappy|xz)$")


def _open(uri: str):
    """A file as a seekable stream, in the task that asks."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return open(unquote(u.path), "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def file_end(uri: str, split_bytes: int, block: int = 1 << 16) -> FileEnd | None:
    """The open end of a plain file, None if it has none. Reads back to the
    last closing tag, and in a file with an open end one split more."""
    close, opening = PAGE_CLOSE.encode(), PAGE_OPEN.encode()
    with _open(uri) as f:
        size = f.seek(0, 2)
        at, tail = size, b""
        while at > 0 and close not in tail:
            step = min(at, block)
            at -= step
            f.seek(at)
            tail = f.read(step) + tail
            block *= 2
        cut = tail.rfind(close)
        start = at + cut + len(close) if cut >= 0 else 0
        rest = tail[start - at:]
        if start == 0 and rest.startswith(b"\xef\xbb\xbf"):
            rest = rest[3:]  # the reader strips a byte order mark
        if opening not in rest:
            return None
        # records of a split start at most one split before this one
        again, at, held, twin = close + rest + close, max(0, start - split_bytes - 2 * len(close)), b"", False
        first = at == 0
        f.seek(at)
        while at < start and not twin:
            got = f.read(min(1 << 22, start - at))
            if not got:
                break
            at += len(got)
            held = held[-(len(again) - 1):] + got
            twin = again in held or first and held.removeprefix(b"\xef\xbb\xbf").startswith(again[len(close):])
            first = first and len(held) < len(again) + 3
        return FileEnd(uri, start, len(rest), hashlib.md5(rest).hexdigest(), twin)


def _ends_of(uris: list[str], split_bytes: int) -> Iterator[tuple[str, FileEnd | None]]:
    """``(file, its open end)``; the end is a row with an empty digest where
    the bytes cannot be read."""
    for uri in uris:
        try:
            if COMPRESSED.search(uri):
                raise ValueError("compressed")
            yield uri, file_end(uri, split_bytes)
        except Exception:  # any store that is not reachable from here: the file is scanned instead
            yield uri, FileEnd(uri, -1, 0, "", True)


_END_ROWS = "path string, start long, size long, digest string, twin boolean"


def file_ends(spark: SparkSession, path: str | list[str], *, recursive: bool = True) -> list[FileEnd] | DataFrame:
    """Open ends of a dump's files: a list, or a DataFrame where there are
    more than LISTED_ENDS."""
    return ends_of_files(spark, _reader(spark, recursive).text([path] if isinstance(path, str) else list(path)).inputFiles())


def ends_of_files(spark: SparkSession, listed: list[str]) -> list[FileEnd] | DataFrame:
    """``file_ends`` of the files listed."""
    files = sorted(re.sub("^file:/+", "file:/", f) for f in listed)  # as the scan names them
    split_bytes = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if len(files) <= DRIVER_FILES:
        with ThreadPoolExecutor(8) as pool:
            found = [e for part in pool.map(lambda f: list(_ends_of([f], split_bytes)), files) for _, e in part if e is not None]
    else:
        def run(batches):
            import pandas as pd

            for batch in batches:
                yield pd.DataFrame([e for _, e in _ends_of(batch["path"].tolist(), split_bytes) if e is not None],
                                   columns=list(FileEnd._fields))

        tasks = max(1, min(len(files) // 16, 10 * spark.sparkContext.defaultParallelism))
        rows = spark.createDataFrame([(f,) for f in files], "path string").repartition(tasks).mapInPandas(run, _END_ROWS)
        # at most a row per file, and the driver holds the list of files anyway
        found = [FileEnd(*r) for r in rows.collect()]
    scanned = [e.path for e in found if not e.digest]
    ends = [e for e in found if e.digest]
    if scanned:
        more = _scanned_ends(spark, scanned)
        got = more.limit(LISTED_ENDS + 1).collect()
        if len(got) > LISTED_ENDS:
            return more.unionByName(spark.createDataFrame(ends, _END_ROWS))
        ends += [FileEnd(*r) for r in got]
    return ends if len(ends) <= LISTED_ENDS else spark.createDataFrame(ends, _END_ROWS)


def _scanned_ends(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Open ends by a scan: read by ``<page>``, the last record of such a file
    holds no ``</page>``."""
    recs = read_records(spark, paths, separator=PAGE_OPEN)
    closed = F.col("value").contains(PAGE_CLOSE)
    last = F.max_by(F.struct(F.octet_length("value").cast("long").alias("size"), F.when(~closed, F.md5("value")).alias("digest"),
                             closed.alias("closed")), F.struct("file_block_start", "seq"))
    return (recs.groupBy("file_path").agg(last.alias("last"), F.count(F.lit(1)).alias("n"))
                .where(~F.col("last.closed") & (F.col("n") > 1))  # a file of one record opens no page
                .select(F.col("file_path").alias("path"), F.lit(-1).cast("long").alias("start"), "last.size", "last.digest",
                        F.lit(True).alias("twin")))


def closed_records(spark: SparkSession, path: str | list[str], *, recursive: bool = True) -> DataFrame:
    """``read_records`` that hold a ``<page>``, without the open end of a
    file. Of equal records in a file with that very open end, the last goes.

    The ends are known before the scan starts (``file_ends``): none leaves a
    plain scan, and up to LISTED_ENDS of them go to its tasks as a list. A
    record is taken for an open end by file, place of the split and size, then
    by its MD5. Only where an equal record stands in the same split, or the
    file had to be scanned, are the records with that content read again to
    find the last."""
    return without_open_ends(read_records(spark, path, recursive=recursive), file_ends(spark, path, recursive=recursive))


def without_open_ends(records: DataFrame, ends: list[FileEnd] | DataFrame) -> DataFrame:
    """The records that hold a ``<page>`` and are no open end."""
    spark, recs = records.sparkSession, records.where(F.col("value").contains(PAGE_OPEN))
    if isinstance(ends, list):
        if not ends:
            return recs
        twins = any(e.twin for e in ends)
        ends = F.broadcast(spark.createDataFrame(ends, _END_ROWS))
    else:
        twins = True
    rest = F.substring_index("value", PAGE_OPEN, -1)
    stop = F.col("file_block_start") + F.col("file_block_length")
    # a split reads the records that start behind its first byte, up to its end (and one at a tag across it)
    here = ((F.col("start") > F.col("file_block_start")) | (F.col("start") == 0)) & (F.col("start") <= stop + len(PAGE_CLOSE))
    size = F.when(F.col("start") < 0, F.octet_length(rest)).otherwise(F.octet_length("value"))
    digest = F.md5(F.when(F.col("start") < 0, rest).otherwise(F.col("value")))
    # in one CASE: the sizes are compared first, and the MD5 of other records is never taken
    same = ((F.col("file_path") == F.col("path"))
            & F.when((F.col("start") >= 0) & ~here, F.lit(False)).when(size != F.col("size"), F.lit(False)).otherwise(digest == F.col("digest")))
    kept = recs.join(ends.drop("twin"), same, "left_anti")
    if not twins:
        return kept
    again = (recs.join(ends, same).where("twin")
                 .withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("file_block_start"), F.desc("seq"))))
                 .where(F.col("_n") > 1).select(*recs.columns))
    return kept.unionByName(again)


def page_records(spark: SparkSession, path: str | list[str], *, recursive: bool = True) -> DataFrame:
    """One row per page: ``value``, what stands between its tags, and the order key."""
    recs = closed_records(spark, path, recursive=recursive)
    return recs.select(_after_open(F.col("value")).alias("value"), *ORDER_KEY)


def pages_of(records: DataFrame) -> DataFrame:
    """``page_records`` as whole pages: ``page`` and the order key."""
    return records.select(F.concat(F.lit(PAGE_OPEN), F.col("value"), F.lit(PAGE_CLOSE)).alias("page"), *order_cols(records))


def read_pages(spark: SparkSession, path: str | list[str], *, recursive: bool = True) -> DataFrame:
    """The pages of a dump, in parallel.

    Columns: ``page`` (from ``<page>`` to ``</page>`` inclusive) and the order
    key ``file_path, file_block_start, seq``.
    """
    return pages_of(page_records(spark, path, recursive=recursive))


BOM = 3  # bytes of a UTF-8 byte order mark, which the reader strips

_SPLIT_ROWS = "split long, seq long, page_at long, length long, local_off long, bytes long, file_path string, file_block_start long, file_size long"


def _split_summaries(batches):
    """Pages of a split with their offset in it, and, behind them, a row that
    sums the split up: its bytes, and as ``seq`` and ``page_at`` those of its
    last record. Records of a split follow each other in one task."""
    import numpy as np
    import pandas as pd

    held = None  # (split, file_path, file_block_start, file_size, bytes, last seq, last page_at)

    def summary(x):
        return pd.DataFrame([(x[0], x[5], x[6], 0, 0, x[4], x[1], x[2], x[3])], columns=_SPLIT_ROWS.replace(" long", "").replace(" string", "").split(", "))

    for pdf in batches:
        if pdf.empty:
            continue
        key, w = pdf["split"].to_numpy(), pdf["w"].to_numpy(dtype=np.int64)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        end = np.append(first[1:], len(key))
        total = np.concatenate(([0], np.cumsum(w)))
        for a, b in zip(first, end):
            before = 0
            if held is not None:
                if held[0] == key[a]:
                    before = held[4]
                else:
                    yield summary(held)
            at = pdf["page_at"].iloc[a:b]
            found = at.notna().to_numpy()
            if found.any():
                yield pd.DataFrame({"split": key[a:b][found], "seq": pdf["seq"].to_numpy()[a:b][found], "page_at": at[found].astype("int64"),
                                    "length": pdf["length"].to_numpy()[a:b][found], "local_off": before + (total[a:b] - total[a])[found],
                                    "bytes": None, "file_path": None, "file_block_start": None, "file_size": None})
            last = pdf.iloc[b - 1]
            held = (int(key[a]), last["file_path"], int(last["file_block_start"]), int(last["file_size"]),
                    before + int(total[b] - total[a]), int(last["seq"]), int(last["page_at"]) if pd.notna(last["page_at"]) else None)
    if held is not None:
        yield summary(held)


def page_index(spark: SparkSession, path: str | list[str], *, recursive: bool = True) -> DataFrame:
    """Byte offset and byte length of every page, per file.

    Columns: ``file_path, file_block_start, seq, start_pos, length``.
    ``start_pos`` is 0-based like a file offset (of the uncompressed content).

    One scan, which runs when this is called. A split is read by one task, in
    order, so offsets inside it are a running sum over numbers; the task also
    sums the split up. Pages and sums (numbers, never text) are checkpointed
    in the shared folder. The sums are added up along each file, in a window
    over one row per split, and every page gets its split's offset. The sums
    also tell how a plain file ends: they miss its size by a closing tag
    when the last record is not closed, which drops that page, and by a byte
    order mark, which the reader strips. Compressed files' sizes do not tell:
    those are scanned a second time if they are among the input (``file_ends``).
    """
    split = F.xxhash64("file_path", "file_block_start").alias("split")
    recs = read_records(spark, path, recursive=recursive)
    at = F.octet_length(F.substring_index("value", PAGE_OPEN, 1))
    n = F.octet_length("value")
    sizes = recs.select(split, "seq", (n + len(PAGE_CLOSE)).cast("long").alias("w"),
                        F.when(F.col("value").contains(PAGE_OPEN), at).cast("long").alias("page_at"),
                        (n - at + len(PAGE_CLOSE)).cast("long").alias("length"), "file_path", "file_block_start", "file_size")
    scratch_root(spark)  # the shared folder of checkpoints
    rows = sizes.mapInPandas(_split_summaries, _SPLIT_ROWS).checkpoint()
    in_file, whole = Window.partitionBy("file_path").orderBy("file_block_start"), Window.partitionBy("file_path")
    missing = F.col("file_size") - F.sum("bytes").over(whole)
    plain = ~F.col("file_path").rlike(COMPRESSED.pattern)
    last = F.lead("file_block_start").over(in_file).isNull()
    sums = rows.where("bytes IS NOT NULL").select(
        F.col("split").alias("s"), "file_path", "file_block_start",
        (F.coalesce(F.sum("bytes").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         + F.when(plain & missing.isin(BOM, BOM - len(PAGE_CLOSE)), F.lit(BOM)).otherwise(F.lit(0))).alias("base"),
        F.when(plain & last & missing.isin(-len(PAGE_CLOSE), BOM - len(PAGE_CLOSE)), F.col("seq")).alias("open_seq"))
    pages = rows.where("bytes IS NULL").select("split", "seq", "page_at", "length", "local_off")
    found = (pages.join(sums, F.col("split") == F.col("s"))
                 .where(F.col("open_seq").isNull() | (F.col("seq") != F.col("open_seq")))
                 .withColumn("start_pos", F.col("base") + F.col("local_off") + F.col("page_at")))
    packed = [f for f in recs.inputFiles() if COMPRESSED.search(f)]
    if packed:
        ends = _scanned_ends(spark, packed).select(F.col("path").alias("e_path"))
        stop = Window.partitionBy("file_path").orderBy(F.desc("start_pos"))
        cut = (found.join(ends, F.col("file_path") == F.col("e_path"))
                    .withColumn("_n", F.row_number().over(stop)).where(F.col("_n") > 1).drop("_n", "e_path"))
        found = found.join(ends, F.col("file_path") == F.col("e_path"), "left_anti").unionByName(cut)
    return found.select(*ORDER_KEY, "start_pos", "length")
