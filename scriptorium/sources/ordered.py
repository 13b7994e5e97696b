"""Text output in dump order without sorting the dump.

A task writes a folder for every split of the input it reads, named by the
number of the split's file and the split's first byte, both zero-padded:
``file=00000003/split=000000000134217728/part-...``. The rows of a folder are
sorted by the task itself. Folders in the order of their names are the rows in
the order of the dump, so the output needs no exchange and no sampling, and the
dump is read once. ``spark.read.text`` of the output, sorted by path and
place, and ``cat out/*/*/part-*`` both give that order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scriptorium.sources.dump import ORDER_KEY

FILE_DIGITS, SPLIT_DIGITS = 8, 18
LISTED_FILES = 100_000  # so many file names (some MB) go to the tasks as a list; more are joined


def write_ordered(lines: DataFrame, path: str, *then: str) -> int:
    """Write the column ``value`` of ``lines`` in the order of their order key
    and, inside an article, of the columns ``then``. Returns the number of rows."""
    if not set(ORDER_KEY) <= set(lines.columns):
        raise ValueError("needs rows with the order key of the scan")
    files = sorted(re.sub("^file:/+", "file:/", f) for f in lines.inputFiles())
    number = lines.sparkSession.createDataFrame([(f, f"{i:0{FILE_DIGITS}d}") for i, f in enumerate(files)], "name string, file string")
    if len(files) <= LISTED_FILES:
        number = F.broadcast(number)
    seen = Observation("ordered_lines")
    rows = lines.observe(seen, F.count(F.lit(1)).alias("n")).join(number, F.col("file_path") == F.col("name"), "left")
    (rows.select("value", F.coalesce("file", F.lit("x")).alias("file"),
                 F.lpad(F.col("file_block_start").cast("string"), SPLIT_DIGITS, "0").alias("split"), "seq", *then)
         .sortWithinPartitions("file", "split", "seq", *then)
         .select("value", "file", "split")
         .write.mode("overwrite").partitionBy("file", "split").text(path))
    return seen.get["n"]
