"""Mixing sources to target weights by a low-discrepancy schedule.

A schedule of slots, all of the same number of words: slot k has the k-th
point of a golden-ratio sequence, the point falls into a source's interval of
the cumulative target weights, and the slot's rank among the source's slots
names the block of the source's shuffled word stream that it takes (the
stream starts over when it is used up). Blocks that a source's slots do not
reach follow in slots after the schedule, so every target is taken whole.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import materialize, word_count

MAX_REPEATS = 3
BLOCK_WORDS = 4096   # words of a slot, at most
SLOTS = 1 << 18      # slots of a schedule, at least (blocks get smaller for it)
BUCKETS = 1024       # parts of a source's stream that are ordered on their own
CELLS = 4096         # cells of [0, 1) that join points with intervals
SPARE = 256          # one slot more per so many, as points miss targets by a few slots

# Golden-ratio points on a grid of 2^31: k times the odd number nearest to
# 2^31 / 1.6180339887 modulo 2^31, exact in 64-bit integers.
GRID = 1 << 31
STEP = 1327217885


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, weight, source_size, target`` per source of ``sizes``
    (source, size). Sources by code point, null last, weigh 1, 2, 3,
    repeating, and share the total; a target stops at ``max_repeats`` times
    the source's size and the excess is reshared by weight until none is above.

    In the order of size per weight the capped sources come first, so one
    pass over prefix sums finds where capping ends. It ranks one row per
    source in sequence, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
              .withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")))
    cap = F.col("source_size") * F.lit(float(max_repeats))
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    # words per weight unit if the sources before this one are capped
    unit = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("cap", cap).withColumn("unit", unit).withColumn("pos", F.row_number().over(order))
    fits = F.min(F.when(F.col("unit") * F.col("weight") <= F.col("cap"),
                        F.struct("pos", "unit"))).over(everything)["unit"]
    return (s.withColumn("level", fits)
             .select("source", "weight", "source_size",
                     F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")))


def _stream(sizes: DataFrame) -> DataFrame:
    """Adds ``at``: where a document starts in its source's shuffled stream.

    The shuffle order is a hash of the id; its top part is a bucket. Buckets
    are summed, their sums accumulated per source (at most BUCKETS rows), and
    only the rows of one bucket are ordered together.
    """
    h = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40))
    d = sizes.withColumn("h", h).withColumn("bucket", (F.col("h") / ((1 << 40) // BUCKETS)).cast("int"))
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (d.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
             .select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"),
                     F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("base")))
    in_bucket = (Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row")
                       .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("before", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    return (d.join(base, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
             .withColumn("at", F.col("base") + F.col("before"))
             .drop("h", "bucket", "base", "before", "b_source", "b_bucket"))


def slot_table(targets: DataFrame, n_slots: int, need: str | None = None) -> DataFrame:
    """``slot, source, rank``: the schedule of ``n_slots`` slots. With ``need``,
    a column of ``targets``, every source has at least so many: points miss an
    interval by a few slots (and one under 1 / GRID wholly), and the ranks left
    over are slots from ``n_slots`` on.

    Points and the intervals of the cumulative weights meet by cell of [0, 1)
    (an interval is a row in each cell it touches), and points are spread
    evenly over cells. Ranks are counted per (source, run of slots) and
    accumulated, so a source with most slots is not ranked in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = targets.where(F.col("target") > 0)
    share = F.sum("target").over(by_name) / F.sum("target").over(
        by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.select("source", F.round(share * GRID).cast("long").alias("hi"))
    t = t.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("hi", F.col("source").asc_nulls_last())), F.lit(0)))
    width = GRID // CELLS
    t = (t.where(F.col("lo") < F.col("hi"))
          .withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}")))))
    run = max(1 << 12, n_slots >> 10)
    k = targets.sparkSession.range(n_slots).select(
        F.col("id").alias("slot"), ((F.col("id") % GRID) * STEP % GRID).alias("u"))
    k = k.withColumn("cell", F.expr(f"u div {width}")).withColumn("run", F.expr(f"slot div {run}"))
    s = k.join(t, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "run", "source")
    s = materialize(s, "slots")
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = (s.groupBy("source", "run").count()
             .select(F.col("source").alias("b_source"), F.col("run").alias("b_run"),
                     F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    own = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    ranked = (s.withColumn("own", own)
               .join(base, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("run") == F.col("b_run")))
               .select("slot", "source", (F.col("base") + F.col("own")).alias("rank")))
    if need is None:
        return ranked
    # one row per source, then one per missing rank
    has = s.groupBy(F.col("source").alias("h_source")).agg(F.count("*").alias("has"))
    gap = (targets.select("source", F.col(need).alias("need"))
                  .join(has, F.col("source").eqNullSafe(F.col("h_source")), "left")
                  .select("source", "need", F.coalesce("has", F.lit(0).cast("long")).alias("has"))
                  .where(F.col("need") > F.col("has")))
    ahead = F.sum(F.col("need") - F.col("has")).over(by_name.rowsBetween(Window.unboundedPreceding, -1))
    tail = (gap.withColumn("ahead", F.coalesce(ahead, F.lit(0).cast("long")))
               .withColumn("rank", F.explode(F.sequence(F.col("has"), F.col("need") - 1)))
               .select((F.lit(n_slots) + F.col("ahead") + F.col("rank") - F.col("has")).alias("slot"), "source", "rank"))
    return ranked.unionByName(tail)


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, slots: int = SLOTS,
                size: Column | None = None, row: Column | None = None):
    """(documents, pieces): ``documents`` has ``doc_id, source, size, row,
    source_size, target, at`` per input row; ``pieces`` is the mix itself,
    ``slot, source, rank, doc_id, size, at, from_word, words, repeat``: which
    words of which document a slot takes, and in which use of the source.

    A null text has size 0 and a null source is a source. Rows that repeat an
    id are rows of their own. A slot takes ``block_words`` words, or fewer for
    a corpus of under ``slots`` such blocks; the last slot of a source is cut
    where the target is reached, and every source's whole target is taken. ``size`` replaces the count of the text's
    words; ``row`` is a caller's own number of a row, passed through.
    """
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                    (word_count(F.col(text_col)) if size is None else size).alias("size"),
                                    (F.lit(0).cast("long") if row is None else row).alias("row")), "sizes")
    targets = materialize(source_targets(sizes, max_repeats), "targets")
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = max(1, min(block_words, total // slots))
    n_slots = -(-total // block)
    n_slots += -(-n_slots // SPARE)
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target",
                       F.floor("target").cast("long").alias("quota"))
    need = targets.withColumn("need", F.ceil(F.floor("target") / block).cast("long"))
    rows = materialize(_stream(sizes).join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source"), "stream")
    # uses of the source's stream, then the blocks that a use of the document touches
    first = F.col("use") * F.col("source_size") + F.col("at")
    last = F.least(first + F.col("size"), F.col("quota"))
    p = (rows.where((F.col("size") > 0) & (F.col("quota") > 0))
             .withColumn("use", F.explode(F.sequence(F.lit(0), ((F.col("quota") - 1) / F.col("source_size")).cast("int"))))
             .withColumn("first", first).withColumn("last", last)
             .where(F.col("first") < F.col("last"))
             .withColumn("rank", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(last - 1) div {block}"))))
             .withColumn("lo", F.greatest("first", F.col("rank") * block))
             .withColumn("hi", F.least("last", (F.col("rank") + 1) * block)))
    s = slot_table(need, n_slots, "need").select(F.col("source").alias("s_source"), F.col("rank").alias("s_rank"), "slot")
    pieces = (p.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("rank") == F.col("s_rank")))
               .select("slot", "source", "rank", "doc_id", "size", "at",
                       (F.col("lo") - F.col("first")).alias("from_word"),
                       (F.col("hi") - F.col("lo")).alias("words"), F.col("use").alias("repeat")))
    return rows, pieces


def mixed(docs: DataFrame, **columns) -> DataFrame:
    """One row per document: ``doc_id, source, size, row, source_size, target,
    taken, at`` (taken: words that the mix takes, repeats counted)."""
    rows, pieces = mixing_plan(docs, **columns)
    keys = ["source", "at", "doc_id", "size"]
    taken = (pieces.groupBy(*keys).agg(F.sum("words").alias("taken"))
                   .select(*[F.col(c).alias(f"k_{c}") for c in keys], "taken"))
    # equal keys are repeated rows of size 0, which take nothing
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return (rows.join(taken, same, "left")
                .select("doc_id", "source", "size", "row", "source_size", "target",
                        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "at"))


def repeat_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a document appears once per started
    use, whole where the use takes all its words and else cut after the words
    taken; documents of which nothing is taken are left out. ``n_chars``, if
    there, follows the text."""
    # the written rows have stable numbers, by which they meet what is taken
    whole = materialize(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("row"),
                                    word_count(F.col(text_col)).alias("size")), "whole")
    m = mixed(whole.select("_doc.*", F.col("row").alias("_row"), F.col("size").alias("_size")),
              id_col=id_col, text_col=text_col, source_col=source_col, size=F.col("_size"), row=F.col("_row"))
    m = m.where(F.col("taken") > 0).select("row", "taken")
    w = whole.join(m.hint("shuffle_hash"), "row")
    w = w.withColumn("use", F.explode(F.sequence(F.lit(0), ((F.col("taken") - 1) / F.col("size")).cast("int"))))
    w = w.withColumn("part", F.least(F.col("size"), F.col("taken") - F.col("use") * F.col("size")))
    given = F.col("_doc").getField(text_col)
    words = F.regexp_extract_all(given, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(F.col("part") == F.col("size"), given).otherwise(
        F.concat_ws(" ", F.slice(words, F.lit(1), F.col("part").cast("int"))))
    put = {text_col: text, "n_chars": F.length(text).cast("long")}
    return w.select(*[put.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])
