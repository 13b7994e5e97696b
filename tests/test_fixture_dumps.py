"""Dumps made from the given tables: their pages, and what writing them moves."""

import os

import pytest

from scriptorium.plans import fixtures, rich

ROWS = [(1, "a & b <c>", "news"), (2, None, "wiki"), (3, "", None), (7, "x", "web"), (7, "y", "news"), (7, "y", None),
        (None, "no id", "web"), (998, "one\ntwo", "web"), (999, "é", "web"), (1000, "next file", "wiki"), (13, "later", "")]


@pytest.fixture()
def documents(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)
    df.createOrReplaceTempView("rich_test_documents")
    return df


def test_rich_dump_has_the_pages_of_its_sql(spark, documents):
    """Null ids have no page, a shared id one for each text with each source."""
    later = f"CASE WHEN doc_id % 6 = 1 THEN '{rich.LATER}' ELSE '' END"
    want = spark.sql(f"SELECT doc_id, concat('  <page><title>', title, '</title><id>', doc_id, '</id><revision><text xml:space=\"preserve\">', "
                     f"text, '</text></revision>', {later}, '</page>') AS page FROM ({rich.rich_sql('rich_test_documents')})").collect()
    want = {part: sorted((r.page or "" for r in want if r.doc_id // 1000 == int(part))) for part in ("00000000", "00000001")}
    assert len(want["00000000"]) == 6 + 9 and len(want["00000001"]) == 1

    got = {}
    for r in rich.dump_lines(documents, 3).collect():
        got.setdefault(r.part, []).append(r.value)
    for part, pages in want.items():
        text = "\n".join(got[part])
        assert text.startswith(fixtures.DUMP_HEADER + "\n") and text.endswith("\n" + fixtures.DUMP_FOOTER)
        body = text[len(fixtures.DUMP_HEADER) + 1:-len(fixtures.DUMP_FOOTER) - 1]
        ids = [int(x.split("</id>")[0]) for x in body.split("<id>")[1:]]
        assert ids == sorted(ids)
        assert sorted(body.replace("\n", "")) == sorted("".join(pages).replace("\n", ""))
        assert all(p in body for p in pages)


def test_rich_dump_shuffles_and_sorts_a_text_once(spark, documents):
    """Before, the documents were joined with themselves, then dealt out by file: two shuffles and two sorts of all texts."""
    plan = rich.dump_lines(documents.coalesce(1), 3)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Exchange hashpartitioning(part", 1)
    assert len(plan) == 2 and "Join" not in "".join(plan) and "Exchange hashpartitioning" not in plan[1]
    assert sum(line.strip(" :+-").startswith("Sort ") for line in plan[0].splitlines()) == 1


def test_tasks_that_write_a_dump_grow_with_the_table(spark, tmpdir_run):
    """Spark's shuffle partitions are a fixed number: their sorts grew with the input until they spilled."""
    path = os.path.join(tmpdir_run, "documents.parquet")
    with open(path, "wb") as f:
        f.truncate(100 * fixtures.DUMP_TASK_BYTES + 1)  # sparse; only its length counts
    assert fixtures.dump_tasks(spark, path) == 101
    small = os.path.join(tmpdir_run, "small.parquet")
    open(small, "wb").close()
    assert fixtures.dump_tasks(spark, small) == spark.sparkContext.defaultParallelism
