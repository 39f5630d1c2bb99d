import random

import pytest
from pyspark.sql import functions as F

from aerovox.operators.paging import PageIndex

SCHEMA = "at double, name string, id int, extra string"
ORDER = ("at", "name", "id")


@pytest.fixture
def index(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return PageIndex(str(tmp_path / "index"), schema, ORDER, block_rows=20, fanout=3)


def key(row):
    return [(v is not None, v) for v in row]


def some(chance, n):
    return [(chance.choice([None, 1.0, 2.5, 7.0]), chance.choice([None, "a", "b", "é"]), chance.choice([None, *range(30)]), "x") for _ in range(n)]


def test_pages_between_appends(spark, index):
    """Rows repeat, keys are null, a third of all is one and the same row."""
    chance, held = random.Random(4), []
    assert index.page(spark, 0, 10).collect() == [] and index.size(spark) == 0
    for n in (70, 1, 0, 90, 60):
        rows = some(chance, n) + [(2.5, "a", 3, "same")] * (n // 2)
        held = sorted(held + rows, key=key)
        index.append(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert index.size(spark) == len(held)
        for start in (len(held) // 2, len(held) - 3):
            page = index.page(spark, start, 25).collect()
            assert [r.position for r in page] == list(range(start + 1, min(start + 25, len(held)) + 1))
            assert [tuple(r)[1:4] for r in page] == [r[:3] for r in held[start : start + 25]]
    again = PageIndex(index.folder, index.schema, ORDER, block_rows=20, fanout=3)
    assert [tuple(r)[1:4] for r in again.page(spark, 100, 50).collect()] == [r[:3] for r in held[100:150]]


def test_a_page_opens_few_blocks(spark, index):
    rows = spark.range(3000).select(
        F.pmod(F.xxhash64("id"), F.lit(500)).cast("double").alias("at"), F.lit("n").alias("name"), F.col("id").cast("int").alias("id"), F.lit("x").alias("extra")
    )
    for part in range(2):
        index.append(rows.where(F.col("id") % 2 == part))
    page = index.page(spark, 1490, 20)
    assert len(page.inputFiles()) <= 2 * (2 + 3) and page.count() == 20
    assert len(list(rows.collect())) == index.size(spark)


def test_runs_are_merged_by_levels(spark, index):
    for i in range(9):
        index.append(spark.createDataFrame([(float(i), "n", i, "x")], SCHEMA))
    _, fences = index._fences(spark)
    assert [tuple(r) for r in fences.select("run", "level").distinct().collect()] == [("9-2", 2)]
    assert [r.at for r in index.page(spark, 0, 100).collect()] == [float(i) for i in range(9)]


def test_page_bounds(spark, index):
    for start, limit in ((-1, 5), (0, 0), (0, 1001)):
        with pytest.raises(ValueError):
            index.page(spark, start, limit)
