import pytest
from pyspark.sql import functions as F

from aerovox.operators import bitmaps

NAMES = ["000000", "ffffff", "00ffff", "008000", "007fff", "3c0001", "3c0001", "3C0001", "", " 3c001", "3c00011", None, None, "gggggg"]


@pytest.fixture(scope="module")
def seen(spark):
    rows = [(i % 3, n) for i, n in enumerate(NAMES)] + [(7, f"{i:06x}") for i in range(0, 1 << 24, 40_009)]
    return spark.createDataFrame(rows, "part int, icao24 string").repartition(4)


def test_counts_are_exact(seen):
    want = {r.part: r.n for r in seen.groupBy("part").agg(F.countDistinct("icao24").alias("n")).collect()}
    parts = bitmaps.aircraft_parts(seen, "part")
    assert {r.part: r.unique_aircraft for r in bitmaps.count_aircraft(parts, "part").collect()} == want


def test_parts_merge(seen):
    parts = bitmaps.aircraft_parts(seen, "part").drop("part")
    twice = parts.unionByName(parts)
    want = seen.agg(F.countDistinct("icao24")).first()[0]
    assert bitmaps.count_aircraft(twice).first().unique_aircraft == want
    assert bitmaps.merge_parts(twice).count() <= 512 + 6 + 1
    assert bitmaps.count_aircraft(twice.where("false")).first().unique_aircraft == 0


def test_only_names_that_are_missing(spark):
    none = spark.createDataFrame([(None,), (None,)], "icao24 string")
    assert bitmaps.count_aircraft(bitmaps.aircraft_parts(none)).first().unique_aircraft == 0
