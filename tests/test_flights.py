import random

import pytest
from helpers import lines_of, poll, state
from pyspark.sql import functions as F

from aerovox.operators import areas, explore, flights, polls, sequence, stats
from aerovox.regions import REGIONS, region_box


def rows_of(spark, *states, time=1000):
    return polls.flights_from_polls(lines_of(spark, poll(*states, time=time)))


def test_api_view(spark):
    rows = rows_of(spark, state(p1="   ", p3=0), state(p1="", p4=None), state(p1=" AB "))
    shown = flights.api_view(rows).collect()
    assert [r.callsign for r in shown] == ["", None, "AB"]
    assert [r.time_position is None for r in shown] == [True, False, False]
    assert [r.last_contact is None for r in shown] == [False, True, False]
    assert len(shown[0]) == 13


def test_region_limits_are_included(spark):
    corners = [(35, -25), (72, 45), (34.99, 0), (50, 45.01)]
    rows = rows_of(spark, *[state(p6=lat, p5=lon) for lat, lon in corners])
    assert {(r.latitude, r.longitude) for r in flights.in_region(rows, "europe").collect()} == {(35, -25), (72, 45)}


def test_region_names():
    assert region_box("Europe") == REGIONS["EUROPE"]
    assert region_box(None) == REGIONS["NORTH_AMERICA"]
    with pytest.raises(ValueError):
        region_box("MARS")


def test_positions_get_every_region_that_holds_them(spark):
    rows = rows_of(spark, state(p6=36, p5=10), state(p6=-60, p5=0), state(p6=95, p5=0))
    tags = flights.tag_regions(rows).select("latitude", "region").collect()
    assert {tuple(t) for t in tags} == {(36, "EUROPE"), (36, "AFRICA"), (36, "GLOBAL"), (-60, "GLOBAL")}


def test_tagging_needs_no_join(spark):
    plan = flights.tag_regions(rows_of(spark, state()))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_snapshot_limits(spark):
    rows = rows_of(spark, *[state(p0=f"{i:03}") for i in range(5)])
    assert [r.icao24 for r in flights.snapshot(rows, "EUROPE", 2).collect()] == ["000", "001"]
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            flights.snapshot(rows, "EUROPE", limit)


def test_latest_position(spark):
    rows = rows_of(spark, state(p0="a", p4=10), state(p0="a", p4=30), state(p0="a", p4=None), state(p0="b", p4=5))
    rows = rows.unionAll(rows_of(spark, state(p0="a", p4=40, p5="x")))  # no longitude
    latest = flights.latest_position(rows).select("icao24", F.unix_seconds("last_contact"))
    assert sorted(map(tuple, latest.collect())) == [("a", 30), ("b", 5)]


def test_latest_position_shrinks_before_the_shuffle(spark):
    plan = flights.latest_position(rows_of(spark, state()))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and plan.count("Exchange") == 1


def test_latest_by_callsign(spark):
    rows = rows_of(spark, state(p1="AB ", p4=1, p0="x"), state(p1=" AB", p4=2, p0="y"), state(p1="  "), state(p1=None))
    assert [(r.callsign, r.icao24) for r in flights.latest_by_callsign(rows).collect()] == [("AB", "y")]


def test_running_totals(spark):
    chance = random.Random(1)
    times = [chance.choice([0, 86_399, 86_400, 200_000, 10**9, 10**9 + 1]) for _ in range(60)]
    rows = polls.flights_from_polls(lines_of(spark, *[poll(state(), time=t) for t in times]))
    got = flights.running_totals(rows)
    got = got.select(F.unix_seconds("time_ingest"), "update_number", "flights", "total_flights")
    expected, total = [], 0
    for n, t in enumerate(sorted(set(times)), 1):
        total += times.count(t)
        expected.append((t, n, times.count(t), total))
    assert sorted(map(tuple, got.collect())) == expected


def test_stats_of_no_flights(spark):
    row = stats.flight_stats(rows_of(spark)).first()
    assert (row.num_events, row.unique_aircraft, row.max_speed, row.observation_duration) == (0, 0, None, None)


def test_span_counts_whole_elapsed_seconds(spark):
    rows = spark.sql(
        "SELECT 'a' AS icao24, 0D AS vertical_rate, 0D AS velocity, 0D AS geo_altitude,"
        " timestamp_millis(t) AS time_ingest FROM VALUES (900L), (2100L) AS v(t)"
    )
    assert stats.flight_stats(rows).first().observation_duration == 1


def test_histogram(spark):
    rows = rows_of(spark, *[state(p9=v) for v in (0, 49.9, 50, 120, None)])
    got = {(r.bucket, r.speed_from, r.speed_to, r.num_events) for r in explore.speed_histogram(rows, 50).collect()}
    assert got == {(0, 0, 50, 2), (1, 50, 100, 1), (2, 100, 150, 1)}
    with pytest.raises(ValueError):
        explore.speed_histogram(rows, 0)


def test_profile(spark):
    rows = rows_of(spark, state(p9=9, p12=None), state(p9=10, p12=[3]), state(p9=None, p12=[3]), state(p9=10))
    got = {r.column: tuple(r)[1:] for r in explore.profile(rows).collect()}
    assert got["velocity"] == (3, 2, "9.0", "10.0")
    assert got["sensors"] == (3, 2, "[1, 2]", "[3]")
    assert got["icao24"] == (4, 1, "abc123", "abc123")
    assert set(got) == set(rows.columns)


def test_profile_keeps_columns_without_values(spark):
    got = {r.column: tuple(r)[1:] for r in explore.profile(rows_of(spark, state(p9=None))).collect()}
    assert got["velocity"] == (0, 0, None, None)


def test_areas_contain_what_their_limits_say(spark):
    import random

    chance = random.Random(5)
    ends = [None, -90.0, -0.5, 0.0, 12.25, 45.0, 90.0, 95.0, float("inf")]
    spots = [(i, chance.choice([None, *[chance.uniform(-90, 90) for _ in range(9)]]), chance.choice([None, -180.0, 0.0, chance.uniform(-180, 180)])) for i in range(80)]
    spots += [(100, 12.25, 12.25), (101, 95.0, 500.0), (102, float("nan"), 0.0)]
    boxes = []
    for i in range(60):
        if i % 3:
            y, x, size = chance.uniform(-90, 90), chance.uniform(-180, 180), 10 ** chance.uniform(-4, 2)
            boxes.append((f"b{i % 50}", y, y + size, x, x + size * chance.random()))
        else:
            boxes.append((f"b{i}", *[chance.choice(ends) for _ in range(4)]))
    boxes += [("point", 12.25, 12.25, 12.25, 12.25), ("all", -90.0, 90.0, -180.0, 180.0), ("all", -90.0, 90.0, -180.0, 180.0)]
    want = sorted(
        (i, name)
        for i, y, x in spots
        for name, a, b, c, d in boxes
        if None not in (y, x, a, b, c, d) and a <= y <= b and c <= x <= d
    )
    positions = spark.createDataFrame(spots, "id int, latitude double, longitude double")
    table = spark.createDataFrame(boxes, "region string, lamin double, lamax double, lomin double, lomax double")
    assert sorted(map(tuple, areas.tag_areas(positions, table).select("id", "region").collect())) == want
    assert areas.tag_areas(positions, table.where("false")).count() == 0


@pytest.mark.parametrize(("boxes_of", "spots_of", "small"), [(1024, 1 << 17, 362 / 64), (3, 1 << 17, 0.0), (1024, 10, 0.0)])
def test_area_counts_without_pairs(spark, monkeypatch, boxes_of, spots_of, small):
    """All ways of counting agree with brute force, and large boxes make no row for each pair."""
    chance = random.Random(7)
    for name, value in {"MANY_BOXES": boxes_of, "MANY_POSITIONS": spots_of, "SMALL": small, "PART_BOXES": 20, "PART_POSITIONS": 150, "OFTEN": 6}.items():
        monkeypatch.setattr(areas, name, value)
    numbers = [None, -180.0, -90.0, 0.0, 12.25, 90.0, float("nan"), float("inf")]

    def number(low, high):
        return chance.choice(numbers) if chance.random() < 0.2 else chance.uniform(low, high)

    spots = [(chance.choice([None, *"abcdefgggggggg"]), number(-90, 90), number(-180, 180)) for _ in range(400)]
    spots += spots[:20]
    boxes = []
    for _ in range(120):
        south, west = number(-90, 90), number(-180, 180)
        height, width = (10 ** chance.uniform(-2, 2.2) for _ in range(2))
        name = chance.choice([None, *range(80)])
        boxes.append((name, south, None if south is None else south + height, west, None if west is None else west + width))
    boxes += boxes[:10]

    def between(x, low, high):
        order = [(v != v, 0.0 if v != v else v) for v in (low, x, high)]
        return order == sorted(order)

    want = {}
    for name, a, b, c, d in boxes:
        for aircraft, y, x in spots:
            if None not in (a, b, c, d, y, x) and between(y, a, b) and between(x, c, d):
                want.setdefault(name, []).append(aircraft)
    want = {name: (len(v), len(set(v) - {None})) for name, v in want.items()}
    positions = spark.createDataFrame(spots, "icao24 string, latitude double, longitude double")
    table = spark.createDataFrame(boxes, "region int, lamin double, lamax double, lomin double, lomax double")
    counts = areas.area_counts(positions, table)
    assert {r.region: (r.num_events, r.unique_aircraft) for r in counts.collect()} == want
    assert "FlatMapCoGroupsInArrow" in counts._jdf.queryExecution().toString()
    assert areas.area_counts(positions, table.where("false")).count() == 0
    assert areas.area_counts(positions.where("false"), table).count() == 0


def test_dataset_status(spark):
    full, empty = rows_of(spark, state(), state()), rows_of(spark)
    got = stats.dataset_status(full=full, empty=empty).collect()
    assert sorted(map(tuple, got)) == [("empty", False, 0), ("full", True, 2)]


def test_unique_flights_and_scatter(spark):
    rows = rows_of(spark, state(p1="A", p9=None), state(p1="B", p7=None), state(p1=None), state(p1="B", p0="z"))
    assert tuple(explore.unique_flights(rows).first()) == (2, 2)
    assert explore.altitude_velocity(rows).count() == 2
