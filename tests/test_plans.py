"""What the plans over stored tables look like: what is read, what is shuffled."""

import re

import pytest

import fixtures
from aerovox.operators import areas, explore, flights, polls, quality, sequence, stats, utterances
from aerovox.session import store


@pytest.fixture(scope="module")
def sky(spark, small):
    return store(fixtures.flights(spark, small), "sky")


@pytest.fixture(scope="module")
def calls(spark, small):
    return store(fixtures.utterances(spark, small), "calls")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Columns of each file scan."""
    scans = re.findall(r"FileScan parquet \[(.*?)\]", plan(df))
    return [sorted(re.sub(r"#\d+L?", "", s).split(",")) for s in scans]


def test_flight_stats_reads_its_columns_only(sky):
    columns = ["geo_altitude", "icao24", "time_ingest", "velocity", "vertical_rate"]
    assert scanned(stats.flight_stats(sky)) == [columns]


def test_flight_stats_combines_before_each_shuffle(sky):
    text = plan(stats.flight_stats(sky))
    assert "Expand" not in text
    assert text.count("Exchange") == 2 and "partial_count" in text


def test_region_filter_reaches_the_scan(sky):
    text = plan(flights.in_region(sky, "EUROPE"))
    assert "GreaterThanOrEqual(latitude,35.0)" in text and "LessThanOrEqual(longitude,45.0)" in text
    assert "Exchange" not in text


def test_conversation_filter_reaches_the_scan(calls):
    assert "EqualTo(conversation_id,conv_000001)" in plan(utterances.conversation(calls, "conv_000001"))


def test_limits_are_top_k(sky, calls):
    assert "TakeOrderedAndProject" in plan(flights.snapshot(sky, "EUROPE", 10))
    assert "TakeOrderedAndProject" in plan(utterances.recent(calls))
    after = sequence.page_after(calls, ["utterance_id"], (3,), 10)
    assert "TakeOrderedAndProject" in plan(after) and "GreaterThanOrEqual(utterance_id,3)" in plan(after)


@pytest.mark.parametrize("build", [flights.api_view, explore.altitude_velocity, flights.tag_regions])
def test_projections_do_not_shuffle(sky, build):
    assert "Exchange" not in plan(build(sky))


def test_rules_need_one_pass(sky):
    text = plan(quality.report(sky, quality.ICAO24_PRESENT, quality.COORDINATES_PRESENT))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "Exchange" not in plan(quality.enforce(sky, quality.ICAO24_PRESENT, quality.COORDINATES_PRESENT))


def test_profile_reads_each_column_once(sky):
    assert sorted(sum(scanned(explore.profile(sky)), [])) == sorted(sky.columns)
    text = plan(explore.profile(sky))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 2


def test_areas_meet_on_cells(spark, sky):
    boxes = spark.range(20_000).selectExpr("id AS region", "id % 80 AS lamin", "id % 80 + 1 AS lamax", "id % 170 AS lomin", "id % 170 + 1 AS lomax")
    text = plan(areas.tag_areas(sky, boxes))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Join" in text and "_level" in text


@pytest.mark.parametrize("build", [polls.poll_envelopes, polls.poll_labels, polls.flights_from_polls, utterances.parse_utterances])
def test_lines_are_parsed_once(spark, build):
    lines = spark.createDataFrame([("{}",)], "value string")
    optimized = build(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("from_json(") == 1


def test_envelopes_do_not_shuffle(spark, small):
    lines = store(fixtures.poll_lines(spark, small), "lines")
    for df in (polls.poll_envelopes(lines), polls.poll_labels(lines), polls.rejected_polls(lines)):
        assert "Exchange" not in plan(df)


def test_a_page_reads_the_ranges_it_touches(calls):
    numbered = sequence.Numbered(calls, utterances.UTTERANCE_ORDER)
    text = plan(numbered.page(40, 5))
    assert "PartitionFilters: [" in text and "_range" in text
    assert "GreaterThanOrEqual(_end," in text
