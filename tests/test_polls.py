import json

from helpers import lines_of, poll, state
from pyspark.sql import functions as F

from aerovox.operators import polls


def decoded(spark, *lines):
    return polls.flights_from_polls(lines_of(spark, *lines)).collect()


def one(spark, **changes):
    (row,) = decoded(spark, poll(state(**changes)))
    return row


def test_columns_and_types(spark):
    row = one(spark)
    assert (row.icao24, row.callsign, row.origin_country) == ("abc123", "FL1     ", "Nowhere")
    assert (row.longitude, row.latitude, row.geo_altitude, row.baro_altitude) == (10.5, 50.5, 1000.0, 1030.0)
    assert (row.on_ground, row.spi, row.category, row.squawk) == (False, False, 3, "7000")
    assert row.sensors == [1, 2]


def test_epochs_are_utc(spark):
    times = polls.flights_from_polls(lines_of(spark, poll(state()))).select(
        *[F.unix_seconds(c) for c in ("time_ingest", "time_position", "last_contact")]
    )
    assert tuple(times.first()) == (1000, 100, 200)


def test_incomplete_states_are_dropped(spark):
    assert decoded(spark, poll(state()[:16])) == []
    assert decoded(spark, poll(None)) == []
    assert decoded(spark, poll([])) == []
    for position in ("p0", "p5", "p6"):
        assert decoded(spark, poll(state(**{position: None}))) == []


def test_longer_states_are_kept(spark):
    assert len(decoded(spark, poll(state() + ["more"]))) == 1


def test_bad_coordinate_is_kept_as_null(spark):
    assert one(spark, p5="x").longitude is None


def test_loose_numbers(spark):
    assert one(spark, p9="bad").velocity is None
    assert one(spark, p9="12.5").velocity == 12.5
    assert one(spark, p9=None).velocity is None
    assert one(spark, p16=3.7).category == 3
    assert one(spark, p16="3.7").category is None
    assert one(spark, p16="37").category == 37


def test_truth_of_values(spark):
    seen = {json.dumps(v): one(spark, p8=v).on_ground for v in (True, False, None, 0, 2, 0.0, "", "false", [], [0])}
    assert seen == {
        "true": True, "false": False, "null": None, "0": False, "2": True, "0.0": False,
        '""': False, '"false"': True, "[]": False, "[0]": True,
    }


def test_missing_times_stay_null_and_keep_the_row(spark):
    assert one(spark, p3=None).time_position is None
    assert one(spark, p4=None).last_contact is None
    assert one(spark, p3=1e30).time_position is None


def test_polls_without_states_give_nothing(spark):
    assert decoded(spark, '{"time": 5, "states": null}', '{"time": 5}', '{"time": 5, "states": []}') == []


def test_one_bad_poll_leaves_the_others(spark):
    assert len(decoded(spark, "not json", poll(state()), '{"states": []}')) == 1


def test_rejected_polls(spark):
    lines = ["not json", poll(state())[:-1], '{"states": []}', '{"time": 5, "states": null}', poll(state())]
    assert [r.value for r in polls.rejected_polls(lines_of(spark, *lines)).collect()] == lines[:3]


def test_error_envelopes(spark):
    (row,) = polls.error_envelopes(lines_of(spark, "not json", poll(state()))).collect()
    assert row.value == "not json" and set(json.loads(row.envelope)) == {"error", "timestamp"}


def test_envelope_holds_the_public_flights(spark):
    line = poll(state(p1="  AB  ", p3=0), state(p5=None), state(p0="zz", p1=""), time=86400)
    (row,) = polls.poll_envelopes(lines_of(spark, line)).collect()
    envelope = json.loads(row.envelope)
    assert (row["count"], envelope["count"], envelope["timestamp"]) == (2, 2, "1970-01-02T00:00:00+00:00")
    first, second = envelope["flights"]
    assert (first["callsign"], first["time_position"]) == ("AB", None)
    assert (second["callsign"], second["last_contact"]) == (None, "1970-01-01 00:03:20+00:00")
    assert len(first) == 13


def test_envelope_of_an_empty_poll(spark):
    (row,) = polls.poll_envelopes(lines_of(spark, '{"time": 5, "states": null}')).collect()
    assert json.loads(row.envelope)["flights"] == []


def test_labels_name_the_first_three(spark):
    states = [state(p0=f"id{i}", p1=None if i == 1 else f"F{i} ") for i in range(5)]
    (row,) = polls.poll_labels(lines_of(spark, poll(*states))).collect()
    assert (row["count"], row.labels) == (5, "F0 (Nowhere), id1 (Nowhere), F2 (Nowhere)")


def test_decoding_is_one_narrow_parse(spark):
    plan = polls.flights_from_polls(lines_of(spark, poll(state())))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("from_json(") == 1
