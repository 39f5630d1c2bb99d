import json
import pathlib
from functools import reduce

import pytest
from helpers import poll, state
from pyspark.sql import functions as F
from test_sources import land, same

from aerovox import plans, sources, streaming
from aerovox.operators import polls, quality
from aerovox.operators.stats import flight_stats
from aerovox.schemas import UTTERANCE


def land_polls(folder, first, count):
    for i in range(first, first + count):
        rows = [state(p0=f"a{(i + j) % 7}", p9=100.0 * i + j, p11=j - i) for j in range(5)]
        land(folder, f"{i:04}.txt", poll(*rows, time=1000 + 60 * i))


@pytest.fixture
def folders(tmp_path):
    for name in ("landing", "state", "table"):
        (tmp_path / name).mkdir()
    return [str(tmp_path / name) for name in ("landing", "state", "table")]


def test_stream_table_equals_the_batch_and_resumes(spark, folders):
    landing, state_dir, table = folders

    def ingest():
        return streaming.finish(
            streaming.ingest_flights(spark, landing, state_dir, path=table, max_files_per_trigger=2)
        )

    land_polls(landing, 0, 5)
    ingest()
    assert same(spark.read.parquet(table), sources.read_flights(spark, landing))
    assert ingest().recentProgress == [] or spark.read.parquet(table).count() == 25
    land_polls(landing, 5, 2)
    ingest()
    assert spark.read.parquet(table).count() == 35
    assert same(spark.read.parquet(table), sources.read_flights(spark, landing))


def test_region_on_a_stream(spark, folders):
    landing, state_dir, table = folders
    land(landing, "1.txt", poll(state(), state(p6=-80)))
    streaming.finish(streaming.ingest_flights(spark, landing, state_dir, path=table, region="europe"))
    assert spark.read.parquet(table).count() == 1


def test_a_sink_is_needed(spark, folders):
    with pytest.raises(ValueError):
        streaming.ingest_flights(spark, folders[0], folders[1])


def test_bounded_run_stops(spark, folders):
    landing, state_dir, table = folders
    land_polls(landing, 0, 1)
    query = streaming.ingest_flights(spark, landing, state_dir, path=table, every="200 milliseconds")
    streaming.finish(query, seconds=4)
    assert not query.isActive
    assert spark.read.parquet(table).count() == 5


def test_summary(spark, folders):
    landing, state_dir, table = folders
    land_polls(landing, 0, 3)
    query = streaming.finish(streaming.ingest_flights(spark, landing, state_dir, path=table, max_files_per_trigger=1))
    row = streaming.stream_summary(spark, query).first()
    assert (row.status, row.total) == ("complete", 3) and row.throughput_description.endswith(" lines/second")
    positions = streaming.stream_summary(spark, query, "positions").first()
    assert positions.total == 15 and positions.throughput_description.endswith(" positions/second")
    assert row.elapsed_seconds > 0 and row.throughput > 0
    assert streaming.resume_point(query) is not None


def test_summary_of_a_stream_longer_than_spark_remembers(spark, folders):
    landing, state_dir, table = folders
    land_polls(landing, 0, 6)
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(kept, "2")
    try:
        run = streaming.ingest_flights(
            spark, landing, state_dir, path=table, rules=(quality.ICAO24_PRESENT,), max_files_per_trigger=1
        )
        query = streaming.finish(run)
        assert len(query.recentProgress) < 6
        assert streaming.stream_summary(spark, query).first().total == 6
        assert streaming.observed_breaches(spark, query).first().failed == 0
    finally:
        spark.conf.unset(kept)


def test_rules_on_a_stream(spark, folders):
    landing, state_dir, table = folders
    land(landing, "1.txt", poll(state(p9=1), state(p9=None)))
    land(landing, "2.txt", poll(state(p9=None)))
    rules = (quality.ICAO24_PRESENT, quality.Rule("has_speed", "velocity IS NOT NULL", "drop"))
    query = streaming.ingest_flights(spark, landing, state_dir, path=table, rules=rules, max_files_per_trigger=1)
    found = streaming.observed_breaches(spark, streaming.finish(query)).collect()
    assert {tuple(r) for r in found} == {("icao24_not_null", 3, 0), ("has_speed", 3, 2)}
    assert spark.read.parquet(table).count() == 1


def test_failing_rule_ends_the_stream(spark, folders):
    landing, state_dir, table = folders
    land(landing, "1.jsonl", json.dumps({"confidence": 1.2}))
    query = streaming.ingest_transcripts(spark, landing, state_dir, path=table, rules=(quality.CONFIDENCE_IN_RANGE,))
    with pytest.raises(Exception, match="confidence_range"):
        streaming.finish(query)


def test_incremental_stats_equal_the_view(spark, folders):
    landing, state_dir, kept_in = folders
    kept = streaming.incremental_flight_stats(kept_in, buckets=8)

    def update():
        lines = sources.read_line_stream(spark, landing, max_files_per_trigger=3)
        streaming.finish(kept.start(polls.flights_from_polls(lines), state_dir))
        return kept.current(spark).collect()

    assert kept.current(spark).first().num_events == 0
    land_polls(landing, 0, 7)
    assert update() == flight_stats(sources.read_flights(spark, landing)).collect()
    assert update() == flight_stats(sources.read_flights(spark, landing)).collect()
    land_polls(landing, 7, 2)
    # Names that are no address, one of them missing, are counted like the others.
    odd = [state(p0="ABCDEF"), state(p0="abcdef"), state(p0="abcdef0"), state(p0=""), state(p0=None), state(p0="000000")]
    land(landing, "odd.txt", poll(*odd, time=9000))
    assert update() == flight_stats(sources.read_flights(spark, landing)).collect()


def files_of(folder):
    return {str(p.relative_to(folder)) for p in pathlib.Path(folder).rglob("*.parquet") if p.is_file()}


def said(conversation, i):
    return json.dumps({"timestamp": f"2024-01-01T00:00:{i:02}Z", "conversation_id": conversation, "confidence": i / 60})


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, folders):
    landing, state_dir, kept_in = folders
    kept = streaming.incremental_conversation_stats(kept_in, buckets=16)

    def update():
        rows = sources.read_utterance_stream(spark, landing, max_files_per_trigger=1)
        streaming.finish(kept.start(rows, state_dir))
        return kept.current(spark)

    for batch in range(6):
        land(landing, f"{batch}.jsonl", *[said(f"c{i}", batch) for i in range(0, 60, batch + 1)])
    update()
    before = files_of(f"{kept_in}/groups")
    assert len({f.split("/")[0] for f in before}) > 10
    land(landing, "x.jsonl", said("c7", 50))
    got = update()
    after = files_of(f"{kept_in}/groups")
    assert len({f.split("/")[0] for f in before ^ after}) == 1
    rows = sources.read_utterances(spark, landing)
    assert same(rounded(got), rounded(plans.VIEWS["conversation_stats"].query(rows)))


def rounded(stats):
    return stats.withColumn("avg_confidence", F.round("avg_confidence", 9))


def test_a_batch_that_comes_again_changes_nothing(spark, folders):
    _, _, kept_in = folders
    kept = streaming.incremental_transcript_by_speaker(kept_in, buckets=4)

    def totals(*rows):
        return spark.createDataFrame(rows, "speaker string, domain string, count long")

    kept.replace(totals(("agent", "sales", 2), (None, "sales", 1), ("agent", None, 1)), 0)
    kept.replace(totals(("agent", "sales", 5), (None, "sales", 4)), 1)
    want = {("agent", "sales", 5), (None, "sales", 4), ("agent", None, 1)}
    assert set(map(tuple, kept.current(spark).collect())) == want
    # The run ended while buckets were being replaced: their folders are gone, the batch is repeated.
    touched = [r.bucket for r in spark.read.parquet(f"{kept_in}/next").select("bucket").distinct().collect()]
    for file in [f for b in touched for f in pathlib.Path(f"{kept_in}/groups/bucket={b}").glob("*.parquet")]:
        file.unlink()
    kept.replace(totals(("agent", "sales", 5), (None, "sales", 4)), 1)
    assert set(map(tuple, kept.current(spark).collect())) == want


def test_a_stream_stops_after_n_over_restarts(spark, folders):
    landing, state_dir, path = folders
    path += "/taken"
    order = ["timestamp", "conversation_id"]

    def run():
        rows = sources.read_utterance_stream(spark, landing, max_files_per_trigger=1)
        streaming.finish(streaming.take_stream(rows, 13, order, state_dir, path))
        return sorted(r.conversation_id for r in spark.read.parquet(path).collect())

    assert streaming.taken(spark, path) == 0
    land(landing, "0.jsonl", *[said(f"a{i}", i) for i in range(6)])
    assert run() == [f"a{i}" for i in range(6)]
    land(landing, "1.jsonl", *[said(f"b{i}", 50 - i) for i in range(9)])
    land(landing, "2.jsonl", *[said(f"c{i}", i) for i in range(9)])
    # The second file is cut in the order of time.
    want = sorted([f"a{i}" for i in range(6)] + [f"b{i}" for i in range(8, 1, -1)])
    assert run() == want and run() == want and streaming.taken(spark, path) == 13
    # The batch of the cut comes again: it counts what was before it, not what it wrote itself.
    assert streaming.taken(spark, path, before=1) == 6
    with pytest.raises(ValueError):
        streaming.take_stream(spark.readStream.text(landing), 0, order, state_dir, path)


def test_packing_while_the_stream_goes_on(spark, folders):
    landing, state_dir, _ = folders
    packed = streaming.PackedTable("packing", "said", UTTERANCE, fanout=2)

    def take(batch, rows):
        land(landing, f"{batch}.jsonl", *rows)
        streaming.finish(packed.append(sources.read_utterance_stream(spark, landing, max_files_per_trigger=1), state_dir))

    def names():
        return sorted(r.conversation_id for r in packed.rows(spark).collect())

    def tables():
        return {t.name for t in spark.catalog.listTables("packing") if t.name.startswith("said__")}

    want = []
    for batch in range(5):
        rows = [f"{batch}-{i}" for i in range(3)]
        take(batch, [said(r, 1) for r in rows])
        want += rows
        planned = packed.rows(spark)
        assert names() == want
        packed.pack(spark)
        assert names() == want
        # A query planned before the packing still finds its files.
        assert sorted(r.conversation_id for r in planned.collect()) == want
        packed.pack(spark)
        assert names() == want
    assert tables() >= {"said__2_3", "said__0_4"} and len(tables()) <= 4
    # Batches that the segments have had for a turn are gone from the table of batches.
    assert [r.partition for r in spark.sql("SHOW PARTITIONS packing.said_batches").collect()] == ["batch=4"]


def test_a_view_is_never_gone(spark, folders):
    landing, _, _ = folders
    land_polls(landing, 0, 2)
    spark.sql("CREATE DATABASE IF NOT EXISTS steady")
    rows = sources.read_flights(spark, landing)
    plans.publish(flight_stats(rows), "steady", "flight_stats")
    before = plans.read_view(spark, "steady", "flight_stats")
    broken = flight_stats(rows).withColumn("num_events", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        plans.publish(broken, "steady", "flight_stats")
    assert plans.read_view(spark, "steady", "flight_stats").first().num_events == 10
    for doubled in range(1, 3):
        plans.publish(flight_stats(reduce(type(rows).unionAll, [rows] * 2**doubled)), "steady", "flight_stats")
        # One planned before still reads what it was planned on; a new one reads the new rows.
        assert before.first().num_events == 10
        assert plans.read_view(spark, "steady", "flight_stats").first().num_events == 10 * 2**doubled
    plans.publish(flight_stats(rows.limit(3)), "steady", "flight_stats")
    assert plans.read_view(spark, "steady", "flight_stats").first().num_events == 3


def test_refresh_flights(spark, folders):
    landing, state_dir, _ = folders
    land_polls(landing, 0, 2)
    land(landing, "bad.txt", "not json")
    for expected in (10, 10, 15):
        if expected == 15:
            land_polls(landing, 2, 1)
        plans.refresh_flights(spark, landing, state_dir, "sky")
        assert spark.table("sky.ingest_flights").count() == expected
        assert plans.read_view(spark, "sky", "flight_stats").first().num_events == expected
        whole = plans.VIEWS["flight_stats"].query(spark.table("sky.ingest_flights"))
        assert same(plans.read_view(spark, "sky", "flight_stats"), whole)
    assert spark.table("sky.rejected_polls").count() == 1
    assert same(plans.refresh_view(spark, "sky", "flight_stats"), whole)


def test_refresh_transcripts(spark, folders):
    landing, state_dir, _ = folders
    for i, speaker in enumerate(["customer", "agent", "agent"]):
        said = {"timestamp": f"2024-01-0{i + 1}T00:00:00Z", "conversation_id": f"c{i}", "speaker": speaker}
        land(landing, f"{i}.jsonl", json.dumps({**said, "domain": "sales"}))
        plans.refresh_transcripts(spark, landing, state_dir, "calls")
    for name, view in plans.VIEWS.items():
        if view.source == "ingest_transcripts":
            assert same(plans.read_view(spark, "calls", name), view.query(spark.table("calls.ingest_transcripts")))
    by_speaker = plans.read_view(spark, "calls", "transcript_by_speaker").collect()
    assert [(r.speaker, r["count"]) for r in by_speaker] == [("agent", 2), ("customer", 1)]
    latest_first = plans.read_view(spark, "calls", "conversation_stats").collect()
    assert [r.conversation_id for r in latest_first] == ["c2", "c1", "c0"]
