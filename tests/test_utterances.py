import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from helpers import after, lines_of, utterances_at

from aerovox.functions import word_count
from aerovox.operators import stats, utterances
from aerovox.plans import VIEWS


def read(spark, *lines):
    return utterances.normalize(utterances.parse_utterances(lines_of(spark, *lines)))


def test_defaults(spark):
    (row,) = read(spark, "{}").collect()
    assert tuple(row)[1:] == ("unknown", 0, "unknown", "", 1.0, 0.0, 0.0, None, None, None)
    assert abs((row.timestamp - datetime.now()).total_seconds()) < 3600 * 24


def test_timestamps(spark):
    rows = read(
        spark,
        '{"utterance_id": 1, "timestamp": "2024-01-01T00:00:05Z"}',
        '{"utterance_id": 2, "timestamp": "2024-01-01T02:00:05+02:00"}',
        '{"utterance_id": 3, "timestamp": "2024-01-01T00:00:05.250000+00:00"}',
    ).selectExpr("utterance_id", "unix_micros(timestamp) AS us")
    start = int(after(0).timestamp()) * 10**6
    assert {r.utterance_id: r.us - start for r in rows.collect()} == {1: 5_000_000, 2: 5_000_000, 3: 5_250_000}


@pytest.mark.parametrize("stamp", ["", "soon", None])
def test_unreadable_timestamps_become_the_present(spark, stamp):
    line = "{}" if stamp is None else f'{{"timestamp": "{stamp}"}}'
    row = read(spark, line).selectExpr("unix_seconds(current_timestamp()) - unix_seconds(timestamp) AS age").first()
    assert abs(row.age) < 600


def test_lines_that_are_no_object_are_rejected(spark):
    lines = ["nope", "[1]", '{"text": "a"}', '{"text": "b"']
    rows = lines_of(spark, *lines)
    assert [r.text for r in utterances.parse_utterances(rows).collect()] == ["a"]
    assert sorted(r.value for r in utterances.rejected_utterances(rows).collect()) == sorted(["nope", "[1]", lines[3]])


def test_schema_is_fixed(spark):
    rows = read(spark, '{"text": "a", "other": 1}')
    assert [f.nullable for f in rows.schema][:5] == [False] * 5
    assert len(rows.columns) == 11


def test_word_count(spark):
    texts = ["", "  ", "one", " two  words ", "a\nb\tc", "über uns"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.n for r in rows.select("i", word_count(rows.text).alias("n")).orderBy("i").collect()]
    assert got == [len(t.split()) for t in texts]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conversation_id string, utterance_id int, text string")


def timed_by_hand(rows):
    clock, out = {}, {}
    for conv, turn, text in sorted(rows):
        start = clock.get(conv, 0.0)
        end = start + len(text.split()) * 0.5
        clock[conv] = end + 0.5
        out[conv, turn] = (start, end)
    return out


def test_timing(spark):
    chance = random.Random(2)
    rows = [("hot", i, "w " * chance.randrange(5)) for i in range(40)]
    rows += [(f"c{c}", i, "w " * chance.randrange(5)) for c in range(5) for i in range(c)]
    got = utterances.utterance_timing(turns(spark, rows)).collect()
    assert {(r.conversation_id, r.utterance_id): (r.start_time, r.end_time) for r in got} == timed_by_hand(rows)


@pytest.fixture
def small_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_timing_spreads_one_id(spark, small_tasks):
    """A conversation of one id, and one of equal rows, are each dealt to several tasks."""
    rows = turns(spark, [("unknown", 0, "w " * (i % 7)) for i in range(4000)])
    for said in (rows, rows.withColumn("text", F.lit("w w"))):
        timed = utterances.utterance_timing(said)
        got = timed.select(F.spark_partition_id().alias("task"), "start_time", "end_time").collect()
        assert len({r.task for r in got}) >= 2
        ordered = sorted((r.start_time, r.end_time) for r in got)
        # Each starts half a second after the one before has ended.
        assert ordered[0][0] == 0.0 and all(b[0] == a[1] + 0.5 for a, b in zip(ordered, ordered[1:]))


def test_timing_of_nothing(spark):
    assert utterances.utterance_timing(turns(spark, [("a", 1, "x")]).where("false")).count() == 0


def test_served_rows_carry_the_present(spark):
    row = utterances.serve(utterances_at(spark, [1])).selectExpr("current_timestamp() = timestamp AS now").first()
    assert row.now


def test_conversation_lookup(spark):
    rows = turns(spark, [("a", 2, "y"), ("b", 1, "n"), ("a", 1, "x")])
    assert [r.text for r in utterances.conversation(rows, "a").collect()] == ["x", "y"]


def test_recent_and_feed(spark):
    rows = utterances_at(spark, range(30)).selectExpr("*", "'agent' AS speaker", "repeat('ä', 60) AS text")
    recent = utterances.recent(rows, 20).collect()
    assert [r.conversation_id for r in recent] == [f"c{s}" for s in range(29, 9, -1)]
    shown = utterances.feed(rows).where("conversation_id = 'c7'").first()
    assert (shown["at"], shown.speaker, shown.preview) == ("2024-01-01T00:00:07", "AGENT", "ä" * 50)


def speakers(spark, *names):
    rows = [("c", "billing", "inbound", "x", n, 0.5, float(i)) for i, n in enumerate(names)]
    return spark.createDataFrame(
        rows,
        "conversation_id string, domain string, topic string, accent string, speaker string, confidence double,"
        " end_time double",
    ).selectExpr("*", "timestamp_seconds(cast(end_time AS long)) AS timestamp")


def test_other_speakers_count_in_the_total_only(spark):
    row = stats.conversation_stats(speakers(spark, "agent", "customer", "unknown", "agent")).first()
    assert (row.total_utterances, row.agent_utterances, row.customer_utterances) == (4, 2, 1)
    assert (row.avg_confidence, row.conversation_duration) == (0.5, 3.0)


def test_feed_counts_everyone_else_as_customer(spark):
    assert tuple(stats.feed_counters(speakers(spark, "agent", "customer", "unknown", None)).first()) == (4, 1, 3)


def test_views_are_sorted(spark):
    rows = speakers(spark, "b", "a", "b")
    assert [r.speaker for r in VIEWS["transcript_by_speaker"].live(rows).collect()] == ["a", "b"]


def test_load_estimate(spark):
    other = speakers(spark, "a").selectExpr("'d' AS conversation_id", "* EXCEPT (conversation_id)")
    rows = speakers(spark, *"abc").unionAll(other)
    assert tuple(stats.load_estimate(rows).first()) == (4, 2, 2.0, 11, 1_000_000)


def test_load_estimate_of_nothing(spark):
    assert tuple(stats.load_estimate(speakers(spark, "a").where("false")).first()) == (0, 0, None, None, None)


def test_timing_does_not_depend_on_other_rows(spark):
    said = [("a", i, "one") for i in (-1, 0, 1)] + [(None, i, "one two") for i in (1, 5000)]
    alone = {(r.utterance_id, r.start_time) for r in utterances.utterance_timing(turns(spark, said[:3])).collect()}
    got = utterances.utterance_timing(turns(spark, [*said, ("a", 5000, "one")])).collect()
    assert alone == {(-1, 0.0), (0, 1.0), (1, 2.0)}
    assert {(r.utterance_id, r.start_time) for r in got if r.conversation_id == "a"} == {*alone, (5000, 3.0)}
    assert {(r.utterance_id, r.start_time) for r in got if r.conversation_id is None} == {(1, 0.0), (5000, 1.5)}


def test_distribution(spark):
    got = stats.distribution(speakers(spark, "a", "b", "a"), "speaker").collect()
    assert {r.speaker: r["count"] for r in got} == {"a": 2, "b": 1}
