import random

import pytest
from helpers import utterances_at
from pyspark.sql import functions as F

from aerovox.operators import progress, sequence
from aerovox.operators.utterances import UTTERANCE_ORDER


def test_totals_before(spark):
    chance = random.Random(3)
    seconds = [chance.choice([0, 3600, 86_399, 86_400, 10**8]) for _ in range(50)]
    times = sorted({s * 10**6 + chance.randrange(3) * 400_000 for s in seconds})
    rows = spark.createDataFrame([(t, i + 1) for i, t in enumerate(times)], "us long, n int").select(
        "us", F.timestamp_micros("us").alias("t"), "n"
    )
    rows = rows.unionByName(rows.limit(1).select(F.lit(None).cast("long").alias("us"), F.lit(None).cast("timestamp").alias("t"), F.lit(1000).alias("n")))
    got = sequence.totals_before(rows, "t", ["n"]).orderBy("us").collect()
    assert [r.us for r in got] == [None, *times]
    assert [r.n_before for r in got] == [0, *[1000 + sum(range(1, i + 1)) for i in range(len(times))]]


def test_unfold(spark, monkeypatch):
    monkeypatch.setattr(sequence, "UNFOLD", 3)
    rows = spark.createDataFrame([("a", 1, 10), ("b", 5, 5), ("none", 3, 2)], "k string, lo long, hi long")
    got = sequence.unfold(rows, F.col("lo"), F.col("hi"), "i").select("k", "i").collect()
    assert sorted(map(tuple, got)) == [("a", i) for i in range(1, 11)] + [("b", 5)]


def mixed(spark):
    """Distinct times, one time shared by many conversations, and a hot group of equal rows."""
    seconds = [*range(20), *[30] * 15, *[40] * 40, *range(50, 70)]
    names = [*[f"d{i}" for i in range(20)], *[f"e{i:02}" for i in range(15)]]
    names += [*["hot"] * 40, *[f"f{i}" for i in range(20)]]
    return utterances_at(spark, seconds, names), list(zip(map(float, seconds), names))


def sorted_names(pairs):
    return [name for _, name in sorted(pairs)]


def test_numbered_pages_cover_all_rows_in_order(spark):
    rows, pairs = mixed(spark)
    numbered = sequence.Numbered(rows.repartition(5), UTTERANCE_ORDER)
    seen = []
    for start in range(0, len(pairs), 7):
        page = numbered.page(start, 7).collect()
        assert [r.position for r in page] == list(range(start + 1, min(start + 7, len(pairs)) + 1))
        seen += [r.conversation_id for r in page]
    assert seen == sorted_names(pairs)
    assert numbered.page(len(pairs), 7).count() == 0


def test_numbered_stores_equal_rows_once(spark):
    rows, pairs = mixed(spark)
    stored = sequence.Numbered(rows, UTTERANCE_ORDER).rows
    hot = stored.where("conversation_id = 'hot'").collect()
    assert [(r.copies, r.position) for r in hot] == [(40, 36)]
    assert stored.agg(F.sum("copies")).first()[0] == len(pairs)


def test_numbered_nothing(spark):
    assert sequence.Numbered(utterances_at(spark, [1]).where("false"), UTTERANCE_ORDER).page(0, 5).count() == 0


def test_page(spark):
    rows, pairs = mixed(spark)
    page = sequence.page(rows, UTTERANCE_ORDER, 33, 10).orderBy("position").collect()
    assert [(r.position, r.conversation_id) for r in page] == list(enumerate(sorted_names(pairs), 1))[33:43]


def test_page_bounds(spark):
    rows = utterances_at(spark, [1])
    for start, limit in ((-1, 5), (0, 0), (0, 1001), (9_995, 6)):
        with pytest.raises(ValueError):
            sequence.page(rows, UTTERANCE_ORDER, start, limit)


def test_pages_by_key_walk_the_table(spark):
    rows = utterances_at(spark, [3, 1, 2, 2, 2, 5], list("zabcdy"))
    cursor, seen = None, []
    while page := sequence.page_after(rows, UTTERANCE_ORDER, cursor, 2).collect():
        seen += [r.conversation_id for r in page]
        cursor = tuple(page[-1])[:3]
    assert seen == list("abcdzy")


@pytest.mark.parametrize("limit", [1, 2, 5, 100])
def test_pages_serve_ties_and_nulls_once(spark, limit):
    data = [(None, "x", 1), (None, None, 2), (None, "x", 1), (1.0, "a", 1)] + [(2.0, "k", 0)] * 7 + [(2.0, "k", None), (3.0, None, 5)]
    rows = spark.createDataFrame(data, "timestamp double, conversation_id string, utterance_id int").repartition(3)
    cursor, seen = None, []
    while page := sequence.page_after(rows, UTTERANCE_ORDER, cursor, limit).collect():
        seen += [tuple(r)[:3] for r in page]
        cursor = tuple(page[-1].cursor)
    key = lambda r: [(v is not None, v) for v in r]
    assert seen == sorted(data, key=key)


def chunks_by_hand(seconds, size, total=0):
    seconds = sorted(seconds)
    everything = min(total or len(seconds), len(seconds))
    out = []
    for number, low in enumerate(range(0, everything, size), 1):
        sent = min(low + size, everything)
        elapsed = float(seconds[sent - 1] - seconds[0])
        rate = sent / elapsed if elapsed else 0.0
        said = f"{round(rate, 0)} utterances/second"
        out.append((number, sent - low, sent, round(sent / everything * 100, 2), elapsed, round(rate, 2), said))
    return out


@pytest.mark.parametrize("total", [0, 55, 5000])
@pytest.mark.parametrize("unfold", [1 << 20, 2])
def test_chunk_progress(spark, total, unfold, monkeypatch):
    monkeypatch.setattr(sequence, "UNFOLD", unfold)
    rows, pairs = mixed(spark)
    got = progress.chunk_progress(rows, 10, total).collect()
    assert sorted(map(tuple, got)) == chunks_by_hand([s for s, _ in pairs], 10, total)


def test_chunk_progress_counts_missing_times(spark):
    rows = utterances_at(spark, range(15)).withColumn("timestamp", F.when(F.second("timestamp") > 5, F.col("timestamp")))
    rows = rows.unionByName(rows).unionByName(rows.where("timestamp IS NULL"))
    got = sorted(tuple(r)[:3] for r in progress.chunk_progress(rows, 10).collect())
    assert got == [(1, 10, 10), (2, 10, 20), (3, 10, 30), (4, 6, 36)]


def test_chunk_progress_within_a_second(spark):
    seconds = [i / 4 for i in range(45)] + [86_400.5] * 13
    rows = utterances_at(spark, seconds, [f"c{i}" for i in range(len(seconds))])
    got = sorted(map(tuple, progress.chunk_progress(rows, 10).collect()))
    assert [g[:4] for g in got] == [c[:4] for c in chunks_by_hand(seconds, 10)]
    assert [g[4] for g in got] == pytest.approx([c[4] for c in chunks_by_hand(seconds, 10)], abs=0.011)


def test_chunk_progress_of_nothing(spark):
    assert progress.chunk_progress(utterances_at(spark, [1]).where("false"), 10).count() == 0


def test_chunk_bounds(spark):
    rows = utterances_at(spark, [1])
    for size, total in ((9, 0), (10_001, 0), (10, -1), (10, 1_000_001)):
        with pytest.raises(ValueError):
            progress.chunk_progress(rows, size, total)


def test_sampled_chunks(spark):
    chunks = spark.range(1, 26).withColumnRenamed("id", "chunk_number")
    assert sorted(r[0] for r in progress.sample_chunks(chunks).collect()) == [1, 2, 3, 4, 5, 10, 20]


@pytest.mark.parametrize("unfold", [1 << 20, 2])
def test_chunk_envelopes_hold_every_utterance(spark, unfold, monkeypatch):
    monkeypatch.setattr(sequence, "UNFOLD", unfold)
    monkeypatch.setattr(sequence, "UNFOLD", unfold)
    rows, pairs = mixed(spark)
    got = progress.chunk_envelopes(rows, 10).orderBy("chunk_number")
    said = got.select(F.from_json("envelope", "utterances array<struct<conversation_id string>>").alias("e"))
    names = [u.conversation_id for r in said.collect() for u in r.e.utterances]
    assert names == sorted_names(pairs)
    assert [r.chunk_size for r in got.collect()] == [10] * 9 + [5]


def test_chunk_envelopes_end_early(spark):
    """The end falls among equal rows."""
    rows, pairs = mixed(spark)
    kind = "timestamp string, utterances array<struct<conversation_id string>>, stats struct<total_sent long>, progress struct<sent long, total long, percent double>"
    got = progress.chunk_envelopes(rows, 10, 55).orderBy("chunk_number").select("*", F.from_json("envelope", kind).alias("e")).collect()
    assert [u.conversation_id for r in got for u in r.e.utterances] == sorted_names(pairs)[:55]
    assert [(r.total_sent, r.e.stats.total_sent, r.e.progress.sent) for r in got] == [(n, n, n) for n in (10, 20, 30, 40, 50, 55)]
    assert {r.e.progress.total for r in got} == {55} and got[-1].e.progress.percent == 100.0
    assert got[0].e.timestamp.endswith("+00:00")
    assert '"progress"' not in progress.chunk_envelopes(rows, 10).first().envelope


def test_utterance_progress(spark):
    got = progress.utterance_progress(utterances_at(spark, range(9)), 5).collect()
    assert [r.progress for r in got] == [f"{i}/5" for i in range(1, 6)]
    with pytest.raises(ValueError):
        progress.utterance_progress(utterances_at(spark, [1]), 4)
