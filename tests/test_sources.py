import gzip
import json
import os

import pytest
from helpers import poll, state

from aerovox import sources, streaming
from aerovox.sources import formats


def land(folder, name, *rows):
    path = os.path.join(folder, name)
    with open(path, "w") as file:
        file.write("\n".join(rows) + "\n")
    return path


@pytest.fixture
def landing(tmp_path):
    folder = str(tmp_path)
    bad = ['{"time": 7}', "not json", poll(state(p0=None), None, []), '{"time": "5", "states": [[]]}', "", "[1]"]
    land(folder, "0001.txt", poll(state(p5="x", p9="bad", p16=3.7, p8=2, p12=None), time=5), *bad)
    land(folder, "0002.txt", poll(*[state(p0=f"{i:02}", p6=i) for i in range(30)], time=86400))
    land(folder, "_hidden.txt", poll(state(p0="hidden")))
    return folder


def same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_format_gives_what_the_reader_gives(spark, landing, block, monkeypatch):
    monkeypatch.setattr(formats, "READ_BYTES", block)
    batches = [b for _, path in formats.landed_files(landing) for b in formats.read_landed(landing, path)]
    lines = [v.as_py() for b in batches for v in b.column(0)]
    assert sorted(lines) == sorted(r.value for r in sources.read_lines(spark, landing).collect())
    sources.register(spark)
    scanned = sources.flights_in(spark.read.format("landed_lines").load(landing), None)
    assert scanned.count() == 31
    assert same(scanned, sources.read_flights(spark, landing))
    assert sources.flights_in(spark.read.format("landed_lines").load(landing), "africa").count() == 30
    with pytest.raises(ValueError):
        sources.read_flights(spark, landing, "MARS")


def test_compressed_files_sub_folders_and_nothing(spark, tmp_path):
    sources.register(spark)
    assert spark.read.format("landed_lines").load(str(tmp_path)).count() == 0
    os.makedirs(tmp_path / "day=1" / "_skipped")
    with gzip.open(tmp_path / "day=1" / "x.txt.gz", "wt") as file:
        file.write("one\ntwo")
    land(str(tmp_path / "day=1" / "_skipped"), "y", "hidden")
    land(str(tmp_path), "z", "three\r", "", "ä")
    got = sorted(r.value for r in spark.read.format("landed_lines").load(str(tmp_path)).collect())
    assert got == ["", "one", "three", "two", "ä"]


def test_bad_options(spark, landing):
    sources.register(spark)
    with pytest.raises(Exception, match="unknown options"):
        spark.read.format("landed_lines").option("interval", "5").load(landing)


def test_utterances(spark, tmp_path):
    sources.register(spark)
    said = {"timestamp": "2024-01-01T00:00:00Z", "conversation_id": "c", "utterance_id": 1, "text": "ä\n"}
    odd = [{"speaker": None, "confidence": 2}, {"speaker": 7}, {"confidence": "high"}, {"utterance_id": 1.5}]
    odd += [{"utterance_id": 2**40}, {"end_time": True}]
    land(str(tmp_path), "1.jsonl", json.dumps(said), "nope", "[]", *[json.dumps({**said, **o}) for o in odd])
    scanned = sources.utterances_in(spark.read.format("landed_lines").load(str(tmp_path)))
    assert scanned.count() == 3
    assert same(scanned, sources.read_utterances(spark, str(tmp_path)))


def test_rows_per_file_bound_a_batch(spark, tmp_path):
    from helpers import utterances_at

    sources.write_utterances(utterances_at(spark, range(10)).coalesce(1), f"{tmp_path}/landing", rows_per_file=4)
    rows = sources.read_utterance_stream(spark, f"{tmp_path}/landing", max_files_per_trigger=1)
    query = streaming.finish(streaming.append_stream(rows, f"{tmp_path}/state", path=f"{tmp_path}/table"))
    assert sorted(p.numInputRows for p in query.recentProgress) == [2, 4, 4]


def run(spark, folder, state_dir, table):
    query = (
        sources.flights_in(spark.readStream.format("landed_lines").option("settle_seconds", 0).load(folder), None)
        .writeStream.format("parquet")
        .option("path", table).option("checkpointLocation", state_dir).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(table).count()


def test_stream_resumes_after_the_last_file(spark, landing, tmp_path_factory):
    sources.register(spark)
    work = str(tmp_path_factory.mktemp("work"))
    args = (spark, landing, f"{work}/state", f"{work}/table")
    assert run(*args) == 31
    assert run(*args) == 31
    land(landing, "0000.txt", poll(state()))  # a name before all that were read
    assert run(*args) == 32


def test_stream_waits_until_a_file_has_settled(landing):
    assert formats._StreamReader(landing, 60).latestOffset() == {"time": 0, "path": ""}
    assert formats._StreamReader(landing, 0).latestOffset()["path"].endswith("0002.txt")


def test_stream_reads_a_file_that_appears_with_an_older_time(spark, landing, tmp_path_factory):
    sources.register(spark)
    work = str(tmp_path_factory.mktemp("work"))
    args = (spark, landing, f"{work}/state", f"{work}/table")
    assert run(*args) == 31
    os.utime(land(work, "early.txt", poll(state())), (1_000_000_000, 1_000_000_000))
    os.rename(f"{work}/early.txt", f"{landing}/early.txt")  # keeps the time
    assert run(*args) == 32
    assert run(*args) == 32
