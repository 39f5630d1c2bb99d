"""Small inputs written by hand."""

import json
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

START = datetime(2024, 1, 1, tzinfo=UTC)

STATE = ["abc123", "FL1     ", "Nowhere", 100, 200, 10.5, 50.5, 1000, False, 250.5, 90, -1.5]
STATE += [[1, 2], 1030, "7000", False, 3]


def state(**changes):
    """A complete state; ``p7="x"`` puts "x" at position 7."""
    values = list(STATE)
    for position, value in changes.items():
        values[int(position[1:])] = value
    return values


def poll(*states, time=1000):
    return json.dumps({"time": time, "states": list(states)})


def lines_of(spark, *lines):
    return spark.createDataFrame([(line,) for line in lines], "value string")


def utterances_at(spark, seconds, conversations=None):
    """Utterances at the given seconds; equal entries are equal rows."""
    names = conversations or [f"c{s}" for s in seconds]
    rows = [(float(s), name, 1) for s, name in zip(seconds, names, strict=True)]
    base = int(START.timestamp())
    return spark.createDataFrame(rows, "at double, conversation_id string, utterance_id int").select(
        F.timestamp_seconds(F.col("at") + base).alias("timestamp"), "conversation_id", "utterance_id"
    )


def after(seconds):
    return START + timedelta(seconds=seconds)
