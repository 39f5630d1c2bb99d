"""Operators on utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerovox.functions import word_count
from aerovox.operators.sequence import prefix_sums
from aerovox.schemas import UTTERANCE, UTTERANCE_RAW

# What stands in for a missing key.
DEFAULTS = {
    "conversation_id": "unknown",
    "utterance_id": 0,
    "speaker": "unknown",
    "text": "",
    "confidence": 1.0,
    "start_time": 0.0,
    "end_time": 0.0,
}

# Replay order; the three together identify an utterance.
UTTERANCE_ORDER = ["timestamp", "conversation_id", "utterance_id"]

# Speaking time per word and silence after an utterance, in seconds.
SECONDS_PER_WORD = 0.5
PAUSE_SECONDS = 0.5

_CORRUPT = "_corrupt"


def _parse(lines: DataFrame) -> DataFrame:
    options = {"columnNameOfCorruptRecord": _CORRUPT}
    layout = T.StructType([*UTTERANCE_RAW.fields, T.StructField(_CORRUPT, T.StringType())])
    return lines.select("value", F.from_json("value", layout, options).alias("said"))


def parse_utterances(lines: DataFrame) -> DataFrame:
    """``value`` text lines -> utterances as landed; lines that are no JSON object give none."""
    # One expression and no filter after it, or Spark would parse each line twice.
    good = F.col("said").isNotNull() & F.col(f"said.{_CORRUPT}").isNull()
    row = F.struct(*[F.col(f"said.{c}") for c in UTTERANCE_RAW.names])
    return _parse(lines).select(F.inline(F.when(good, F.array(row))))


def rejected_utterances(lines: DataFrame) -> DataFrame:
    """The lines that ``parse_utterances`` leaves out."""
    return (
        _parse(lines).where(F.col("said").isNull() | F.col(f"said.{_CORRUPT}").isNotNull()).select("value")
    )


def normalize(raw: DataFrame) -> DataFrame:
    """Landed utterances with every default filled in; unreadable times become the present."""
    filled = {name: F.coalesce(F.col(name), F.lit(value)) for name, value in DEFAULTS.items()}
    filled["timestamp"] = F.coalesce(F.try_to_timestamp("timestamp"), F.current_timestamp())
    return raw.select(
        *[filled.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in UTTERANCE.fields]
    )


def serve(utterances: DataFrame) -> DataFrame:
    """The rows stamped with the present as their serving time."""
    return utterances.withColumn("timestamp", F.current_timestamp())


def utterance_timing(turns: DataFrame, pause: float = PAUSE_SECONDS) -> DataFrame:
    """Adds ``start_time`` and ``end_time`` within the call.

    Speaking takes time by the word, and each utterance starts after all earlier ones of its
    conversation and their pauses. Utterances of one id follow each other in the order of a hash,
    equal ones in any order. Those without a conversation are one conversation, those without an
    id come first. A conversation of any length is a prefix sum over many tasks.
    """
    added = ["duration", "start_time", "end_time"]
    spoken = turns.drop(*added).withColumn("duration", word_count(F.col("text")) * F.lit(SECONDS_PER_WORD))
    step = F.coalesce("duration", F.lit(0.0)) + F.lit(pause)
    timed = prefix_sums(spoken, "conversation_id", ["utterance_id"], start_time=step)
    return timed.withColumn("end_time", F.col("start_time") + F.col("duration"))


def conversation(utterances: DataFrame, conversation_id: str) -> DataFrame:
    """All utterances of one conversation, in speaking order."""
    return utterances.where(F.col("conversation_id") == conversation_id).orderBy("utterance_id")


def feed(utterances: DataFrame, prefix: int = 50) -> DataFrame:
    """What a live feed shows: upper-case speaker, the start of the text, time to the second."""
    return utterances.select(
        "conversation_id",
        "utterance_id",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
        F.upper("speaker").alias("speaker"),
        F.substring("text", 1, prefix).alias("preview"),
    )


def recent(utterances: DataFrame, keep: int = 20) -> DataFrame:
    """The newest utterances, newest first."""
    return utterances.orderBy(*[F.col(c).desc() for c in UTTERANCE_ORDER]).limit(keep)
