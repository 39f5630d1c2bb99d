"""From landed poll lines to flight rows. Every step is a narrow, per-row operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovox.functions import epoch_timestamp, flight_label, loose_boolean, loose_double, loose_int, loose_text
from aerovox.functions import public_callsign
from aerovox.operators.flights import api_epoch
from aerovox.schemas import FLIGHT, FLIGHT_API, POLL_DDL, STATE_WIDTH

# How each column of a flight row is read, in the order of positions 0 to 16 of a state.
_READERS = {
    "icao24": loose_text,
    "callsign": loose_text,
    "origin_country": loose_text,
    "time_position": lambda v: epoch_timestamp(loose_double(v)),
    "last_contact": lambda v: epoch_timestamp(loose_double(v)),
    "longitude": loose_double,
    "latitude": loose_double,
    "geo_altitude": loose_double,
    "on_ground": loose_boolean,
    "velocity": loose_double,
    "true_track": loose_double,
    "vertical_rate": loose_double,
    "sensors": lambda v: F.try_variant_get(v, "$", "array<int>"),
    "baro_altitude": loose_double,
    "squawk": loose_text,
    "spi": loose_boolean,
    "category": loose_int,
}
_POSITION = {name: i for i, name in enumerate(_READERS)}


def parse_polls(lines: DataFrame) -> DataFrame:
    """``value`` text lines -> the line plus ``poll`` (null fields where it is no poll)."""
    return lines.select("value", F.from_json("value", POLL_DDL).alias("poll"))


def decode_polls(lines: DataFrame) -> DataFrame:
    """One row per state: ``time`` and the raw ``state``. Unreadable or empty polls give none."""
    # One expression and no filter before the explode, or Spark would parse each line twice.
    states = F.when(F.col("poll.time").isNotNull(), F.col("poll.states"))
    return parse_polls(lines).select(F.col("poll.time").alias("time"), F.explode(states).alias("state"))


def rejected_polls(lines: DataFrame) -> DataFrame:
    """Lines that are no poll: not JSON, or without a poll time."""
    return parse_polls(lines).where(F.col("poll.time").isNull()).select("value")


def is_valid_state(state: Column) -> Column:
    """Complete, with an address and both raw coordinates present."""

    def present(name: str) -> Column:
        return F.coalesce(~F.is_variant_null(F.get(state, F.lit(_POSITION[name]))), F.lit(False))

    return (
        (F.size(state) >= STATE_WIDTH)
        & present("icao24")
        & present("longitude")
        & present("latitude")
    )


def valid_states(states: DataFrame) -> DataFrame:
    return states.where(is_valid_state(F.col("state")))


def _read(state: Column, name: str) -> Column:
    return _READERS[name](F.get(state, F.lit(_POSITION[name]))).cast(FLIGHT[name].dataType).alias(name)


def to_flight_rows(states: DataFrame) -> DataFrame:
    """``time``, ``state`` -> the 18 flight columns."""
    return states.select(
        epoch_timestamp(F.col("time")).alias("time_ingest"),
        *[_read(F.col("state"), name) for name in FLIGHT.names[1:]],
    )


def flights_from_polls(lines: DataFrame) -> DataFrame:
    """Landed poll lines -> valid flight rows, on a batch or on a stream."""
    return to_flight_rows(valid_states(decode_polls(lines)))


def _public_states(poll: Column) -> Column:
    """Valid states of one poll as an array of public 13-column flights, in payload order.

    A poll is one landed line, so the array is never larger than the line it came from.
    """

    def public(state: Column) -> Column:
        def read(name: str) -> Column:
            value = _read(state, name)
            if name in ("time_position", "last_contact"):
                value = api_epoch(value)
            elif name == "callsign":
                value = public_callsign(value)
            return value.alias(name)

        return F.struct(
            epoch_timestamp(poll["time"]).alias("time_ingest"),
            *[read(name) for name in FLIGHT_API.names[1:]],
        )

    valid = F.filter(F.coalesce(poll["states"], F.array().cast("array<array<variant>>")), is_valid_state)
    return F.transform(valid, public)


def public_polls(lines: DataFrame) -> DataFrame:
    """One row per poll: ``time_ingest``, ``count`` and its public ``flights``. No shuffle."""
    row = F.struct(epoch_timestamp(F.col("poll.time")).alias("time_ingest"), _public_states(F.col("poll")).alias("flights"))
    # One expression and no filter after it, or Spark would parse each line twice.
    rows = parse_polls(lines).select(F.inline(F.when(F.col("poll.time").isNotNull(), F.array(row))))
    return rows.select("time_ingest", F.size("flights").cast("long").alias("count"), "flights")


# How the envelopes write timestamps.
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
PLAIN_UTC = "yyyy-MM-dd HH:mm:ss'+00:00'"


def poll_envelopes(lines: DataFrame) -> DataFrame:
    """``{timestamp, count, flights}`` as JSON text, one envelope per poll."""
    envelope = F.struct(F.date_format("time_ingest", ISO_UTC).alias("timestamp"), "count", "flights")
    return public_polls(lines).select(
        "time_ingest",
        "count",
        F.to_json(envelope, {"ignoreNullFields": "false", "timestampFormat": PLAIN_UTC}).alias("envelope"),
    )


def poll_labels(lines: DataFrame, first: int = 3) -> DataFrame:
    """Display text of each poll: how many flights, and the labels of the first few."""
    labels = F.transform(
        F.slice("flights", 1, first),
        lambda f: flight_label(f["callsign"], f["icao24"], f["origin_country"]),
    )
    return public_polls(lines).select("time_ingest", "count", F.array_join(labels, ", ").alias("labels"))


def error_envelopes(lines: DataFrame) -> DataFrame:
    """``{error, timestamp}`` as JSON text for each line that is no poll."""
    error = F.struct(
        F.lit("not a poll").alias("error"), F.date_format(F.current_timestamp(), ISO_UTC).alias("timestamp")
    )
    return rejected_polls(lines).select("value", F.to_json(error).alias("envelope"))
