"""Record layouts of both data sets."""

from __future__ import annotations

from pyspark.sql import types as T

# One landed poll: epoch seconds plus positional states of mixed element type.
POLL_DDL = "time BIGINT, states ARRAY<ARRAY<VARIANT>>"

# Column names, order and types of a flight state.
FLIGHT = T.StructType(
    [
        T.StructField("time_ingest", T.TimestampType()),
        T.StructField("icao24", T.StringType()),
        T.StructField("callsign", T.StringType()),
        T.StructField("origin_country", T.StringType()),
        T.StructField("time_position", T.TimestampType()),
        T.StructField("last_contact", T.TimestampType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("geo_altitude", T.DoubleType()),
        T.StructField("on_ground", T.BooleanType()),
        T.StructField("velocity", T.DoubleType()),
        T.StructField("true_track", T.DoubleType()),
        T.StructField("vertical_rate", T.DoubleType()),
        T.StructField("sensors", T.ArrayType(T.IntegerType())),
        T.StructField("baro_altitude", T.DoubleType()),
        T.StructField("squawk", T.StringType()),
        T.StructField("spi", T.BooleanType()),
        T.StructField("category", T.IntegerType()),
    ]
)

# The public view of a flight shows the first 13 columns.
FLIGHT_API = T.StructType(FLIGHT.fields[:13])

# Shortest state that is still complete.
STATE_WIDTH = 17

# Column names, order, types and nullability of an utterance.
UTTERANCE = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("utterance_id", T.IntegerType(), False),
        T.StructField("speaker", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("start_time", T.DoubleType()),
        T.StructField("end_time", T.DoubleType()),
        T.StructField("domain", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("accent", T.StringType()),
    ]
)

# As landed: the timestamp is still text and any key may be missing.
UTTERANCE_RAW = T.StructType(
    [T.StructField("timestamp", T.StringType())]
    + [T.StructField(f.name, f.dataType) for f in UTTERANCE.fields[1:]]
)
