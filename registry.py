"""Every query by name, next to the SQL that must give the same rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fixtures
from aerovox import sources, streaming
from aerovox.operators import areas, bitmaps, explore, flights, paging, polls, progress, quality, sequence, stats, utterances
from aerovox.plans import VIEWS
from aerovox.schemas import FLIGHT, FLIGHT_API, UTTERANCE
from aerovox.session import scratch_path, store

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Registers a query with its SQL, which may use the views of ``fixtures``."""

    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _comparable(build(spark, sf_dir))
        _SQL[name] = sql
        return build

    return add


def oracles() -> dict[str, str]:
    views = fixtures.duckdb_views()
    return {name: f"WITH {views}\n{sql}" for name, sql in _SQL.items()}


def _comparable(df: DataFrame) -> DataFrame:
    """Timestamps without zone and lists as text, which any engine compares alike."""

    def show(name: str, kind: str) -> F.Column:
        if kind == "timestamp":
            return F.col(name).cast("timestamp_ntz").alias(name)
        return F.col(name).cast("string").alias(name) if kind.startswith("array") else F.col(name)

    return df.select(*[show(name, kind) for name, kind in df.dtypes])


def _landed_polls(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "landed-polls")
    fixtures.poll_lines(spark, sf_dir).write.text(path)
    return path


def _landed_utterances(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "landed-utterances")
    sources.write_utterances(fixtures.utterances(spark, sf_dir), path)
    return path


_FLIGHT_COLUMNS = ", ".join(
    "CAST(sensors AS VARCHAR) AS sensors" if c == "sensors" else c for c in FLIGHT.names
)
_POSITIONED = "latitude IS NOT NULL AND longitude IS NOT NULL"
_ALL_FLIGHTS = f"SELECT {_FLIGHT_COLUMNS} FROM flights"
_VALID_FLIGHTS = f"{_ALL_FLIGHTS} WHERE {_POSITIONED}"
_EUROPE = "latitude BETWEEN 35 AND 72 AND longitude BETWEEN -25 AND 45"
_PUBLIC_CALLSIGN = "CASE WHEN callsign = '' THEN NULL ELSE trim(callsign) END"
_PUBLIC_COLUMNS = ", ".join(
    f"{_PUBLIC_CALLSIGN} AS callsign" if c == "callsign" else c for c in FLIGHT_API.names
)
_LINE = f"time_ingest, event_id // {fixtures.POLL_STATES}"


# --- decoding ---------------------------------------------------------------------------


@query("flight_states_parse", _ALL_FLIGHTS)
def _(spark, sf_dir):
    return polls.to_flight_rows(polls.decode_polls(fixtures.poll_lines(spark, sf_dir)))


@query("flight_states_valid", _VALID_FLIGHTS)
def _(spark, sf_dir):
    return polls.flights_from_polls(fixtures.poll_lines(spark, sf_dir))


@query(
    "flight_states_safe_cast",
    """
    SELECT squawk, last_contact,
      CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 12.5 WHEN 2 THEN NULL ELSE velocity END AS velocity,
      CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN NULL WHEN 2 THEN 37 ELSE category END AS category,
      CASE event_id % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false
                        WHEN 4 THEN NULL ELSE on_ground END AS on_ground
    FROM flight_events
    """,
)
def _(spark, sf_dir):
    def instead(column: str, *texts: str | None) -> F.Column:
        """Rows take turns in the given JSON texts; ``None`` keeps the true value."""
        plain = F.coalesce(F.col(column).cast("string"), F.lit("null"))
        turn = F.col("event_id") % len(texts)
        picked = plain
        for i, text in enumerate(texts):
            picked = F.when(turn == i, plain if text is None else F.lit(text)).otherwise(picked)
        return picked

    spoiled = {
        "velocity": instead("velocity", '"bad"', '"12.5"', "null", None, None),
        "category": instead("category", "3.7", '"3.7"', '"37"', None),
        "on_ground": instead("on_ground", "0", "2", '"false"', '""', "null", None),
    }
    states = polls.decode_polls(fixtures.poll_lines(spark, sf_dir, spoiled))
    return polls.to_flight_rows(states).select("squawk", "last_contact", "velocity", "category", "on_ground")


@query(
    "polls_rejected",
    f"""
    SELECT CAST(epoch(time_ingest) AS BIGINT) AS time, count(DISTINCT event_id // {fixtures.POLL_STATES}) AS lines
    FROM flight_events WHERE CAST(epoch(time_ingest) AS BIGINT) // 3600 % 4 IN (0, 1) GROUP BY 1
    """,
)
def _(spark, sf_dir):
    lines = fixtures.poll_lines(spark, sf_dir)
    first_number = F.regexp_extract("value", r":(\d+),", 1).cast("long")
    hour = F.floor(first_number / 3600) % 4
    damaged = (
        F.when(hour == 0, F.expr("left(value, length(value) - 1)"))  # cut short
        .when(hour == 1, F.regexp_replace("value", '"time"', '"tick"'))  # without its time
        .when(hour == 2, F.concat(F.lit('{"time":'), first_number.cast("string"), F.lit(',"states":null}')))
        .otherwise(F.col("value"))
    )
    rejected = polls.rejected_polls(lines.select(damaged.alias("value")))
    return rejected.groupBy(first_number.alias("time")).agg(F.count("*").alias("lines"))


@query(
    "poll_envelope",
    f"""
    SELECT time_ingest, count(*) FILTER ({_POSITIONED}) AS count,
      concat('{{"timestamp":"', strftime(time_ingest, '%Y-%m-%dT%H:%M:%S+00:00'),
        '","count":', count(*) FILTER ({_POSITIONED}), ',"flights":[',
        coalesce(string_agg(CAST(json_object(
          'time_ingest', strftime(time_ingest, '%Y-%m-%d %H:%M:%S+00:00'),
          'icao24', icao24,
          'callsign', {_PUBLIC_CALLSIGN},
          'origin_country', origin_country,
          'time_position', strftime(time_position, '%Y-%m-%d %H:%M:%S+00:00'),
          'last_contact', strftime(last_contact, '%Y-%m-%d %H:%M:%S+00:00'),
          'longitude', longitude, 'latitude', latitude, 'geo_altitude', geo_altitude,
          'on_ground', on_ground, 'velocity', velocity, 'true_track', true_track,
          'vertical_rate', vertical_rate) AS VARCHAR), ',' ORDER BY event_id) FILTER ({_POSITIONED}), ''),
        ']}}') AS envelope
    FROM flight_events GROUP BY {_LINE}
    """,
)
def _(spark, sf_dir):
    return polls.poll_envelopes(fixtures.poll_lines(spark, sf_dir))


@query(
    "poll_labels",
    f"""
    SELECT time_ingest, count(place) AS count,
      coalesce(string_agg(label, ', ' ORDER BY place) FILTER (place <= 3), '') AS labels
    FROM (
      SELECT *, coalesce(nullif({_PUBLIC_CALLSIGN}, ''), icao24) || ' (' || origin_country || ')' AS label,
        CASE WHEN {_POSITIONED}
             THEN row_number() OVER (PARTITION BY {_LINE}, ({_POSITIONED}) ORDER BY event_id) END AS place
      FROM flight_events)
    GROUP BY {_LINE}
    """,
)
def _(spark, sf_dir):
    return polls.poll_labels(fixtures.poll_lines(spark, sf_dir))


@query("flight_format_scan", f"{_ALL_FLIGHTS} WHERE {_EUROPE}")
def _(spark, sf_dir):
    sources.register(spark)
    return sources.flights_in(spark.read.format("landed_lines").load(_landed_polls(spark, sf_dir)), "europe")


# --- flights ----------------------------------------------------------------------------


@query("flights_api_view", f"SELECT {_PUBLIC_COLUMNS} FROM flights")
def _(spark, sf_dir):
    return flights.api_view(fixtures.flights(spark, sf_dir))


@query("flights_in_region", f"{_ALL_FLIGHTS} WHERE {_EUROPE}")
def _(spark, sf_dir):
    return flights.in_region(fixtures.flights(spark, sf_dir), "EUROPE")


@query(
    "flights_region_counts",
    """
    SELECT region, count(*) AS num_events, count(DISTINCT icao24) AS unique_aircraft
    FROM flights JOIN (VALUES
      ('EUROPE', 35, 72, -25, 45), ('NORTH_AMERICA', 7, 72, -168, -60), ('SOUTH_AMERICA', -56, 15, -90, -30),
      ('ASIA', -10, 82, 45, 180), ('AUSTRALIA', -50, -10, 110, 180), ('AFRICA', -35, 37, -20, 52),
      ('GLOBAL', -90, 90, -180, 180)) AS boxes (region, lamin, lamax, lomin, lomax)
    ON latitude BETWEEN lamin AND lamax AND longitude BETWEEN lomin AND lomax
    GROUP BY region
    """,
)
def _(spark, sf_dir):
    return flights.region_counts(fixtures.flights(spark, sf_dir))


_CUSTOMER_BOXES = """
    SELECT c_custkey AS region, c_custkey * 37 % 170 - 88 AS lamin,
      c_custkey * 37 % 170 - 88 + c_nationkey * c_nationkey / CAST(5 AS DOUBLE) AS lamax,
      c_custkey * 53 % 350 - 178 AS lomin, c_custkey * 53 % 350 - 178 + (c_custkey % 41) / CAST(2 AS DOUBLE) AS lomax
    FROM {}
    """


@query(
    "flights_area_counts",
    f"""
    SELECT region, count(*) AS num_events, count(DISTINCT icao24) AS unique_aircraft
    FROM flights JOIN ({_CUSTOMER_BOXES.format("customer")}) AS boxes
    ON latitude BETWEEN lamin AND lamax AND longitude BETWEEN lomin AND lomax
    GROUP BY region
    """,
)
def _(spark, sf_dir):
    """A box for each customer: 15,000 at the largest test size, from half a degree to the whole height."""
    customers = fixtures.table(spark, sf_dir, "customer")
    boxes = spark.sql(_CUSTOMER_BOXES.format("{customers}"), customers=customers)
    return areas.area_counts(fixtures.flights(spark, sf_dir), boxes)


@query(
    "flights_snapshot",
    f"""
    SELECT {_PUBLIC_COLUMNS} FROM (
      SELECT * FROM flights WHERE {_EUROPE}
      ORDER BY icao24, last_contact, time_ingest, longitude, latitude, squawk LIMIT 100)
    """,
)
def _(spark, sf_dir):
    return flights.snapshot(fixtures.flights(spark, sf_dir), "EUROPE", 100)


def _newest(key: str) -> str:
    columns = ("last_contact", "time_ingest", "longitude", "latitude", "squawk")
    order = ", ".join(f"{c} DESC NULLS LAST" for c in columns)
    return f"row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


@query(
    "flights_latest_position",
    f"""
    SELECT icao24, last_contact, longitude, latitude, geo_altitude FROM flights
    WHERE {_POSITIONED} QUALIFY {_newest("icao24")}
    """,
)
def _(spark, sf_dir):
    return flights.latest_position(fixtures.flights(spark, sf_dir))


@query(
    "flights_latest_by_callsign",
    f"""
    SELECT trim(callsign) AS callsign, icao24, last_contact, longitude, latitude FROM flights
    WHERE {_POSITIONED} AND trim(callsign) <> '' QUALIFY {_newest("trim(callsign)")}
    """,
)
def _(spark, sf_dir):
    return flights.latest_by_callsign(fixtures.flights(spark, sf_dir))


@query(
    "flights_running_totals",
    """
    SELECT time_ingest, row_number() OVER (ORDER BY time_ingest) AS update_number, n AS flights,
      CAST(sum(n) OVER (ORDER BY time_ingest) AS BIGINT) AS total_flights
    FROM (SELECT time_ingest, count(*) AS n FROM flights GROUP BY time_ingest)
    """,
)
def _(spark, sf_dir):
    return flights.running_totals(fixtures.flights(spark, sf_dir))


_FLIGHT_STATS = """
    SELECT count(*) AS num_events, count(DISTINCT icao24) AS unique_aircraft,
      max(vertical_rate) AS max_asc_rate, min(vertical_rate) AS max_desc_rate,
      max(velocity) AS max_speed, max(geo_altitude) AS max_altitude,
      date_sub('second', min(time_ingest), max(time_ingest)) AS observation_duration
    FROM flights
    """


@query("flight_stats", _FLIGHT_STATS)
def _(spark, sf_dir):
    return VIEWS["flight_stats"].live(fixtures.flights(spark, sf_dir))


# --- questions about flights --------------------------------------------------------------


@query(
    "flights_speed_histogram",
    """
    SELECT CAST(floor(velocity / 50) AS BIGINT) AS bucket, floor(velocity / 50) * 50 AS speed_from,
      (floor(velocity / 50) + 1) * 50 AS speed_to, count(*) AS num_events
    FROM flights WHERE velocity IS NOT NULL GROUP BY 1, 2, 3
    """,
)
def _(spark, sf_dir):
    return explore.speed_histogram(fixtures.flights(spark, sf_dir), 50.0)


@query(
    "flights_altitude_velocity",
    "SELECT geo_altitude, velocity FROM flights WHERE geo_altitude IS NOT NULL AND velocity IS NOT NULL",
)
def _(spark, sf_dir):
    return explore.altitude_velocity(fixtures.flights(spark, sf_dir))


@query(
    "unique_flights",
    """
    SELECT count(DISTINCT callsign) AS unique_callsigns, count(DISTINCT icao24) AS unique_aircraft FROM flights
    """,
)
def _(spark, sf_dir):
    return explore.unique_flights(fixtures.flights(spark, sf_dir))


@query(
    "unique_aircraft_bitmap",
    """
    SELECT CAST(time_ingest AS DATE) AS day, count(DISTINCT icao24) AS unique_aircraft FROM flights GROUP BY 1
    UNION ALL SELECT NULL, count(DISTINCT icao24) FROM flights
    """,
)
def _(spark, sf_dir):
    """Aircraft per hour as bitmaps; those of the hours make the days, those of the days the whole."""
    hourly = bitmaps.aircraft_parts(fixtures.flights(spark, sf_dir), "time_ingest")
    days = bitmaps.merge_parts(hourly.withColumn("day", F.to_date("time_ingest")), "day")
    days = store(days, "aircraft-by-day")
    whole = bitmaps.count_aircraft(days).withColumn("day", F.lit(None).cast("date"))
    return bitmaps.count_aircraft(days, "day").unionByName(whole)


@query(
    "flights_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values,
        CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM flights"""
        for c in FLIGHT.names
    ),
)
def _(spark, sf_dir):
    return explore.profile(fixtures.flights(spark, sf_dir))


@query(
    "dataset_status",
    """
    SELECT 'flights' AS name, count(*) > 0 AS available, count(*) AS records_available FROM flights
    UNION ALL SELECT 'transcript', count(*) > 0, count(*) FROM utterances
    """,
)
def _(spark, sf_dir):
    return stats.dataset_status(
        flights=fixtures.flights(spark, sf_dir), transcript=fixtures.utterances(spark, sf_dir)
    )


# --- quality ------------------------------------------------------------------------------

_BREACHES = f"""
    SELECT 'icao24_not_null' AS rule, {{0}} count(*) AS rows, count(*) FILTER (icao24 IS NULL) AS failed FROM flights
    UNION ALL
    SELECT 'coord_exist', {{1}} count(*), count(*) FILTER (NOT ({_POSITIONED})) FROM flights
    """
_FLIGHT_RULES = (quality.ICAO24_PRESENT, quality.COORDINATES_PRESENT)


@query("flights_expect_report", _BREACHES.format("'warn' AS action,", "'drop',"))
def _(spark, sf_dir):
    return quality.report(fixtures.flights(spark, sf_dir), *_FLIGHT_RULES)


@query("flights_expect_drop", _VALID_FLIGHTS)
def _(spark, sf_dir):
    return quality.enforce(fixtures.flights(spark, sf_dir), *_FLIGHT_RULES)


@query("flights_expect_stream", _BREACHES.format("", ""))
def _(spark, sf_dir):
    lines = sources.read_line_stream(spark, _landed_polls(spark, sf_dir))
    rows = polls.to_flight_rows(polls.decode_polls(lines))
    run = streaming.append_stream(
        quality.enforce(quality.observe(rows, streaming.QUALITY_METRICS, *_FLIGHT_RULES), *_FLIGHT_RULES),
        scratch_path(spark, "checkpoint"),
        path=scratch_path(spark, "flights"),
    )
    return streaming.observed_breaches(spark, streaming.finish(run))


@query(
    "confidence_range_check",
    """
    SELECT conversation_id, utterance_id, confidence + CAST(0.05 AS DOUBLE) AS confidence,
      '[confidence_range]' AS breached
    FROM utterances WHERE confidence + CAST(0.05 AS DOUBLE) > 1
    """,
)
def _(spark, sf_dir):
    rows = fixtures.utterances(spark, sf_dir).select(
        "conversation_id", "utterance_id", (F.col("confidence") + 0.05).alias("confidence")
    )
    return quality.quarantine(rows, quality.CONFIDENCE_IN_RANGE)


# --- utterances ---------------------------------------------------------------------------

_UTTERANCES = "SELECT * FROM utterances"


@query(
    "utterances_normalize",
    """
    SELECT timestamp,
      CASE WHEN utterance_id % 7 = 1 THEN 'unknown' ELSE conversation_id END AS conversation_id,
      CASE WHEN utterance_id % 7 = 2 THEN 0 ELSE utterance_id END AS utterance_id,
      CASE WHEN utterance_id % 7 = 3 THEN 'unknown' ELSE speaker END AS speaker,
      CASE WHEN utterance_id % 7 = 4 THEN '' ELSE text END AS text,
      CASE WHEN utterance_id % 7 = 5 THEN 1.0 ELSE confidence END AS confidence,
      CASE WHEN utterance_id % 7 = 6 THEN 0.0 ELSE start_time END AS start_time,
      CASE WHEN utterance_id % 7 = 0 THEN 0.0 ELSE end_time END AS end_time,
      CASE WHEN utterance_id % 5 = 1 THEN NULL ELSE domain END AS domain,
      CASE WHEN utterance_id % 5 = 2 THEN NULL ELSE topic END AS topic,
      CASE WHEN utterance_id % 5 = 3 THEN NULL ELSE accent END AS accent
    FROM utterances
    """,
)
def _(spark, sf_dir):
    rows = fixtures.utterances(spark, sf_dir)
    missing = dict(
        conversation_id=(7, 1), utterance_id=(7, 2), speaker=(7, 3), text=(7, 4), confidence=(7, 5),
        start_time=(7, 6), end_time=(7, 0), domain=(5, 1), topic=(5, 2), accent=(5, 3),
    )
    said = {c: F.when(F.col("utterance_id") % m != r, F.col(c)) for c, (m, r) in missing.items()}
    zone = F.when(F.col("utterance_id") % 2 == 0, "Z").otherwise("+00:00")
    said["timestamp"] = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    line = F.to_json(F.struct(*[c.alias(name) for name, c in said.items()]))  # null keys are left out
    return utterances.normalize(utterances.parse_utterances(rows.select(line.alias("value"))))


@query(
    "utterance_timing",
    "SELECT conversation_id, utterance_id, end_time - start_time AS duration, start_time, end_time FROM utterances",
)
def _(spark, sf_dir):
    return utterances.utterance_timing(fixtures.conversation_turns(spark, sf_dir)).select(
        "conversation_id", "utterance_id", "duration", "start_time", "end_time"
    )


@query("utterances_jsonl_roundtrip", _UTTERANCES)
def _(spark, sf_dir):
    return sources.read_utterances(spark, _landed_utterances(spark, sf_dir))


@query("utterance_format_scan", _UTTERANCES)
def _(spark, sf_dir):
    sources.register(spark)
    return sources.utterances_in(spark.read.format("landed_lines").load(_landed_utterances(spark, sf_dir)))


@query("conversation_lookup", f"{_UTTERANCES} WHERE conversation_id = 'conv_000002' ORDER BY utterance_id")
def _(spark, sf_dir):
    return utterances.conversation(fixtures.utterances(spark, sf_dir), "conv_000002")


@query(
    "utterance_feed",
    """
    SELECT conversation_id, utterance_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS at,
      upper(speaker) AS speaker, substring(text, 1, 50) AS preview
    FROM utterances
    """,
)
def _(spark, sf_dir):
    return utterances.feed(fixtures.utterances(spark, sf_dir))


@query(
    "recent_utterances",
    f"{_UTTERANCES} ORDER BY timestamp DESC, conversation_id DESC, utterance_id DESC LIMIT 20",
)
def _(spark, sf_dir):
    return utterances.recent(fixtures.utterances(spark, sf_dir), 20)


# --- pages --------------------------------------------------------------------------------

_NUMBERED = """
    SELECT row_number() OVER (ORDER BY timestamp, conversation_id, utterance_id) AS position, * FROM utterances
    """


@query("utterances_page", f"SELECT * FROM ({_NUMBERED}) WHERE position BETWEEN 41 AND 140")
def _(spark, sf_dir):
    rows = fixtures.utterances(spark, sf_dir)
    return sequence.page(rows, utterances.UTTERANCE_ORDER, start=40, limit=100)


@query("utterances_page_numbered", f"SELECT * FROM ({_NUMBERED}) WHERE position BETWEEN 41 AND 1040")
def _(spark, sf_dir):
    rows = fixtures.utterances(spark, sf_dir)
    index = paging.PageIndex(scratch_path(spark, "pages"), rows.schema, tuple(utterances.UTTERANCE_ORDER))
    half = F.pmod(F.xxhash64("conversation_id", "utterance_id"), F.lit(2)) == 0
    index.append(rows.where(half))
    index.append(rows.where(~half))
    return index.page(spark, start=40, limit=1000)


@query(
    "utterances_page_after",
    f"""
    {_UTTERANCES} WHERE (timestamp, conversation_id, utterance_id) > (TIMESTAMP '2024-01-01 00:20:00', 'conv_000002', 0)
    ORDER BY timestamp, conversation_id, utterance_id LIMIT 100
    """,
)
def _(spark, sf_dir):
    rows = fixtures.utterances(spark, sf_dir)
    cursor = (F.lit("2024-01-01 00:20:00").cast("timestamp"), "conv_000002", 0)
    return sequence.page_after(rows, utterances.UTTERANCE_ORDER, cursor, 100).drop("cursor")


@query(
    "utterances_rejected",
    """
    SELECT conversation_id, count(*) AS lines FROM utterances WHERE utterance_id % 3 IN (0, 1) GROUP BY conversation_id
    """,
)
def _(spark, sf_dir):
    said = fixtures.utterances(spark, sf_dir)
    line, turn = F.to_json(F.struct(*said.columns)), F.col("utterance_id") % 3
    damaged = (
        F.when(turn == 0, F.expr("left(line, length(line) - 1)"))  # cut short
        .when(turn == 1, F.regexp_replace("line", r'"utterance_id":(\d+)', '"utterance_id":"$1"'))  # a text, no number
        .otherwise(F.col("line"))
    )
    rejected = utterances.rejected_utterances(said.withColumn("line", line).select(damaged.alias("value")))
    call = F.regexp_extract("value", '"conversation_id":"([^"]*)"', 1).alias("conversation_id")
    return rejected.groupBy(call).agg(F.count("*").alias("lines"))


# --- transcript statistics ----------------------------------------------------------------


@query(
    "transcript_by_speaker",
    """
    SELECT speaker, domain, count(*) AS count FROM utterances GROUP BY speaker, domain ORDER BY domain, speaker
    """,
)
def _(spark, sf_dir):
    return VIEWS["transcript_by_speaker"].live(fixtures.utterances(spark, sf_dir))


def _conversation_stats(view: str) -> str:
    return f"""
    SELECT conversation_id, domain, topic, accent, count(*) AS total_utterances,
      count(*) FILTER (speaker = 'agent') AS agent_utterances,
      count(*) FILTER (speaker = 'customer') AS customer_utterances,
      round(avg(confidence), 6) AS avg_confidence, max(end_time) AS conversation_duration,
      min(timestamp) AS conversation_start, max(timestamp) AS conversation_end
    FROM {view} GROUP BY conversation_id, domain, topic, accent ORDER BY conversation_start DESC
    """


def _rounded(rows: DataFrame, column: str) -> DataFrame:
    """Sums of floats depend on their order in the last digits."""
    return rows.withColumn(column, F.round(column, 6))


@query("conversation_stats", _conversation_stats("utterances"))
def _(spark, sf_dir):
    rows = VIEWS["conversation_stats"].live(fixtures.utterances(spark, sf_dir))
    return _rounded(rows, "avg_confidence")


@query("conversation_stats_mixed", _conversation_stats("utterances_mixed"))
def _(spark, sf_dir):
    rows = VIEWS["conversation_stats"].live(fixtures.utterances_mixed(spark, sf_dir))
    return _rounded(rows, "avg_confidence")


@query("speaker_distribution", "SELECT speaker, count(*) AS count FROM utterances GROUP BY speaker")
def _(spark, sf_dir):
    return stats.distribution(fixtures.utterances(spark, sf_dir), "speaker")


@query("domain_distribution", "SELECT domain, count(*) AS count FROM utterances GROUP BY domain")
def _(spark, sf_dir):
    return stats.distribution(fixtures.utterances(spark, sf_dir), "domain")


@query(
    "conversation_load_estimate",
    """
    SELECT total_utterances, conversations, round(mean, 6) AS avg_utterances,
      CAST(floor(500000 * mean / 86400) AS BIGINT) AS utterances_per_second,
      CAST(floor(500000 * mean) AS BIGINT) AS utterances_per_day
    FROM (SELECT count(*) AS total_utterances, count(DISTINCT conversation_id) AS conversations,
                 CAST(count(*) AS DOUBLE) / count(DISTINCT conversation_id) AS mean FROM utterances)
    """,
)
def _(spark, sf_dir):
    return _rounded(stats.load_estimate(fixtures.utterances(spark, sf_dir)), "avg_utterances")


@query(
    "feed_counters",
    """
    SELECT count(*) AS total, count(*) FILTER (speaker = 'agent') AS agent,
      count(*) FILTER (speaker <> 'agent') AS customer FROM utterances
    """,
)
def _(spark, sf_dir):
    return stats.feed_counters(fixtures.utterances(spark, sf_dir))


# --- replay in chunks -----------------------------------------------------------------------


def _chunks(size: int, total: int | None = None) -> str:
    numbered = _NUMBERED if total is None else f"SELECT * FROM ({_NUMBERED}) WHERE position <= {total}"
    return f"""(
      SELECT chunk_number, chunk_size, total_sent, round(total_sent / everything * 100, 2) AS percent,
        round(elapsed, 2) AS elapsed_seconds,
        round(rate, 2) AS throughput, round(rate, 0) || ' utterances/second' AS throughput_description
      FROM (
       SELECT *, coalesce(total_sent / nullif(elapsed, 0), 0) AS rate FROM (
        SELECT chunk_number, n AS chunk_size, CAST(sum(n) OVER (ORDER BY chunk_number) AS BIGINT) AS total_sent,
          CAST(sum(n) OVER () AS DOUBLE) AS everything,
          epoch(ends) - epoch(min(begins) OVER ()) AS elapsed
        FROM (
          SELECT CAST((position - 1) // {size} + 1 AS BIGINT) AS chunk_number, count(*) AS n,
            min(timestamp) AS begins, max(timestamp) AS ends
          FROM ({numbered}) GROUP BY 1))))"""


@query("chunk_progress", f"SELECT chunk_number, chunk_size, total_sent, percent FROM {_chunks(20)}")
def _(spark, sf_dir):
    chunks = progress.chunk_progress(fixtures.utterances(spark, sf_dir), 20)
    return chunks.select("chunk_number", "chunk_size", "total_sent", "percent")


@query(
    "chunk_throughput",
    f"SELECT chunk_number, total_sent, elapsed_seconds, throughput, throughput_description FROM {_chunks(20)}",
)
def _(spark, sf_dir):
    chunks = progress.chunk_progress(fixtures.utterances(spark, sf_dir), 20)
    return chunks.select("chunk_number", "total_sent", "elapsed_seconds", "throughput", "throughput_description")


@query("chunk_sampled", f"SELECT * FROM {_chunks(20)} WHERE chunk_number % 10 = 0 OR chunk_number <= 5")
def _(spark, sf_dir):
    return progress.sample_chunks(progress.chunk_progress(fixtures.utterances(spark, sf_dir), 20))


def _utterance_json(row: str) -> str:
    columns = (
        "conversation_id utterance_id speaker text confidence start_time end_time domain topic accent"
    ).split()
    fields = ", ".join(f"'{c}', {row}{c}" for c in columns)
    return f"json_object('timestamp', strftime({row}timestamp, '%Y-%m-%dT%H:%M:%S+00:00'), {fields})"


def _chunk_json(size: int, total: int | None = None) -> str:
    """Chunks with their JSON text, put together key by key."""
    numbered = _NUMBERED if total is None else f"SELECT * FROM ({_NUMBERED}) WHERE position <= {total}"
    progress = f""", ',"progress":', CAST(json_object('sent', total_sent, 'total', {total},
        'percent', round(total_sent / CAST({total} AS DOUBLE) * 100, 2)) AS VARCHAR)"""
    return f"""
    SELECT chunk_number, chunk_size, total_sent,
      concat('{{"timestamp":"', said_at, '","chunk_number":', chunk_number, ',"chunk_size":', chunk_size,
        ',"utterances":[', said, '],"stats":',
        CAST(json_object('total_sent', total_sent, 'elapsed_seconds', elapsed_seconds, 'throughput', throughput,
          'throughput_description', throughput_description) AS VARCHAR){progress if total else ""}, '}}') AS envelope
    FROM {_chunks(size, total)} JOIN (
      SELECT CAST((position - 1) // {size} + 1 AS BIGINT) AS chunk_number,
        strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S+00:00') AS said_at,
        string_agg(CAST({_utterance_json("")} AS VARCHAR), ',' ORDER BY position) AS said
      FROM ({numbered}) GROUP BY 1) USING (chunk_number)"""


@query("chunk_envelope", _chunk_json(100))
def _(spark, sf_dir):
    return progress.chunk_envelopes(fixtures.utterances(spark, sf_dir), 100)


@query("chunk_envelope_bounded", _chunk_json(30, 100))
def _(spark, sf_dir):
    return progress.chunk_envelopes(fixtures.utterances(spark, sf_dir), 30, 100)


@query(
    "utterance_progress",
    f"""
    SELECT conversation_id, utterance_id, position || '/50' AS progress,
      CAST(json_object('timestamp', strftime(timestamp, '%Y-%m-%dT%H:%M:%S+00:00'),
        'utterance', {_utterance_json("")}, 'progress', position || '/50') AS VARCHAR) AS envelope
    FROM ({_NUMBERED}) WHERE position <= 50
    """,
)
def _(spark, sf_dir):
    return progress.utterance_progress(fixtures.utterances(spark, sf_dir), 50)


# --- streams ------------------------------------------------------------------------------


@query("flight_stream_ingest", _VALID_FLIGHTS)
def _(spark, sf_dir):
    table = scratch_path(spark, "flights")
    run = streaming.ingest_flights(
        spark, _landed_polls(spark, sf_dir), scratch_path(spark, "checkpoint"), path=table
    )
    streaming.finish(run)
    return spark.read.parquet(table)


@query("transcript_stream_ingest", _UTTERANCES)
def _(spark, sf_dir):
    table = scratch_path(spark, "transcripts")
    run = streaming.ingest_transcripts(
        spark, _landed_utterances(spark, sf_dir), scratch_path(spark, "checkpoint"), path=table
    )
    streaming.finish(run)
    return spark.read.parquet(table)


@query("transcript_stream_packed", _UTTERANCES)
def _(spark, sf_dir):
    """Half of the utterances land, are taken in and packed; then the stream goes on with the others."""
    landing, state = scratch_path(spark, "landing"), scratch_path(spark, "checkpoint")
    lines = store(spark.read.text(_landed_utterances(spark, sf_dir)), "utterance-lines")
    packed = streaming.PackedTable("packed_calls", f"said_{uuid.uuid4().hex[:12]}", UTTERANCE)
    for half in range(2):
        lines.where(F.pmod(F.xxhash64("value"), F.lit(2)) == half).write.mode("append").text(landing)
        rows = sources.read_utterance_stream(spark, landing)
        streaming.finish(packed.append(rows, state))
        if half == 0:
            packed.pack(spark)
    return packed.rows(spark)


@query(
    "transcript_stream_take",
    "SELECT least(count(*) * 2 // 3, 1000000) AS rows, least(count(*) * 2 // 3, 1000000) AS known FROM utterances",
)
def _(spark, sf_dir):
    """Two thirds of the utterances, in two runs: the first ends after a third of the files."""
    landing, path, state = _landed_utterances(spark, sf_dir), *(scratch_path(spark, x) for x in ("taken", "checkpoint"))
    said = sources.read_utterances(spark, landing)
    most = min(said.count() * 2 // 3, 1_000_000)
    third = math.ceil(len(spark.read.text(landing).inputFiles()) / 3)
    for _ in range(2):
        rows = sources.read_utterance_stream(spark, landing, max_files_per_trigger=third)
        streaming.finish(streaming.take_stream(rows, most, utterances.UTTERANCE_ORDER, state, path))
    kept = spark.read.parquet(path)
    known = kept.select(utterances.UTTERANCE_ORDER).distinct().join(said, utterances.UTTERANCE_ORDER, "left_semi")
    return known.agg(F.count("*").alias("known")).select(F.lit(kept.count()).cast("long").alias("rows"), "known")


@query("flight_format_stream", _VALID_FLIGHTS)
def _(spark, sf_dir):
    sources.register(spark)
    # Half of the files land in a first run; the others follow under names that sort before them.
    landing, table, state = (scratch_path(spark, x) for x in ("landing", "flights", "checkpoint"))
    lines = store(fixtures.poll_lines(spark, sf_dir), "poll-lines")
    reader = spark.readStream.format("landed_lines").option("settle_seconds", 0)
    for late, folder in enumerate(("z", "a")):
        lines.where(F.pmod(F.xxhash64("value"), F.lit(2)) == late).write.text(f"{landing}/{folder}")
        rows = sources.flights_in(reader.load(landing), None)
        streaming.finish(streaming.append_stream(rows, state, path=table))
    return spark.read.parquet(table)


@query("flight_stats_incremental", f"{_FLIGHT_STATS} WHERE {_POSITIONED}")
def _(spark, sf_dir):
    landing = _landed_polls(spark, sf_dir)
    quarter = math.ceil(len(spark.read.text(landing).inputFiles()) / 4)
    lines = sources.read_line_stream(spark, landing, max_files_per_trigger=quarter)
    kept = streaming.incremental_flight_stats(scratch_path(spark, "flight-stats"), buckets=8)
    streaming.finish(kept.start(polls.flights_from_polls(lines), scratch_path(spark, "checkpoint")))
    return kept.current(spark)


def _kept_transcript_view(spark: SparkSession, sf_dir: str, incremental) -> DataFrame:
    landing = _landed_utterances(spark, sf_dir)
    quarter = math.ceil(len(spark.read.text(landing).inputFiles()) / 4)
    rows = sources.read_utterance_stream(spark, landing, max_files_per_trigger=quarter)
    kept = incremental(scratch_path(spark, "transcript-view"), buckets=8)
    streaming.finish(kept.start(rows, scratch_path(spark, "checkpoint")))
    return kept.current(spark)


@query("transcript_by_speaker_incremental", _SQL["transcript_by_speaker"])
def _(spark, sf_dir):
    rows = _kept_transcript_view(spark, sf_dir, streaming.incremental_transcript_by_speaker)
    return VIEWS["transcript_by_speaker"].sort(rows)


@query("conversation_stats_incremental", _conversation_stats("utterances"))
def _(spark, sf_dir):
    rows = _kept_transcript_view(spark, sf_dir, streaming.incremental_conversation_stats)
    return _rounded(VIEWS["conversation_stats"].sort(rows), "avg_confidence")


@query(
    "stream_summary",
    f"""
    SELECT 'complete' AS status, count(DISTINCT ({_LINE})) AS total, true AS timed, true AS rated FROM flight_events
    """,
)
def _(spark, sf_dir):
    run = streaming.ingest_flights(
        spark,
        _landed_polls(spark, sf_dir),
        scratch_path(spark, "checkpoint"),
        path=scratch_path(spark, "flights"),
    )
    summary = streaming.stream_summary(spark, streaming.finish(run))
    return summary.select(
        "status", "total", (F.col("elapsed_seconds") > 0).alias("timed"), (F.col("throughput") > 0).alias("rated")
    )


@query(
    "transcript_stream_summary",
    """
    SELECT 'complete' AS status, count(*) AS total, true AS timed, true AS rated, 'utterances/second' AS unit FROM utterances
    """,
)
def _(spark, sf_dir):
    run = streaming.ingest_transcripts(
        spark,
        _landed_utterances(spark, sf_dir),
        scratch_path(spark, "checkpoint"),
        path=scratch_path(spark, "transcripts"),
    )
    summary = streaming.stream_summary(spark, streaming.finish(run), "utterances")
    return summary.select(
        "status",
        "total",
        (F.col("elapsed_seconds") > 0).alias("timed"),
        (F.col("throughput") > 0).alias("rated"),
        F.element_at(F.split("throughput_description", " "), -1).alias("unit"),
    )
