"""Views with the library's schemas over the generated test tables.

The SQL of the plain views is one template for both Spark and DuckDB; ``spark_sql`` and
``duckdb_sql`` fill in the few spots where the dialects differ. In Spark the poll lines and
the utterances are built with DataFrame operators, because a window or a collected list per
hour or per conversation would not survive a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aerovox.functions import word_count
from aerovox.session import use_utc

# Largest number of states in one poll line.
POLL_STATES = 500

_SPARK = {
    "NTZ": "TIMESTAMP_NTZ",
    "HEX": "format_string('%06x', user_id + 3932160)",
    "ARR": "array(CAST(user_id % 5 AS INT), CAST(event_id % 3 AS INT))",
}
_DUCKDB = {
    "NTZ": "TIMESTAMP",
    "HEX": "format('{:06x}', user_id + 3932160)",
    "ARR": "[CAST(user_id % 5 AS INT), CAST(event_id % 3 AS INT)]",
}

_FLIGHTS = """
SELECT
  {KEEP}
  CAST(date_trunc('hour', ts) AS {NTZ}) AS time_ingest,
  {HEX} AS icao24,
  CASE WHEN event_id % 17 = 0 THEN NULL
       WHEN event_id % 19 = 0 THEN '        '
       ELSE rpad(concat('FL', CAST(user_id AS STRING)), 8, ' ') END AS callsign,
  n_name AS origin_country,
  CASE WHEN event_id % 23 = 0 THEN NULL
       ELSE CAST(date_trunc('second', ts) AS {NTZ}) END AS time_position,
  CAST(date_trunc('second', ts) AS {NTZ}) AS last_contact,
  CASE WHEN event_id % 29 = 0 THEN NULL
       ELSE ((event_id * 7919) % 36001 - 18000) / CAST(100 AS DOUBLE) END AS longitude,
  CASE WHEN event_id % 31 = 0 THEN NULL
       ELSE ((event_id * 104729) % 18001 - 9000) / CAST(100 AS DOUBLE) END AS latitude,
  CASE WHEN event_id % 13 = 0 THEN NULL
       ELSE CAST((event_id * 31) % 13000 AS DOUBLE) END AS geo_altitude,
  event_id % 11 = 0 AS on_ground,
  value AS velocity,
  ((event_id * 37) % 36000) / CAST(100 AS DOUBLE) AS true_track,
  ((event_id * 53) % 4001 - 2000) / CAST(100 AS DOUBLE) AS vertical_rate,
  CASE WHEN event_id % 7 = 0 THEN {ARR} END AS sensors,
  CASE WHEN event_id % 13 = 0 THEN NULL
       ELSE CAST((event_id * 31) % 13000 + 30 AS DOUBLE) END AS baro_altitude,
  lpad(CAST(event_id % 7777 AS STRING), 4, '0') AS squawk,
  event_id % 97 = 0 AS spi,
  CAST(event_id % 20 AS INT) AS category
FROM {EVENTS} LEFT JOIN {NATION} ON user_id % 25 = n_nationkey
"""

_UTTERANCES = """
SELECT
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 600 + CAST(floor(start_time) AS BIGINT)) AS timestamp,
  format('conv_{:06d}', conv_id) AS conversation_id,
  CAST(turn AS INT) AS utterance_id,
  CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent' ELSE 'unknown' END AS speaker,
  text,
  (9200 + (conv_id * 31 + turn * 17) % 801) / CAST(10000 AS DOUBLE) AS confidence,
  start_time,
  start_time + duration AS end_time,
  CASE {K} % 4 WHEN 0 THEN 'billing' WHEN 1 THEN 'technical_support'
               WHEN 2 THEN 'sales' ELSE 'customer_service' END AS domain,
  CASE {K} % 2 WHEN 0 THEN 'inbound' ELSE 'outbound' END AS topic,
  CASE {K} % 5 WHEN 0 THEN 'american' WHEN 1 THEN 'british' WHEN 2 THEN 'indian'
               WHEN 3 THEN 'filipino' ELSE 'australian' END AS accent
FROM (
  SELECT *, coalesce(sum(duration + CAST(0.5 AS DOUBLE)) OVER (
              PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)) AS start_time
  FROM (
    SELECT conv_id, turn, role, text,
           CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS DOUBLE) * CAST(0.5 AS DOUBLE) AS duration
    FROM conversations))
"""

_ONE_CALL = "conv_id"
_MIXED_CALL = "(conv_id + turn - turn % 4)"


def _fill(template: str, marks: dict[str, str]) -> str:
    for mark, text in marks.items():
        template = template.replace("{" + mark + "}", text)
    return template


def duckdb_views() -> str:
    """Common table expressions of all views, to put after ``WITH`` in an oracle query."""
    flights = _fill(_FLIGHTS, {**_DUCKDB, "KEEP": "event_id, ", "EVENTS": "events", "NATION": "nation"})
    views = {
        "flight_events": flights,
        "flights": "SELECT * EXCLUDE (event_id) FROM flight_events",
        "utterances": _fill(_UTTERANCES, {"K": _ONE_CALL}),
        "utterances_mixed": _fill(_UTTERANCES, {"K": _MIXED_CALL}),
    }
    return ",\n".join(f"{name} AS ({sql})" for name, sql in views.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _flight_events(events: DataFrame, nation: DataFrame, *keep: str) -> DataFrame:
    marks = {"KEEP": "".join(f"{c}, " for c in keep), "EVENTS": "{events}", "NATION": "{nation}"}
    return events.sparkSession.sql(_fill(_FLIGHTS, {**_SPARK, **marks}), events=events, nation=nation)


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flight_events(table(spark, sf_dir, "events"), table(spark, sf_dir, "nation"))


def poll_lines(spark: SparkSession, sf_dir: str, spoiled: dict[str, F.Column] | None = None) -> DataFrame:
    """Raw poll lines: one per hour and run of ``POLL_STATES`` event ids, so a busy hour splits.

    ``spoiled`` replaces the JSON text of some columns by an expression over ``event_id``.
    """

    def number(name: str) -> F.Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("null"))

    def text(name: str) -> F.Column:
        return F.coalesce(F.concat(F.lit('"'), F.col(name), F.lit('"')), F.lit("null"))

    def epoch(name: str) -> F.Column:
        return F.coalesce(F.unix_timestamp(name).cast("string"), F.lit("null"))

    fields = {
        "icao24": text("icao24"),
        "callsign": text("callsign"),
        "origin_country": text("origin_country"),
        "time_position": epoch("time_position"),
        "last_contact": epoch("last_contact"),
        **{c: number(c) for c in ("longitude", "latitude", "geo_altitude", "on_ground", "velocity")},
        **{c: number(c) for c in ("true_track", "vertical_rate")},
        "sensors": F.coalesce(F.to_json("sensors"), F.lit("null")),
        "baro_altitude": number("baro_altitude"),
        "squawk": text("squawk"),
        "spi": number("spi"),
        "category": number("category"),
        **(spoiled or {}),
    }
    state = F.concat_ws(",", *fields.values())
    # The events move to their lines while they are still four columns, not yet JSON text.
    events = (
        table(spark, sf_dir, "events")
        .withColumn("time", F.unix_timestamp(F.date_trunc("hour", "ts")))
        .withColumn("run", F.expr(f"event_id DIV {POLL_STATES}"))
        .repartition("time", "run")
    )
    return (
        _flight_events(events, table(spark, sf_dir, "nation"), "event_id", "time", "run")
        .select(
            "time",
            "run",
            F.struct("event_id", F.concat(F.lit("["), state, F.lit("]")).alias("json")).alias("state"),
        )
        .groupBy("time", "run")
        .agg(F.sort_array(F.collect_list("state")).alias("states"))
        .select(
            F.concat(
                F.lit('{"time":'),
                F.col("time").cast("string"),
                F.lit(',"states":['),
                F.array_join(F.col("states.json"), ","),
                F.lit("]}"),
            ).alias("value")
        )
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts: ``conversation_id``, ``utterance_id``, ``text`` and what the views need."""
    return table(spark, sf_dir, "conversations").select(
        F.format_string("conv_%06d", "conv_id").alias("conversation_id"),
        F.col("turn").cast("int").alias("utterance_id"),
        "text",
        "conv_id",
        "turn",
        "role",
    )


def _timed(turns: DataFrame) -> DataFrame:
    """Times within the call in one lazy plan: sums within and over blocks of 4,096 ids of a call."""
    words = word_count(F.col("text")) * F.lit(0.5)
    timed = turns.withColumns({"duration": words, "block": F.floor(F.col("utterance_id") / 4096)})
    step = F.col("duration") + F.lit(0.5)
    ids = Window.orderBy("utterance_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conversation_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = timed.groupBy("conversation_id", "block").agg(F.sum(step).alias("seconds"))
    blocks = blocks.select("conversation_id", "block", F.coalesce(F.sum("seconds").over(earlier), F.lit(0.0)).alias("offset"))
    start = F.coalesce(F.sum(step).over(ids.partitionBy("conversation_id", "block")), F.lit(0.0)) + F.col("offset")
    timed = timed.join(blocks, ["conversation_id", "block"]).withColumn("start_time", start)
    return timed.withColumn("end_time", F.col("start_time") + F.col("duration"))


def _utterances(spark: SparkSession, sf_dir: str, call: F.Column) -> DataFrame:
    timed = _timed(conversation_turns(spark, sf_dir))
    conv, turn = F.col("conv_id"), F.col("turn")

    def pick(width: int, *names: str) -> F.Column:
        return F.element_at(F.array(*map(F.lit, names)), (call % width + 1).cast("int"))

    seconds = F.lit(1704067200) + conv * 600 + F.floor("start_time")  # from 2024-01-01
    return timed.select(
        F.timestamp_seconds(seconds).alias("timestamp"),
        "conversation_id",
        "utterance_id",
        F.when(F.col("role") == "user", "customer")
        .when(F.col("role") == "assistant", "agent")
        .otherwise("unknown")
        .alias("speaker"),
        "text",
        ((9200 + (conv * 31 + turn * 17) % 801) / F.lit(10000.0)).alias("confidence"),
        "start_time",
        "end_time",
        pick(4, "billing", "technical_support", "sales", "customer_service").alias("domain"),
        pick(2, "inbound", "outbound").alias("topic"),
        pick(5, "american", "british", "indian", "filipino", "australian").alias("accent"),
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One domain, topic and accent per conversation."""
    return _utterances(spark, sf_dir, F.col("conv_id"))


def utterances_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, topic and accent change every four turns."""
    return _utterances(spark, sf_dir, F.col("conv_id") + F.col("turn") - F.col("turn") % 4)
