"""Operators on flight rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovox.functions import public_callsign
from aerovox.functions.text import BLANKS
from aerovox.limits import check_range
from aerovox.operators.sequence import totals_before
from aerovox.regions import REGIONS, region_box
from aerovox.schemas import FLIGHT_API
from aerovox.session import store


def api_epoch(moment: Column) -> Column:
    """The public view takes epoch 0 for a missing time."""
    return F.when(F.unix_seconds(moment.cast("timestamp")) != 0, moment)


def api_view(flights: DataFrame) -> DataFrame:
    """The public 13 columns: trimmed call signs, zero times as null."""
    shown = {
        "callsign": public_callsign(F.col("callsign")),
        "time_position": api_epoch(F.col("time_position")),
        "last_contact": api_epoch(F.col("last_contact")),
    }
    return flights.select(*[shown.get(c, F.col(c)).alias(c) for c in FLIGHT_API.names])


def _inside(name: str) -> Column:
    box = region_box(name)
    return F.col("latitude").between(box.lamin, box.lamax) & F.col("longitude").between(box.lomin, box.lomax)


def in_region(flights: DataFrame, region: str | None = None) -> DataFrame:
    """Positions inside the box of a region, limits included; raises on an unknown name."""
    return flights.where(_inside(region))


def tag_regions(flights: DataFrame) -> DataFrame:
    """One row per position and region that contains it. Boxes overlap.

    The seven boxes are literals of the plan, so tagging is a map and needs no join.
    """
    hits = F.array(*[F.when(_inside(name), F.lit(name)) for name in REGIONS])
    return flights.select("*", F.explode(hits).alias("region")).where(F.col("region").isNotNull())


def region_counts(flights: DataFrame) -> DataFrame:
    """Positions and aircraft per region."""
    return (
        tag_regions(flights.select("icao24", "latitude", "longitude"))
        .groupBy("region")
        .agg(F.count("*").alias("num_events"), F.countDistinct("icao24").alias("unique_aircraft"))
    )


# Newest first; the further columns only decide between equal times.
_NEWEST = ["last_contact", "time_ingest", "longitude", "latitude", "squawk"]


def snapshot(flights: DataFrame, region: str | None = None, limit: int = 100) -> DataFrame:
    """The first ``limit`` public flights of a region, in a fixed order."""
    check_range("limit", limit, 1, 1000)
    order = ["icao24", "last_contact", "time_ingest", "longitude", "latitude", "squawk"]
    return api_view(in_region(flights, region).orderBy(*order).limit(limit))


def latest_by(flights: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Newest positioned row per key, as a maximum of the whole row in order of newness.

    Each task keeps one row per key before the shuffle, so a hot key costs no more than any
    other.
    """
    row = F.struct(*_NEWEST, *[c for c in columns if c not in [*_NEWEST, key]])
    return (
        flights.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(row).alias("newest"))
        .select(*[F.col(key if c == key else f"newest.{c}").alias(c) for c in columns])
    )


def latest_position(flights: DataFrame) -> DataFrame:
    """Where each aircraft was last seen, with the altitude to colour it by."""
    return latest_by(flights, "icao24", ["icao24", "last_contact", "longitude", "latitude", "geo_altitude"])


def latest_by_callsign(flights: DataFrame) -> DataFrame:
    """Where each call sign was last seen; blank and missing call signs have no place."""
    named = flights.withColumn("callsign", F.nullif(F.trim("callsign", F.lit(BLANKS)), F.lit("")))
    return latest_by(named, "callsign", ["callsign", "icao24", "last_contact", "longitude", "latitude"])


def running_totals(flights: DataFrame) -> DataFrame:
    """Per poll: its number, its flights, and all flights so far.

    Polls are whole seconds, so the totals need only two levels, days and their seconds.
    """
    counts = flights.groupBy("time_ingest").agg(F.count("*").alias("flights"))
    polls = store(counts.withColumn("updates", F.lit(1)), "polls")
    before = totals_before(polls, "time_ingest", ["updates", "flights"], whole_seconds=True)
    return before.select(
        "time_ingest",
        (F.col("updates_before") + 1).alias("update_number"),
        "flights",
        (F.col("flights_before") + F.col("flights")).alias("total_flights"),
    )
