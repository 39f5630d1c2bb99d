"""Questions a user asks about the flights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def speed_histogram(flights: DataFrame, width: float = 50.0) -> DataFrame:
    """Positions per speed interval of the given width. What is no finite speed, or too large to
    have an interval, counts under a null bucket."""
    if width <= 0:
        raise ValueError(f"width must be positive, not {width}")
    steps = F.col("velocity") / width
    bucket = F.when(F.abs(steps) < 2.0**53, F.floor(steps)).alias("bucket")
    return (
        flights.where(F.col("velocity").isNotNull())
        .groupBy(bucket)
        .agg(F.count("*").alias("num_events"))
        .select(
            "bucket",
            (F.col("bucket") * width).alias("speed_from"),
            ((F.col("bucket").cast("double") + 1) * width).alias("speed_to"),
            "num_events",
        )
    )


def altitude_velocity(flights: DataFrame) -> DataFrame:
    """Points of the altitude-speed scatter plot."""
    return flights.select("geo_altitude", "velocity").where(
        F.col("geo_altitude").isNotNull() & F.col("velocity").isNotNull()
    )


def unique_flights(flights: DataFrame) -> DataFrame:
    """How many call signs and how many aircraft were seen."""
    return flights.agg(
        F.countDistinct("callsign").alias("unique_callsigns"), F.countDistinct("icao24").alias("unique_aircraft")
    )


def profile(df: DataFrame) -> DataFrame:
    """Per column: values present, distinct values, smallest and largest, as text.

    Every row becomes narrow (column, value) pairs, the value in a slot of its own type, and these
    combine before the shuffle: one scan and two shuffles for any number of columns and types.
    """
    kinds = list(dict.fromkeys(kind for _, kind in df.dtypes))
    slots = [f"v{i}" for i in range(len(kinds))]
    pairs = [
        F.struct(
            F.lit(name).alias("column"),
            *[(F.col(f"`{name}`") if own == kind else F.lit(None).cast(kind)).alias(s) for s, kind in zip(slots, kinds)],
        )
        for name, own in df.dtypes
    ]
    present = reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in slots])
    counted = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy("column", *slots).agg(F.count("*").alias("n"))
    return (
        counted.withColumn("present", present)
        .groupBy("column")
        .agg(
            F.sum(F.when(F.col("present"), F.col("n")).otherwise(0)).alias("non_null"),
            F.count_if("present").alias("distinct_values"),
            *[F.min(s).alias(f"min_{s}") for s in slots],
            *[F.max(s).alias(f"max_{s}") for s in slots],
        )
        .select(
            "column",
            "non_null",
            "distinct_values",
            *[F.coalesce(*[F.col(f"{end}_{s}").cast("string") for s in slots]).alias(f"{end}_value") for end in ("min", "max")],
        )
    )
