"""Exact counts of distinct aircraft that add up over batches, days or any other parts.

A 24-bit address is one of 16.7 million, so a set of them is at most 2 MB of bits, however many
aircraft or positions: 512 blocks of 4 KB. Blocks are combined before the shuffle and merge by
OR. A name that is no six small hexadecimal digits has no bit; such names are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS = "^[0-9a-f]{6}$"

#: What tells the parts of one set apart: the block of an address, or the name that is none.
KEYS = ("address_block", "other_name")


def _address(name: Column) -> Column:
    """The address as a number from 0, null for other names."""
    return F.when(name.rlike(ADDRESS), F.conv(name, 16, 10).cast("long"))


def with_parts(flights: DataFrame, column: str = "icao24") -> DataFrame:
    """``flights`` with the columns ``KEYS`` to group by; both are null where ``column`` is."""
    # Spark counts its bits from 1.
    place = _address(F.col(column)) + 1
    other = F.when(place.isNull(), F.col(column))
    return flights.withColumns({"address_block": F.bitmap_bucket_number(place), "other_name": other})


def address_bits(column: str = "icao24") -> Column:
    """Aggregate over a group of one ``address_block``: its bits."""
    return F.bitmap_construct_agg(F.bitmap_bit_position(F.coalesce(_address(F.col(column)) + 1, F.lit(1).cast("long"))))


def aircraft_parts(flights: DataFrame, *by: str, column: str = "icao24") -> DataFrame:
    """Per ``by``, the parts of the set of distinct aircraft: ``KEYS`` and ``bits``."""
    return with_parts(flights, column).groupBy(*by, *KEYS).agg(address_bits(column).alias("bits"))


def merge_parts(parts: DataFrame, *by: str) -> DataFrame:
    """The parts of several sets as those of their union per ``by``."""
    return parts.groupBy(*by, *KEYS).agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_aircraft() -> Column:
    """Aggregate over merged parts: how many aircraft; a missing name is none."""
    known = F.when(F.col("address_block").isNotNull(), F.bitmap_count("bits"))
    return F.coalesce(F.sum(known), F.lit(0)) + F.count("other_name")


def count_aircraft(parts: DataFrame, *by: str) -> DataFrame:
    """Distinct aircraft per ``by`` over parts that may overlap, as batches do."""
    return merge_parts(parts, *by).groupBy(*by).agg(distinct_aircraft().alias("unique_aircraft"))
