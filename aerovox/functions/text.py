"""Text expressions on both data sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def public_callsign(callsign: Column) -> Column:
    """Trimmed call sign. An empty one is null, an all-blank one stays as empty text."""
    return F.when(callsign != "", F.trim(callsign, F.lit(BLANKS)))


def flight_label(callsign: Column, icao24: Column, country: Column) -> Column:
    """``CALLSIGN (Country)``, with the address standing in for a missing call sign."""
    return F.concat(F.coalesce(F.nullif(callsign, F.lit("")), icao24), F.lit(" ("), country, F.lit(")"))


def word_count(text: Column) -> Column:
    """Number of blank-separated words."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))
