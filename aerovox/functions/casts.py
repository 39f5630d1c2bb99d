"""Forgiving conversions of VARIANT values: what cannot be converted becomes null.

A variant keeps the JSON type, so the number 3.7 (category 3) and the text "3.7"
(no whole number, hence null) stay apart; text columns could not tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamps outside 0001-01-01 .. 9999-12-31 are no positions in time.
EPOCH_MIN = -62135596800
EPOCH_MAX = 253402300799


def loose_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def loose_int(value: Column) -> Column:
    return F.try_variant_get(value, "$", "int")


def loose_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def loose_boolean(value: Column) -> Column:
    """Truth of a JSON value: empty text, zero, and empty lists or objects are false."""
    kind = F.schema_of_variant(value)
    text = loose_text(value)
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(F.try_variant_get(value, "$", "boolean"))
    )


def epoch_timestamp(seconds: Column) -> Column:
    """Epoch seconds, whole or fractional, as a timestamp; null in, null out."""
    return F.when(seconds.between(EPOCH_MIN, EPOCH_MAX), F.timestamp_seconds(seconds))
