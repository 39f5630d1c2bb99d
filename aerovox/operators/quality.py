"""Data-quality rules that warn, drop or fail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("warn", "drop", "fail")


@dataclass(frozen=True)
class Rule:
    """``condition`` is a SQL predicate; a row for which it is not true breaches the rule."""

    name: str
    condition: str
    action: str = "warn"

    def __post_init__(self) -> None:
        if self.action not in ACTIONS:
            raise ValueError(f"action must be one of {', '.join(ACTIONS)}, not {self.action!r}")

    @property
    def holds(self) -> Column:
        return F.coalesce(F.expr(self.condition), F.lit(False))


# Names and conditions of the rules on both tables.
ICAO24_PRESENT = Rule("icao24_not_null", "icao24 IS NOT NULL", "warn")
COORDINATES_PRESENT = Rule("coord_exist", "latitude IS NOT NULL AND longitude IS NOT NULL", "drop")
CONFIDENCE_IN_RANGE = Rule("confidence_range", "confidence BETWEEN 0 AND 1", "fail")


def enforce(df: DataFrame, *rules: Rule) -> DataFrame:
    """Applies the rules in order: warn keeps every row, drop removes breaches, fail raises."""
    for rule in rules:
        if rule.action == "drop":
            df = df.where(rule.holds)
        elif rule.action == "fail":
            message = F.lit(f"rule {rule.name} breached: {rule.condition}")
            df = df.where(F.when(rule.holds, True).otherwise(F.raise_error(message).cast("boolean")))
    return df


def _breaches(rule: Rule) -> Column:
    return F.count_if(~rule.holds).alias(rule.name)


def observe(df: DataFrame, metrics: str, *rules: Rule) -> DataFrame:
    """Counts breaches while the rows flow by, in a batch or in a stream's progress."""
    return df.observe(metrics, F.count("*").alias("rows"), *[_breaches(r) for r in rules])


def report(df: DataFrame, *rules: Rule) -> DataFrame:
    """Rows seen and breaches per rule, from one pass over the rules' columns."""
    counts = df.agg(F.count("*").alias("rows"), *[_breaches(r) for r in rules])
    lines = [
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.col("rows"), F.col(r.name).alias("failed")
        )
        for r in rules
    ]
    return counts.select(F.inline(F.array(*lines)))


def quarantine(df: DataFrame, *rules: Rule) -> DataFrame:
    """The rows that breach any rule, with the names of the breached rules."""
    breached = F.array_compact(F.array(*[F.when(~r.holds, F.lit(r.name)) for r in rules]))
    return df.withColumn("breached", breached).where(F.size("breached") > 0)
