"""Landed files as tables and as streams, decoded by Spark's own JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerovox.operators.flights import in_region
from aerovox.operators.polls import flights_from_polls
from aerovox.operators.utterances import normalize, parse_utterances
from aerovox.regions import region_box


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as ``value``. Spark splits large files, so one big file is many tasks."""
    return spark.read.text(path)


def read_line_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same lines as a stream; ``max_files_per_trigger`` bounds one micro-batch."""
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)


def flights_in(lines: DataFrame, region: str | None) -> DataFrame:
    """Valid flights of poll lines, all of them or those of one region."""
    if region is None:
        return flights_from_polls(lines)
    region_box(region)
    return in_region(flights_from_polls(lines), region)


def utterances_in(lines: DataFrame) -> DataFrame:
    """Utterances of landed lines, with their defaults."""
    return normalize(parse_utterances(lines))


def read_flights(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    return flights_in(read_lines(spark, path), region)


def read_flight_stream(
    spark: SparkSession, path: str, region: str | None = None, max_files_per_trigger: int | None = None
) -> DataFrame:
    return flights_in(read_line_stream(spark, path, max_files_per_trigger), region)


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    return utterances_in(read_lines(spark, path))


def read_utterance_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    return normalize(parse_utterances(read_line_stream(spark, path, max_files_per_trigger)))


def write_utterances(utterances: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    """JSON lines, one utterance each; ``rows_per_file`` sets how much one file, and so one
    step of a stream that takes a file at a time, brings."""
    writer = utterances.write
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.json(path)
