"""Streaming tables: landed files in, an append-only Parquet table out, exactly once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from aerovox.limits import check_range
from aerovox.operators.polls import rejected_polls
from aerovox.operators.quality import Rule, enforce, observe
from aerovox.operators.utterances import rejected_utterances
from aerovox.sources import read_flight_stream, read_line_stream, read_utterance_stream
from aerovox.streaming.summary import watch

# Fixed value: shortest time between two polls.
POLL_SPACING = "5 seconds"

# Name under which a stream reports its breached rules.
QUALITY_METRICS = "quality"


def triggered(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """``every`` is the spacing of a continuous run; without it, all that has landed is
    read in as many batches as needed and the stream ends."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def append_stream(
    rows: DataFrame,
    checkpoint: str,
    table: str | None = None,
    path: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Appends each batch to a named table, to a folder, or to a named table in a folder."""
    if not (table or path):
        raise ValueError("name a table or a path to write to")
    watch(rows.sparkSession, QUALITY_METRICS)
    writer = triggered(rows.writeStream.format("parquet").outputMode("append"), every)
    writer = writer.option("checkpointLocation", checkpoint)
    if path:
        writer = writer.option("path", path)
    return writer.toTable(table) if table else writer.start()


def _checked(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return enforce(observe(rows, QUALITY_METRICS, *rules), *rules)


def ingest_flights(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    table: str | None = None,
    path: str | None = None,
    region: str | None = None,
    rules: tuple[Rule, ...] = (),
    max_files_per_trigger: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    rows = read_flight_stream(spark, landing, region, max_files_per_trigger)
    return append_stream(_checked(rows, rules), checkpoint, table, path, every)


def ingest_rejected_polls(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    table: str | None = None,
    path: str | None = None,
    max_files_per_trigger: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Keeps the landed lines that are no poll, for someone to look at."""
    rows = rejected_polls(read_line_stream(spark, landing, max_files_per_trigger))
    return append_stream(rows, checkpoint, table, path, every)


def ingest_transcripts(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    table: str | None = None,
    path: str | None = None,
    rules: tuple[Rule, ...] = (),
    max_files_per_trigger: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    rows = read_utterance_stream(spark, landing, max_files_per_trigger)
    return append_stream(_checked(rows, rules), checkpoint, table, path, every)


def take_stream(
    rows: DataFrame, most: int, order: list[str], checkpoint: str, path: str, every: str | None = None
) -> StreamingQuery:
    """Appends the batches to the folder ``path`` until it has ``most`` rows, over any number of runs.

    What earlier batches have left open is what a batch may add; the one that goes beyond is cut in
    ``order``, equal rows by a hash. A batch that comes again counts the same earlier ones and
    replaces what it wrote, so the rows stay the same. Once full, further batches add nothing;
    ``taken`` tells when to stop a continuous run. ``most`` rows at most are sorted for a cut.
    """
    check_range("most", most, 1, 1_000_000)

    def add(batch: DataFrame, batch_id: int) -> None:
        left = most - taken(batch.sparkSession, path, batch_id)
        if left > 0:
            cut = batch.orderBy(*order, F.xxhash64(*batch.columns)).limit(left)
            cut.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return triggered(writer, every).start()


def taken(spark: SparkSession, path: str, before: int | None = None) -> int:
    """Rows that ``take_stream`` has added to a folder, all or those of batches before one."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0
    return rows.count() if before is None else rows.where(F.col("batch") < before).count()


def ingest_rejected_utterances(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    table: str | None = None,
    path: str | None = None,
    max_files_per_trigger: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Keeps the landed lines that are no utterance, those with a mistyped field among them."""
    rows = rejected_utterances(read_line_stream(spark, landing, max_files_per_trigger))
    return append_stream(rows, checkpoint, table, path, every)


def finish(query: StreamingQuery, seconds: float | None = None) -> StreamingQuery:
    """Waits for the end of the stream, or stops it after so many seconds."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
    return query


def resume_point(query: StreamingQuery) -> str | None:
    """The last committed source offset, from which a restart goes on."""
    progress = query.lastProgress
    return progress.sources[0].endOffset if progress and progress.sources else None
