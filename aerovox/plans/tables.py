"""The tables of both data sets: one streaming table each, and the views stored over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerovox.operators.quality import Rule
from aerovox.operators.stats import conversation_stats, flight_stats, transcript_by_speaker
from aerovox.session import use_utc
from aerovox.streaming.incremental import (
    LiveView,
    incremental_conversation_stats,
    incremental_flight_stats,
    incremental_transcript_by_speaker,
)
from aerovox.streaming.ingest import (
    finish,
    ingest_flights,
    ingest_rejected_polls,
    ingest_rejected_utterances,
    ingest_transcripts,
)

FLIGHT_TABLE = "ingest_flights"
TRANSCRIPT_TABLE = "ingest_transcripts"
REJECTED_TABLE = "rejected_polls"
REJECTED_UTTERANCES = "rejected_utterances"


@dataclass(frozen=True)
class View:
    """A query to store. A table keeps no order, so whoever reads it sorts by ``order``."""

    source: str
    query: Callable[[DataFrame], DataFrame]
    incremental: Callable[[str], LiveView]
    order: Callable[[], list[Column]] = list

    def sort(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(*self.order()) if self.order() else rows

    def live(self, source_rows: DataFrame) -> DataFrame:
        """The view computed on the spot and sorted."""
        return self.sort(self.query(source_rows))


VIEWS = {
    "flight_stats": View(FLIGHT_TABLE, flight_stats, incremental_flight_stats),
    "transcript_by_speaker": View(
        TRANSCRIPT_TABLE,
        transcript_by_speaker,
        incremental_transcript_by_speaker,
        lambda: [F.col("domain"), F.col("speaker")],
    ),
    "conversation_stats": View(
        TRANSCRIPT_TABLE,
        conversation_stats,
        incremental_conversation_stats,
        lambda: [F.desc("conversation_start")],
    ),
}


#: Folders that a view's snapshots take in turn. A reader that planned its query before a refresh
#: can finish it, if no more than two others follow meanwhile.
SNAPSHOTS = 3


def publish(rows: DataFrame, database: str, name: str) -> None:
    """Stores ``rows`` as the view ``name``, all at once.

    They are written to a folder that nobody reads, then the view's definition is replaced by one
    that reads that folder: readers see the old rows or the new ones, also if this fails half way.
    """
    spark = rows.sparkSession
    full = f"{database}.{name}"
    root = f"{spark.catalog.getDatabase(database).locationUri}/{name}_snapshots"
    number = 0
    if spark.catalog.tableExists(full):
        if spark.catalog.getTable(full).tableType == "VIEW":
            described = spark.sql(f"DESCRIBE TABLE EXTENDED {full}").where("col_name = 'View Text'").first()
            number = (int(described.data_type.rstrip("`").rsplit("/", 1)[1]) + 1) % SNAPSHOTS
        else:  # stored as a table by an earlier release
            spark.sql(f"DROP TABLE {full}")
    rows.write.mode("overwrite").parquet(f"{root}/{number}")
    spark.sql(f"CREATE OR REPLACE VIEW {full} AS SELECT * FROM parquet.`{root}/{number}`")


def refresh_view(spark: SparkSession, database: str, name: str, state: str | None = None) -> DataFrame:
    """Stores a view anew and returns it.

    With a ``state`` folder only rows that came since the last refresh are read, and added
    to the groups kept there. Without one the whole source table is read.
    """
    view = VIEWS[name]
    source = f"{database}.{view.source}"
    if state is None:
        rows = view.query(spark.table(source))
    else:
        kept = view.incremental(f"{state}/{name}")
        finish(kept.start(spark.readStream.table(source), f"{state}/{name}-stream"))
        rows = kept.current(spark)
    publish(rows, database, name)
    return read_view(spark, database, name)


def read_view(spark: SparkSession, database: str, name: str) -> DataFrame:
    return VIEWS[name].sort(spark.table(f"{database}.{name}"))


def _refresh(spark: SparkSession, database: str, ingest, source: str, landing: str, state: str, **options) -> None:
    use_utc(spark).sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    finish(ingest(spark, landing, f"{state}/{source}", table=f"{database}.{source}", **options))
    for name, view in VIEWS.items():
        if view.source == source:
            refresh_view(spark, database, name, state)


def refresh_flights(
    spark: SparkSession,
    landing: str,
    state: str,
    database: str = "default",
    region: str | None = None,
    rules: tuple[Rule, ...] = (),
    max_files_per_trigger: int | None = None,
) -> None:
    """Takes in the polls that have landed since the last refresh, then brings the views up
    to date. Lines that are no poll go to the table ``rejected_polls``.

    ``state`` is a shared folder that holds how far each table and view has come.
    """
    files = {"max_files_per_trigger": max_files_per_trigger}
    _refresh(spark, database, ingest_flights, FLIGHT_TABLE, landing, state, region=region, rules=rules, **files)
    rejected = f"{database}.{REJECTED_TABLE}"
    finish(ingest_rejected_polls(spark, landing, f"{state}/{REJECTED_TABLE}", table=rejected, **files))


def refresh_transcripts(
    spark: SparkSession,
    landing: str,
    state: str,
    database: str = "default",
    rules: tuple[Rule, ...] = (),
    max_files_per_trigger: int | None = None,
) -> None:
    """The same for landed utterances; lines that are none go to ``rejected_utterances``."""
    options = {"rules": rules, "max_files_per_trigger": max_files_per_trigger}
    _refresh(spark, database, ingest_transcripts, TRANSCRIPT_TABLE, landing, state, **options)
    rejected = f"{database}.{REJECTED_UTTERANCES}"
    files = {"max_files_per_trigger": max_files_per_trigger}
    finish(ingest_rejected_utterances(spark, landing, f"{state}/{REJECTED_UTTERANCES}", table=rejected, **files))
