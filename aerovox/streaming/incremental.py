"""Aggregate views kept up to date by a stream, with exact results.

The groups live in Spark's streaming state (RocksDB, so they need not fit in memory). A
micro-batch hands out the groups that it changed, and these replace their former rows in a table
that is partitioned by a hash of the key: a batch rewrites the buckets it touches and no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from aerovox.operators.bitmaps import KEYS, address_bits, distinct_aircraft, with_parts
from aerovox.operators.stats import conversation_stats, transcript_by_speaker
from aerovox.schemas import FLIGHT, UTTERANCE
from aerovox.streaming.ingest import triggered

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Parts of the table of groups. A batch rewrites at least one, so it should be of a size to rewrite.
BUCKETS = 64


@dataclass(frozen=True)
class LiveView:
    """A view over a stream of ``source`` rows.

    ``group`` aggregates rows by ``keys``; it runs as a streaming aggregation in update mode.
    ``finish`` makes the view out of the groups. Everything is kept below ``folder``.
    """

    folder: str
    source: StructType
    keys: tuple[str, ...]
    group: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame] = lambda groups: groups
    buckets: int = BUCKETS

    def start(self, rows: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Goes on from ``checkpoint``, where the state is; keep it with ``folder``, as they belong together.

        The number of state partitions is ``spark.sql.shuffle.partitions`` of the first run for good.
        """
        spark = rows.sparkSession
        before = spark.conf.get(STATE_PROVIDER, None)
        spark.conf.set(STATE_PROVIDER, ROCKSDB)
        try:
            writer = self.group(rows).writeStream.outputMode("update").foreachBatch(self.replace)
            return triggered(writer.option("checkpointLocation", checkpoint), every).start()
        finally:
            spark.conf.unset(STATE_PROVIDER) if before is None else spark.conf.set(STATE_PROVIDER, before)

    def replace(self, changed: DataFrame, batch_id: int) -> None:
        """Sink of a micro-batch: the new rows of the touched buckets, then the buckets themselves.

        The new rows are written beside the table first and marked with their batch. Should the run
        end while buckets are being replaced, the batch comes again and finds them complete.
        """
        spark = changed.sparkSession
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        # Written even if it comes again: running it is what commits the batch's state.
        changed.withColumn("bucket", bucket).write.mode("overwrite").parquet(self._at("changed"))
        staged = self._read(spark, "staged", "batch long")
        if staged is None or staged.first().batch != batch_id:
            self._stage(spark)
            spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("overwrite").parquet(self._at("staged"))
        rows = spark.read.schema(self._layout(spark)).parquet(self._at("next"))
        writer = rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(self._at("groups"))

    def _stage(self, spark: SparkSession) -> None:
        layout = self._layout(spark)
        changed = spark.read.schema(layout).parquet(self._at("changed"))
        rows = changed
        groups = self._read(spark, "groups", layout)
        if groups is not None:
            # No more numbers than there are buckets; only these folders are read.
            touched = [r.bucket for r in changed.select("bucket").distinct().collect()]
            same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in ("bucket", *self.keys)]
            old = groups.where(F.col("bucket").isin(touched)).alias("old")
            rows = old.join(changed.alias("new"), same, "left_anti").unionByName(changed)
        rows.write.mode("overwrite").parquet(self._at("next"))

    def groups(self, spark: SparkSession) -> DataFrame:
        """All groups as of the last batch. To be read between batches."""
        layout = self._layout(spark)
        found = self._read(spark, "groups", layout)
        return (spark.createDataFrame([], layout) if found is None else found).drop("bucket")

    def current(self, spark: SparkSession) -> DataFrame:
        """The view of everything taken in so far."""
        return self.finish(self.groups(spark))

    def _layout(self, spark: SparkSession) -> StructType:
        grouped = self.group(spark.createDataFrame([], self.source)).schema
        return StructType([*grouped.fields, StructField("bucket", IntegerType())])

    def _at(self, part: str) -> str:
        return f"{self.folder.rstrip('/')}/{part}"

    def _read(self, spark: SparkSession, part: str, layout: StructType | str) -> DataFrame | None:
        try:
            return spark.read.schema(layout).parquet(self._at(part))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None


def _per_part(flights: DataFrame) -> DataFrame:
    return with_parts(flights).groupBy(*KEYS).agg(
        F.count("*").alias("num_events"),
        address_bits().alias("bits"),
        F.max("vertical_rate").alias("max_asc_rate"),
        F.min("vertical_rate").alias("max_desc_rate"),
        F.max("velocity").alias("max_speed"),
        F.max("geo_altitude").alias("max_altitude"),
        F.min("time_ingest").alias("first_ingest"),
        F.max("time_ingest").alias("last_ingest"),
    )


def _flight_stats(parts: DataFrame) -> DataFrame:
    return parts.agg(
        F.coalesce(F.sum("num_events"), F.lit(0)).alias("num_events"),
        distinct_aircraft().alias("unique_aircraft"),
        F.max("max_asc_rate").alias("max_asc_rate"),
        F.min("max_desc_rate").alias("max_desc_rate"),
        F.max("max_speed").alias("max_speed"),
        F.max("max_altitude").alias("max_altitude"),
        F.timestamp_diff("SECOND", F.min("first_ingest"), F.max("last_ingest")).alias("observation_duration"),
    )


def incremental_flight_stats(folder: str, buckets: int = BUCKETS) -> LiveView:
    """``flight_stats`` from bitmaps of aircraft: 513 groups, and one for each name that is no address."""
    return LiveView(folder, FLIGHT, KEYS, _per_part, _flight_stats, buckets)


def incremental_transcript_by_speaker(folder: str, buckets: int = BUCKETS) -> LiveView:
    return LiveView(folder, UTTERANCE, ("speaker", "domain"), transcript_by_speaker, buckets=buckets)


def incremental_conversation_stats(folder: str, buckets: int = BUCKETS) -> LiveView:
    keys = ("conversation_id", "domain", "topic", "accent")
    return LiveView(folder, UTTERANCE, keys, conversation_stats, buckets=buckets)
