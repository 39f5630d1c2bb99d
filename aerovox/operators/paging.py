"""Pages by position out of a table that grows: sorted runs on disk, found by rank.

Every append is sorted into a run of blocks; ``FANOUT`` runs of one level become one of the next, so
there are few, however many appends there were. For every block the index knows its first and last
key, and how many rows are before its first key at most and for certain. From these two numbers a
page finds the few blocks of each run that can hold its rows and opens no others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from aerovox.limits import check_range
from aerovox.operators.sequence import prefix_sums

FANOUT = 4
BLOCK_ROWS = 50_000

_KEYS = [StructField("_hash", LongType()), StructField("_batch", IntegerType()), StructField("_tie", LongType())]


@dataclass(frozen=True)
class PageIndex:
    """Rows of ``schema`` in the order of some of its columns, below ``folder``.

    Rows alike in ``order`` stand by a hash of the row, equal ones one after the other; nulls come
    first. One writer at a time; a reader sees the state of the last finished append. It needs no
    session of its own: the same arguments open it again anywhere. What a merge has made superfluous
    stays for those who still read it; give the folder ``runs`` an expiry by hand if that is too much.
    """

    folder: str
    schema: StructType
    order: tuple[str, ...]
    block_rows: int = BLOCK_ROWS
    fanout: int = FANOUT

    # --- what is stored ---------------------------------------------------------------------

    def _at(self, *parts: object) -> str:
        return "/".join([self.folder.rstrip("/"), *map(str, parts)])

    @property
    def _key(self) -> list[str]:
        return [*self.order, *[f.name for f in _KEYS]]

    @property
    def _row(self) -> StructType:
        return StructType([*self.schema.fields, *_KEYS])

    def _fences(self, spark: SparkSession) -> tuple[int, DataFrame | None]:
        """The number of the last append, and the blocks as it left them."""
        try:
            stored = spark.read.parquet(self._at("versions"))
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return 0, None
        version = stored.agg(F.max("version").alias("last")).first().last
        return version, stored.where(F.col("version") == version).drop("version")

    # --- appending --------------------------------------------------------------------------

    def append(self, rows: DataFrame) -> None:
        """Adds rows of the index's columns; none change nothing. Seen by readers all at once.

        If it fails, nothing has been added, and it can be repeated.
        """
        spark = rows.sparkSession
        version, fences = self._fences(spark)
        batch = version + 1
        marks = {
            "_hash": F.xxhash64(*self.schema.names),
            "_batch": F.lit(batch),
            "_tie": F.monotonically_increasing_id(),
        }
        added = self._run(rows.select(*self.schema.names).withColumns(marks), f"{batch}-0", 0)
        if added.isEmpty():
            return
        fences = added if fences is None else fences.select(*added.columns).unionByName(added)
        level = 0
        # As many runs as there are levels and FANOUT of each.
        while len(full := [r.run for r in fences.where(F.col("level") == level).select("run").distinct().collect()]) >= self.fanout:
            level += 1
            runs = [spark.read.schema(self._row).parquet(self._at("runs", run)) for run in full]
            merged = self._run(reduce(DataFrame.unionByName, runs), f"{batch}-{level}", level)
            fences = fences.where(~F.col("run").isin(full)).unionByName(merged)
        self._ranked(fences).write.mode("overwrite").parquet(self._at("versions", f"version={batch}"))

    def _run(self, rows: DataFrame, run: str, level: int) -> DataFrame:
        """Writes a run, a folder a block, and returns its blocks."""
        laid = rows.repartitionByRange(*self._key).sortWithinPartitions(*self._key)
        at = F.monotonically_increasing_id()
        laid = laid.withColumn("_at", at).withColumn(
            # A range has at most 2^33 rows.
            "block", F.shiftright("_at", 33) * (1 << 33) + F.floor(F.col("_at") % (1 << 33) / self.block_rows)
        )
        path = self._at("runs", run)
        laid.drop("_at").write.mode("overwrite").partitionBy("block").parquet(path)
        stored = rows.sparkSession.read.schema(self._row.add("block", LongType())).parquet(path)
        key = F.struct(*self._key)
        blocks = stored.groupBy("block").agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
        return blocks.select(F.lit(run).alias("run"), F.lit(level).alias("level"), "block", "rows", "first", "last")

    def _ranked(self, fences: DataFrame) -> DataFrame:
        """The blocks with ``most`` and ``least``: rows before their first key, counting the blocks that
        have begun there, and those that have ended."""
        starts = fences.select(F.col("first").alias("key"), F.lit(0).alias("ends"), "*")
        nothing = [F.lit(None).cast(fences.schema[c].dataType).alias(c) for c in ("run", "level", "block")]
        ends = fences.select(F.col("last").alias("key"), F.lit(1).alias("ends"), *nothing, "rows", "first", "last")
        begun, ended = (F.when(F.col("ends") == k, F.col("rows")).otherwise(0) for k in (0, 1))
        summed = prefix_sums(starts.unionByName(ends), None, ["key", "ends"], most=begun, least=ended)
        return summed.where("ends = 0").drop("key", "ends")

    # --- paging -----------------------------------------------------------------------------

    def size(self, spark: SparkSession) -> int:
        _, fences = self._fences(spark)
        return 0 if fences is None else fences.agg(F.sum("rows").alias("n")).first().n

    def page(self, spark: SparkSession, start: int, limit: int) -> DataFrame:
        """Rows ``start + 1`` to ``start + limit`` with their ``position``, in order; fewer or none at the end."""
        check_range("limit", limit, 1, 1000)
        check_range("start", start, 0, float("inf"))
        layout = StructType([StructField("position", LongType()), *self.schema.fields])
        _, fences = self._fences(spark)
        if fences is None:
            return spark.createDataFrame([], layout)
        # The page is behind every row before ``low``, and before every row from ``high`` on.
        bounds = fences.agg(
            F.max(F.when(F.col("most") <= start, F.col("first"))).alias("low"),
            F.min(F.when(F.col("least") >= start + limit, F.col("first"))).alias("high"),
        ).first()
        kind = fences.schema["first"].dataType
        over = F.col("last") < self._literal(bounds.low, kind)
        later = F.lit(False) if bounds.high is None else F.col("first") >= self._literal(bounds.high, kind)
        # A few blocks of each run, and those that the page fills.
        found = fences.agg(
            F.coalesce(F.sum(F.when(over, F.col("rows"))), F.lit(0)).alias("before"),
            F.collect_list(F.when(~over & ~later, F.struct("run", "block"))).alias("blocks"),
        ).first()
        paths = [self._at("runs", b.run, f"block={b.block}") for b in found.blocks]
        rows = spark.read.schema(self._row).parquet(*paths).orderBy(*self._key).limit(start + limit - found.before)
        place = F.row_number().over(Window.orderBy(*self._key)) + F.lit(found.before)
        rows = rows.withColumn("position", place.cast("long")).where(F.col("position") > start)
        return rows.orderBy("position").select("position", *self.schema.names)

    def _literal(self, key: Row, kind: StructType) -> Column:
        return F.struct(*[F.lit(key[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
