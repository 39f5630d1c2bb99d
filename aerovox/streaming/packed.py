"""A streaming table whose small files are packed into large ones while the stream goes on.

Micro-batches become partitions of one table. Packing copies those that have come since into a
segment, and segments of one level into one of the next, so every row is copied a few times only.
What the table shows is a view over the segments and the batches after them; replacing its
definition is the switch, so a reader sees each row once, before, during and after.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from aerovox.streaming.ingest import triggered

#: Segments of one level that become one of the next.
FANOUT = 8


@dataclass(frozen=True)
class PackedTable:
    """The table ``name`` of a database, with rows of ``schema``. One stream writes it, one job packs it.

    Beside it stand ``<name>_batches`` and the segments, ``<name>__<level>_<last batch>``.
    """

    database: str
    name: str
    schema: StructType
    fanout: int = FANOUT

    @property
    def _table(self) -> str:
        return f"{self.database}.{self.name}"

    @property
    def _batches(self) -> str:
        return f"{self._table}_batches"

    @property
    def _columns(self) -> str:
        return ", ".join(f"`{c}`" for c in self.schema.names)

    def create(self, spark: SparkSession) -> None:
        """Makes the empty table, unless it exists."""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        if not spark.catalog.tableExists(self._batches):
            empty = spark.createDataFrame([], StructType([*self.schema.fields, StructField("batch", LongType())]))
            empty.write.partitionBy("batch").format("parquet").saveAsTable(self._batches)
        if not spark.catalog.tableExists(self._table):
            self._show(spark, [], -1)

    def append(self, rows: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Adds the rows of a stream. A batch that comes again replaces its partition."""
        self.create(rows.sparkSession)

        def add(batch: DataFrame, batch_id: int) -> None:
            batch.sparkSession.sql(
                f"INSERT OVERWRITE TABLE {self._batches} PARTITION (batch = {int(batch_id)}) SELECT {self._columns} FROM {{batch}}",
                batch=batch,
            )

        return triggered(rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint), every).start()

    def pack(self, spark: SparkSession) -> None:
        """Packs the batches that have come since the last time; the stream may run meanwhile.

        What the time before made superfluous is dropped, so readers have one whole turn to finish. If it
        fails, the view is as before, and it can be repeated.
        """
        segments, upto = before, _ = self._shown(spark)
        there = [int(r.partition.split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {self._batches}").collect()]
        last = max(there, default=-1)
        if last <= upto:
            return
        fresh = spark.table(self._batches).where(F.col("batch").between(upto + 1, last)).drop("batch")
        segments = [*segments, self._segment(fresh, 0, last)]
        level = 0
        while len(full := [s for s in segments if s.startswith(f"{self.name}__{level}_")]) >= self.fanout:
            level += 1
            merged = reduce(DataFrame.unionByName, [spark.table(f"{self.database}.{s}") for s in full])
            segments = [*[s for s in segments if s not in full], self._segment(merged, level, last)]
        self._show(spark, segments, last)
        for batch in there:
            if batch <= upto:
                spark.sql(f"ALTER TABLE {self._batches} DROP IF EXISTS PARTITION (batch = {batch})")
        for table in spark.catalog.listTables(self.database):
            if table.name.startswith(f"{self.name}__") and table.name not in (*segments, *before):
                spark.sql(f"DROP TABLE {self.database}.{table.name}")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self._table)

    def _segment(self, rows: DataFrame, level: int, last: int) -> str:
        name = f"{self.name}__{level}_{last}"
        # Files of the size that adaptive execution aims at.
        rows.hint("rebalance").write.mode("overwrite").format("parquet").saveAsTable(f"{self.database}.{name}")
        return name

    def _show(self, spark: SparkSession, segments: list[str], upto: int) -> None:
        parts = [f"SELECT {self._columns} FROM {self.database}.{s}" for s in segments]
        parts.append(f"SELECT {self._columns} FROM {self._batches} WHERE batch > {upto}")
        spark.sql(f"CREATE OR REPLACE VIEW {self._table} AS {' UNION ALL '.join(parts)}")

    def _shown(self, spark: SparkSession) -> tuple[list[str], int]:
        """The segments that the view reads, and the batch up to which they have the rows."""
        text = spark.sql(f"DESCRIBE TABLE EXTENDED {self._table}").where("col_name = 'View Text'").first().data_type
        found = re.findall(rf"FROM {re.escape(self.database)}\.({re.escape(self.name)}__\d+_\d+)", text)
        return found, int(text.rsplit(">", 1)[1])
