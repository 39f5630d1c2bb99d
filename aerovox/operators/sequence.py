"""Orders over a whole table without a whole table in one task.

Two tools: running totals along time, built in levels of bounded size, and positions of
rows in a total order, built from a range-partitioned sort that is written once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from aerovox.limits import check_range
from aerovox.session import store

# A page ends this early, as all rows before it are sorted for it in one task.
MOST_ROWS = 10_000

# Longest list of numbers that one row unfolds into at a time.
UNFOLD = 1 << 20


def _earlier(df: DataFrame, order: str, measures: list[str], suffix: str, *within: str) -> DataFrame:
    frame = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{m}_{suffix}": F.coalesce(F.sum(m).over(frame), F.lit(0)) for m in measures})


def totals_before(per_time: DataFrame, time: str, measures: list[str], whole_seconds: bool = False) -> DataFrame:
    """Adds ``<measure>_before``, the sum of each measure over all strictly earlier times.

    ``per_time`` has one row per ``time`` and is read at each level, so store it first. Sums run
    over the times of a second, the seconds of a day, and the days, so no window is larger than
    10^6, 86,400 or the days on record. With ``whole_seconds`` the first level is not needed. A
    null time comes before all others.
    """

    def sums(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])

    def join_up(df: DataFrame, upper: DataFrame, key: str) -> DataFrame:
        upper = upper.select(F.col(key).alias("_upper"), *[f"{m}_before" for m in measures])
        return df.join(upper, F.col(key).eqNullSafe(F.col("_upper"))).drop("_upper")

    def add_up(df: DataFrame) -> DataFrame:
        return df.withColumns({f"{m}_before": F.col(f"{m}_before") + F.col(f"{m}_within") for m in measures})

    keyed = per_time.withColumns({"_day": F.to_date(time), "_second": F.date_trunc("second", time)})
    seconds = keyed if whole_seconds else sums(keyed, "_day", "_second")
    days = _earlier(sums(seconds, "_day"), "_day", measures, "before")
    seconds = add_up(join_up(_earlier(seconds, "_second", measures, "within", "_day"), days, "_day"))
    if whole_seconds:
        result = seconds
    else:
        seconds = seconds.select("_second", *[f"{m}_before" for m in measures])
        result = add_up(join_up(_earlier(keyed, time, measures, "within", "_second"), seconds, "_second"))
    return result.select(*per_time.columns, *[f"{m}_before" for m in measures])


def prefix_sums(df: DataFrame, group: str | None, order: list[str], **measures: Column) -> DataFrame:
    """Adds, under each name, the sum of a measure over all earlier rows of the same ``group``.

    Rows stand in ``order``, those alike in it by a hash of the row, equal ones in any order; nulls
    come first and are a group like any other. The rows are sorted by ranges and written once, and
    what the ranges before add to a group follows from one sum per group and range, so neither a
    large group nor one repeated row comes into one task. Runs jobs while the plan is built.
    """
    groups = [group] if group else []
    keys = [*groups, *order, "_hash", "_tie"]
    marks = {"_hash": F.xxhash64(*df.columns), "_tie": F.monotonically_increasing_id()}
    steps = {f"_{name}": measure for name, measure in measures.items()}
    laid = df.withColumns({**marks, **steps}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = store(laid.drop("_hash", "_tie").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    laid = laid.withColumn("_range", F.shiftright("_at", 33))
    earlier = Window.partitionBy("_range", *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy("_range", *groups).agg(*[F.sum(s).alias(s) for s in steps])
    sums = sums.select(
        F.col("_range").alias("_of"),
        *[F.col(g).alias("_group") for g in groups],
        *[F.sum(s).over(before).alias(f"_before{s}") for s in steps],
        F.count("*").over(before).alias("_ranges"),
    )
    # Only the group a range begins with can go on from the range before: one row a range at most.
    sums = F.broadcast(sums.where("_ranges > 0").drop("_ranges"))
    same = F.col("_range") == F.col("_of")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col("_group"))
    within = laid.withColumns({f"_within{s}": F.sum(s).over(earlier) for s in steps})
    total = {
        name: F.coalesce(f"_before_{name}", F.lit(0)) + F.coalesce(f"_within_{name}", F.lit(0)) for name in measures
    }
    kept = [F.col(c) for c in df.columns if c not in measures]
    return within.join(sums, same, "left").select(*kept, *[e.alias(name) for name, e in total.items()])


def unfold(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row per whole number from ``first`` to ``last``, none where the run is empty.

    Long runs are cut into pieces, and the pieces spread over the cluster before they unfold.
    """
    start = F.col("_start")
    return (
        df.withColumns({"_first": first, "_last": last})
        .where(F.col("_first") <= F.col("_last"))
        .withColumn("_start", F.explode(F.sequence("_first", "_last", F.lit(UNFOLD))))
        .repartition("_start")
        .withColumn(name, F.explode(F.sequence(start, F.least(start + F.lit(UNFOLD - 1), F.col("_last")))))
        .drop("_first", "_last", "_start")
    )


def _running_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to a sorted partition how many rows came up to and with each row."""
    done = 0
    for batch in batches:
        end = pc.add(pc.cumulative_sum(batch.column("copies")), done)
        done = end[-1].as_py() if batch.num_rows else done
        yield pa.RecordBatch.from_arrays([*batch.columns, end], names=[*batch.schema.names, "_end"])


class Range(NamedTuple):
    """A sorted part of a numbered table and the number of rows in and before it."""

    part: int
    rows: int
    before: int


class Numbered:
    """A table with the position of each row in a total order, written once, paged often.

    Equal rows are stored once with their number of ``copies``; ``position`` is that of the
    first copy, counted from 1. The table has a folder per sorted range, and a page reads
    only the ranges, and in them only the row groups, that it touches.
    """

    def __init__(self, df: DataFrame, order: list[str]):
        self.columns = df.columns
        keys = [*[F.col(c) for c in order], F.xxhash64(*df.columns)]
        ranges = (
            df.groupBy(*df.columns)
            .agg(F.count("*").alias("copies"))
            .repartitionByRange(*keys)
            .sortWithinPartitions(*keys)
            .withColumn("_range", F.spark_partition_id())
        )
        schema = T.StructType([*ranges.schema.fields, T.StructField("_end", T.LongType())])
        self._stored = store(ranges.mapInArrow(_running_copies, schema), "numbered", "_range")
        # One row per range of the sort: at most spark.sql.shuffle.partitions of them.
        sizes = self._stored.groupBy("_range").agg(F.max("_end").alias("rows")).collect()
        self._ranges: list[Range] = []
        before = 0
        for part, rows in sorted(sizes):
            self._ranges.append(Range(part, rows, before))
            before += rows

    def _positioned(self, stored: DataFrame, ranges: list[Range]) -> DataFrame:
        offsets = stored.sparkSession.createDataFrame(
            [(r.part, r.before) for r in ranges], "_range int, _before long"
        )
        return (
            stored.join(F.broadcast(offsets), "_range")
            .withColumn("position", F.col("_before") + F.col("_end") - F.col("copies") + 1)
            .select(*self.columns, "copies", "position")
        )

    @property
    def rows(self) -> DataFrame:
        return self._positioned(self._stored, self._ranges)

    def page(self, start: int, limit: int) -> DataFrame:
        """Rows ``start + 1`` to ``start + limit``, in order."""
        first, last = start + 1, start + limit
        touched = [r for r in self._ranges if r.before < last and r.before + r.rows >= first]
        # A range holds at least one row, so a page touches no more ranges than it has rows.
        stored = self._stored.where(F.col("_range").isin([r.part for r in touched]))
        if touched:
            stored = stored.where(F.col("_end") >= first - touched[-1].before)
        hits = self._positioned(stored, touched).withColumns(
            {
                "_from": F.greatest(F.col("position"), F.lit(first)),
                "_to": F.least(F.col("position") + F.col("copies") - 1, F.lit(last)),
            }
        )
        # A page holds at most ``limit`` rows, so neither does a list of its positions.
        return (
            hits.where(F.col("_from") <= F.col("_to"))
            .withColumn("position", F.explode(F.sequence("_from", "_to")))
            .orderBy("position")
            .limit(limit)
            .select("position", *self.columns)
        )


def page(df: DataFrame, order: list[str], start: int, limit: int) -> DataFrame:
    """Rows ``start + 1`` to ``start + limit`` in the given order, with their positions.

    A page among the first ``MOST_ROWS`` of any table; ``paging.PageIndex`` has those further on.
    """
    check_range("limit", limit, 1, 1000)
    check_range("start", start, 0, MOST_ROWS - limit)
    keys = [*[F.col(c) for c in order], F.xxhash64(*df.columns)]
    place = Window.orderBy(*keys)
    top = df.orderBy(*keys).limit(start + limit)
    return top.withColumn("position", F.row_number().over(place).cast("long")).where(F.col("position") > start).select(
        "position", *df.columns
    )


def page_after(df: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows behind the cursor ``after`` (``None`` starts at the top).

    Every row has its own ``cursor``: its keys, a hash of the row, and which of the equal rows it
    is. That of the last row leads to the next page, so a walk serves each row once, whatever
    repeats. The keys alone are a cursor behind all rows that have them. Nulls come first. A page
    costs one pruned top-k of ``limit`` rows; the equal rows that the cursor stands among are counted.
    """
    check_range("limit", limit, 1, 1000)
    keys = [*order, "_mark"]
    rows = df.withColumn("_mark", F.xxhash64(*df.columns))
    served = 0
    if after is not None:
        values = list(after)
        if len(values) == len(keys) + 1:
            served = values.pop()
        beyond, equal = F.lit(False), F.lit(True)
        for name, value in zip(keys, values, strict=False):
            missing = value is None
            beyond = beyond | (equal & (F.col(name).isNotNull() if missing else F.col(name) > F.lit(value)))
            equal = equal & (F.col(name).isNull() if missing else F.col(name).eqNullSafe(F.lit(value)))
        if values[0] is not None:  # this one reaches the scan
            rows = rows.where(F.col(order[0]) >= F.lit(values[0]))
        among, rows = rows.where(equal), rows.where(beyond)
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    top = rows.orderBy(*keys).limit(limit).withColumn("_copy", copy.cast("long"))
    if served:
        left = F.sequence(F.lit(served + 1).cast("long"), F.least("_n", F.lit(served + limit)))
        again = among.groupBy(*among.columns).agg(F.count("*").alias("_n")).where(F.col("_n") > served)
        top = top.unionByName(again.withColumn("_copy", F.explode(left)).drop("_n"))
    cursor = F.struct(*keys, "_copy").alias("cursor")
    return top.orderBy(*keys, "_copy").limit(limit).select(*df.columns, cursor)
