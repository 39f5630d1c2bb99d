"""Removal of repeated lines against levelled sorted runs of line hashes.

What has been seen is kept as runs: tables of line hashes with the document that owns the line,
bucketed and sorted by hash. A batch joins its own hashes against every run (a merge join that
moves only the batch), drops what is there, and adds what is new as a run of level 0. As soon as a
level has ``fanout`` runs they merge into one run of the next level, so there are few runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerovox.llm.common import SPACE_CHARS, free_name, lower_ascii, two_hashes
from aerovox.session import scratch_path, store

LAST = 2**63 - 1  # stands for a null id, which comes after all others


class LineRuns:
    """The runs, as bucketed tables below the shared folder; their names live in this object."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fanout = fanout
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for runs in self.levels for name in runs]

    def unseen(self, keys: DataFrame) -> DataFrame:
        for run in self.tables():
            keys = keys.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, fresh: DataFrame) -> DataFrame:
        """Writes a run of level 0, merges full levels, returns the run as written."""
        name = self._write(fresh)
        written = self.spark.read.schema("h1 long, h2 long, owner long").parquet(self._paths[name])
        self._push(0, name)
        return written

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self._paths[name] = scratch_path(self.spark, "line-run")
        writer = run.select("h1", "h2", "owner").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", self._paths[name]).saveAsTable(name)
        return name

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.unionByName(self.spark.table(other))
            # Each run lacks what older runs hold, so hashes stay unique. One task per bucket.
            self._push(level + 1, self._write(merged.repartition(self.buckets, "h1", "h2")))
            for old in full:
                self.spark.sql(f"DROP TABLE {old}")

    def close(self) -> None:
        """Forgets the tables; their files stay in the shared folder until it is cleaned."""
        for runs in self.levels:
            for name in runs:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.trim(line, F.lit(SPACE_CHARS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(batch: DataFrame, runs: LineRuns, *, min_chars: int = 10) -> DataFrame:
    """Lines of ``batch`` (columns ``_id``, ``_t1``, ``_t2``, ``text``) that go, as positions from 0.

    A line goes if its key is long enough and an older run holds it or a smaller id of the batch
    does. The batch's new keys join the runs.
    """
    exploded = batch.select("_id", "_t1", "_t2", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = exploded.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    h1, h2 = two_hashes(F.col("key"))
    lines = store(keyed.select("_id", "_t1", "_t2", "pos", h1.alias("h1"), h2.alias("h2")), "lines")
    owners = lines.groupBy("h1", "h2").agg(F.min("_id").alias("owner"))
    fresh = runs.add(runs.unseen(owners))
    # The id takes part in the join, so a line that everybody has is spread over many tasks.
    return lines.join(fresh.withColumnRenamed("owner", "_id"), ["h1", "h2", "_id"], "left_anti").select(
        "_id", "_t1", "_t2", "pos"
    )


def dedup_lines(df: DataFrame, *, batches: int = 4, min_chars: int = 10, id_column: str = "doc_id") -> DataFrame:
    """``df`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Lines are parted by ``\\n``. A key (see ``line_key``) of at least ``min_chars`` characters that
    several documents hold keeps its lines in the document of the smallest id only; repeats inside
    that document stay. The table is read in ``batches`` ranges of ids, in their order.

    A null or empty text is one empty line. Rows with a null id count as one document behind all
    others, rows of the same id as one document. Columns of the input with one of the three names
    are replaced; an empty table gives an empty table.
    """
    spark = df.sparkSession
    ident, t1, t2 = (free_name(df, c) for c in ("_id", "_t1", "_t2"))
    h1, h2 = two_hashes(F.coalesce(F.col("text"), F.lit("")))
    docs = df.withColumns({ident: F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)), t1: h1, t2: h2})
    lean = docs.select(F.col(ident).alias("_id"), F.col(t1).alias("_t1"), F.col(t2).alias("_t2"), "text")
    cuts = []
    if batches > 1:
        shares = [i / batches for i in range(1, batches)]
        cuts = df.where(F.col(id_column).isNotNull()).approxQuantile(id_column, shares, 0.01)
    cuts = sorted({int(c) for c in cuts})
    runs = LineRuns(spark)
    gone = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = lean
        if low is not None:
            batch = batch.where(F.col("_id") > low)
        if high is not None:
            batch = batch.where(F.col("_id") <= high)
        gone.append(store(repeated_lines(batch, runs, min_chars=min_chars), "lines-gone"))
    runs.close()
    dropped = gone[0]
    for more in gone[1:]:
        dropped = dropped.unionByName(more)
    # A set, since rows that are alike in id and text report the same positions.
    marks = dropped.groupBy("_id", "_t1", "_t2").agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    gone_at = free_name(df, "_gone")
    marks = marks.select(*[F.col(c).alias(n) for c, n in zip(marks.columns, (ident, t1, t2, gone_at), strict=True)])
    lines = lines_of(F.col("text"))
    done = F.when(F.col(gone_at).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(
        _without(lines, F.col(gone_at))
    )
    added = ("kept_text", "n_lines", "n_dropped")
    return docs.join(marks, [ident, t1, t2], "left").select(
        *[c for c in df.columns if c.lower() not in added],
        done.alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` joined without those at the sorted positions ``gone``, in linear time."""
    runs = F.transform(
        gone,
        lambda p, i: F.concat(
            F.array_repeat(
                F.lit(True), p - F.when(i > 0, F.get(gone, i - 1)).otherwise(F.lit(-1)) - 1
            ),
            F.array(F.lit(False)),
        ),
    )
    rest = F.array_repeat(F.lit(True), F.size(lines) - F.element_at(gone, -1) - 1)
    stays = F.concat(F.flatten(runs), rest)
    return F.array_join(F.zip_with(lines, stays, lambda line, stay: F.when(stay, line)), "\n")
