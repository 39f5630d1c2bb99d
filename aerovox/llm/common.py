"""What several operators share: tables, white space, row keys, Arrow batch size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerovox.session import store

#: White space of every contract here: the six ASCII characters, nothing else.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What parts words where punctuation does, too: ASCII but for digits and small letters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bounds the text that one Arrow batch brings to a Python worker.

    A batch still holds one whole row at least, however long its text.
    """
    spark.conf.set(BATCH_BYTES, str(megabytes << 20))


def two_hashes(*columns: Column) -> list[Column]:
    """128 bits in two longs, from two differently seeded hashes."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(7919), *columns)]


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double")
    return (bits + F.lit(0.5)) * F.lit(2.0**-53)


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; 0 for null."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    return F.size(words).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def sample_rows(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``df``, chosen by a hash of the whole row and in its order.

    A first cut by the hash leaves few more rows than that, so hardly any are sorted or sent.
    """
    n = df.count()
    mark = free_name(df, "_mark")
    share = min(1.0, 1.3 * most / max(n, 1) + 100 / max(n, 1))
    marked = df.withColumn(mark, uniform(F.lit(17), F.xxhash64(*df.columns)))
    return marked.where(F.col(mark) < share).orderBy(mark).limit(most).drop(mark)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words_of(text: Column) -> Column:
    """The runs of letters (A-Z as a-z), digits and characters beyond ASCII, in order; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), "")


def places(df: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """``df`` with ``place``: the number, from 0, of each row among those of its ``group`` in ``order``.

    A sort by ranges spreads every group, however large, over tasks; what each range adds to a
    later one follows from a count per group and range. ``order`` should tell rows apart.
    """
    laid = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    laid = store(laid.withColumn("_at", F.monotonically_increasing_id()), "places")
    laid = laid.withColumn("_range", F.shiftright("_at", 33))
    runs = laid.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return laid.join(runs, [group, "_range"]).withColumn("place", place).drop("_at", "_range", "_first", "_before")
