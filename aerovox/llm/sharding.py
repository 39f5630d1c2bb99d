"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows of every input partition are permuted, cut into runs whose lengths come from the matrix
(row: partition, column: shard), sent to the shards and permuted there again. The matrix follows
the law that a uniform permutation of all rows would induce, so the result is one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerovox.session import store

#: Rows of one sorting bucket inside a shard, on average.
BUCKET_ROWS = 2048
#: Standard deviations around the mode within which a draw is searched. What lies outside has a
#: weight below 1e-30, which no double between 0 and 1 can tell from 0.
REACH = 12


def shuffle_into_shards(df: DataFrame, shards: int, *, key: str = "doc_id", seed: int = 1) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... within the shard).

    The sizes of the shards differ by one row at most. Depends on the rows of each input
    partition, ``seed`` and ``shards`` alone, so a rerun over the same files agrees.

    Null and repeated keys are allowed: rows that are alike in all columns may change places. An
    empty table gives an empty table. Columns ``shard`` and ``slot`` of the input are replaced, others may
    have any name.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = df.sparkSession
    names = df.drop("shard", "slot").columns
    # Columns of the input go by number, so that none is called like one of those added here.
    df = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    part, at, mark = "_part", "_at", "_mark"
    placed = (
        df.withColumn(mark, F.xxhash64(F.lit(seed), F.col(f"c{names.index(key)}"), F.xxhash64(*df.columns)))
        .withColumn(part, F.spark_partition_id())
        .sortWithinPartitions(mark)
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = store(placed, "shard-local")
    counts = store(placed.groupBy(part).agg(F.count("*").alias("n")), "shard-counts")
    parts, rows = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    matrix = communication_matrix(counts, part, parts, rows, shards, seed)

    # A partition's rows keep their order, so a run of positions goes to each shard.
    sent = placed.join(matrix, part).withColumn(
        "shard", F.size(F.filter("_ends", lambda end: end <= F.col(at)))
    )
    bits = max(0, math.ceil(math.log2(max(1, rows / shards / BUCKET_ROWS))))
    bucket = F.shiftrightunsigned(F.col("_key"), 64 - bits) if bits else F.lit(0).cast("long")
    sent = sent.withColumn("_key", F.xxhash64(F.lit(seed + 1), F.col(mark))).withColumn("_bucket", bucket)
    starts = _starts(sent.groupBy("shard", "_bucket").agg(F.count("*").alias("n")))
    order = Window.partitionBy("shard", "_bucket").orderBy("_key", mark)
    return (
        sent.withColumn("_rank", F.row_number().over(order).cast("long"))
        .join(starts, ["shard", "_bucket"])
        .select(
            *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
            "shard",
            (F.col("_start") + F.col("_rank") - 1).alias("slot"),
        )
    )


def _starts(counts: DataFrame) -> DataFrame:
    """First slot of every bucket of a shard."""
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))


def communication_matrix(
    counts: DataFrame, part: str, parts: int, rows: int, shards: int, seed: int
) -> DataFrame:
    """For every partition the array ``_ends``: where in its rows the run of each shard ends.

    The partitions are halved again and again. In each step the rows that every shard still
    expects from a range of partitions are divided between its halves by multivariate
    hypergeometric draws, so rows and columns always add up.
    """
    spark = counts.sparkSession
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    nodes = counts.agg(F.sort_array(F.collect_list(F.struct(F.col(part).alias("p"), "n"))).alias("ps")).select(
        F.lit(0).cast("long").alias("node"), "ps", F.array(*[F.lit(s).cast("long") for s in sizes]).alias("due")
    )
    for level in range(max(0, math.ceil(math.log2(max(1, parts))))):
        half = F.ceil(F.size("ps") / 2).cast("int")
        left = F.slice("ps", 1, half)
        nodes = nodes.select("node", "due", left.alias("l"), F.slice("ps", half + 1, F.size("ps")).alias("r"))
        draws = F.aggregate(F.col("l"), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        total = draws + F.aggregate(F.col("r"), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        nodes = nodes.withColumns({"k": draws, "t": total})
        chance = [F.lit(seed), F.lit(level), F.col("node")]
        nodes = nodes.withColumn("went", _multivariate(F.col("due"), F.col("t"), F.col("k"), chance))
        one = F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("ps"), F.col("went").alias("due"))
        other = F.struct(
            (F.col("node") * 2 + 1).alias("node"),
            F.col("r").alias("ps"),
            F.zip_with("due", "went", lambda a, b: a - b).alias("due"),
        )
        nodes = nodes.select(F.explode(F.array(one, other)).alias("x")).select("x.*").where(F.size("ps") > 0)
        if level % 6 == 5:  # enough nodes by now to spread the draws
            nodes = nodes.repartition("node")
    runs = F.aggregate(
        F.col("due"),
        F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out")
        ),
        lambda acc: acc["out"],
    )
    return nodes.where(F.size("ps") > 0).select(F.get("ps", F.lit(0))["p"].alias(part), runs.alias("_ends"))


def _multivariate(due: Column, total: Column, draws: Column, chance: list[Column]) -> Column:
    """How many of ``draws`` rows out of ``total`` go to each shard, of which each is due some."""
    start = F.struct(
        F.lit(0).alias("s"), total.alias("t"), draws.alias("k"), F.array().cast("array<bigint>").alias("out")
    )

    def step(acc: Column, wanted: Column) -> Column:
        shift = F.shiftrightunsigned(F.xxhash64(*chance, acc["s"]), 11).cast("double")
        u = (shift + F.lit(0.5)) * F.lit(2.0**-53)
        x = hypergeometric(acc["t"], wanted, acc["k"], u)
        # ``x`` is a costly expression: a one-element array evaluates it once.
        return F.transform(
            F.array(x),
            lambda got: F.struct(
                (acc["s"] + 1).alias("s"),
                (acc["t"] - wanted).alias("t"),
                (acc["k"] - got).alias("k"),
                F.concat(acc["out"], F.array(got)).alias("out"),
            ),
        )[0]

    return F.aggregate(due, start, step, lambda acc: acc["out"])


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows out of ``total`` are among the ``marked`` ones, for a uniform ``u``.

    By inversion: weights relative to the mode follow from one another upwards and downwards, so
    no factorials are needed and the range that is summed is a few standard deviations wide.
    """
    n, m, k = (c.cast("double") for c in (total, marked, draws))
    low = F.greatest(F.lit(0).cast("long"), draws + marked - total)
    high = F.least(draws, marked)
    mode = F.least(high, F.greatest(low, F.floor((k + 1) * (m + 1) / (n + 2)).cast("long")))
    spread = F.sqrt(k * m / F.greatest(n, F.lit(1.0)) * (n - m) / F.greatest(n, F.lit(1.0)) + 1)
    reach = (F.ceil(spread * REACH) + 60).cast("long")
    bounds = F.struct(
        mode.alias("mode"),
        F.least(high, mode + reach).alias("high"),
        F.greatest(low, mode - reach).alias("low"),
    )

    def pick(b: Column) -> Column:
        none = F.array().cast("array<bigint>")
        up = F.when(b["high"] > b["mode"], F.sequence(b["mode"] + 1, b["high"])).otherwise(none)
        down = F.when(b["low"] < b["mode"], F.sequence(b["mode"] - 1, b["low"])).otherwise(none)
        # Going up to x multiplies the weight by this; going down to x divides by that of x + 1.
        gain = lambda x: ((m - x + 1) * (k - x + 1)) / (x * (n - m - k + x))
        upwards = lambda w, x: w * gain(x.cast("double"))
        downwards = lambda w, x: w / gain(x.cast("double") + 1)

        def add(step):  # noqa: ANN001, ANN202
            return lambda acc, x: F.transform(
                F.array(step(acc["w"], x)), lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"))
            )[0]

        first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        whole = (
            F.aggregate(up, first, add(upwards), lambda a: a["sum"])
            + F.aggregate(down, first, add(downwards), lambda a: a["sum"])
            + 1.0
        )

        def find(step):  # noqa: ANN001, ANN202
            def next_one(acc: Column, x: Column) -> Column:
                return F.transform(
                    F.array(step(acc["w"], x)),
                    lambda w: F.struct(
                        w.alias("w"),
                        (acc["left"] - w).alias("left"),
                        F.when((acc["left"] > 0) & (acc["left"] <= w), x).otherwise(acc["x"]).alias("x"),
                    ),
                )[0]

            return next_one

        def search(target: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), (target - 1.0).alias("left"), b["mode"].alias("x"))
            after = F.aggregate(up, start, find(upwards))
            again = F.transform(
                F.array(after),
                lambda a: F.struct(F.lit(1.0).alias("w"), a["left"].alias("left"), a["x"].alias("x")),
            )[0]
            return F.aggregate(down, again, find(downwards), lambda a: a["x"])

        return F.transform(F.array(u * whole), search)[0]

    return F.transform(F.array(bounds), pick)[0]
