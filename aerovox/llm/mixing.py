"""Mixing sources to target weights: whole copies first, the rest by Pareto order sampling.

A document's expected number of copies is whole copies plus a fraction. The whole copies are
certain. The fraction is its inclusion probability p in a sample of fixed size: with a uniform u,
documents rank by the odds of u divided by the odds of p, and the lowest are taken until the words
that their source still lacks are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerovox.llm.common import uniform, word_count
from aerovox.session import store

#: Ranks are located by two histograms of this many cells each before any rows are sorted.
CELLS = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``, the words that each source gives.

    Sources in the order of their code points, null last, take ``weights`` in turn and divide
    ``share`` times all words by them. No target is above ``most`` times its source; what is cut
    is divided among the others by weight until all fit. A source without words gets 0.

    The sources are rows of one window, so there have to be fewer than a task can hold.
    """
    every = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    df = sizes.select("source", "source_size", of.alias("w"))
    # A source is full if the level (words per weight) is at least its bound over its weight.
    # Sources sorted by that ratio fill up in this order, so one pass finds the level.
    bound = F.col("source_size") * float(most)
    df = df.withColumns({"bound": bound, "ratio": bound / F.col("w")})
    order = every.orderBy("ratio", F.col("source").isNull(), "source")
    behind = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    words = F.sum("source_size").over(every) * float(share)
    left = words - F.coalesce(F.sum("bound").over(ahead), F.lit(0.0))
    df = df.withColumn("level", left / F.sum("w").over(behind))
    full = F.col("level") >= F.col("ratio")
    first_open = F.max(F.when(~full, F.col("level"))).over(every)
    # The level found at the first source that stays open, which is the highest, holds for all.
    df = df.withColumn("open_level", F.coalesce(first_open, F.lit(float("inf"))))
    target = F.when(full, F.col("bound")).otherwise(F.least(F.col("bound"), F.col("w") * F.col("open_level")))
    return df.select("source", "source_size", target.alias("target"))


def mix_sources(
    df: DataFrame,
    *,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 9,
    importance: Column | None = None,
    size: Column | None = None,
    id_column: str = "doc_id",
) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` and ``copies`` of every document.

    ``importance`` (positive; the same for all if not given) makes the expected copies of a
    document, and with them its inclusion probability, proportional to it within its source.
    ``size`` replaces the number of words of ``text``. No document gets more than ``most`` copies. The words taken from a source miss its target by
    less than half a document, unless all its documents are at their bound.

    A null text has size 0 and never more than its certain copies; null ids and sources are
    values like any other. Rows that are alike in everything may change places. Columns of the
    input with one of the four names are replaced, others may have any name; an empty table gives an
    empty table.
    """
    size = word_count(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    row = "row"
    mark = F.xxhash64(F.lit(seed), F.col(id_column), F.xxhash64(*df.columns))
    worth = F.lit(1.0) if importance is None else importance.cast("double")
    added = ("size", "source_size", "target", "copies")
    kept = [c for c in df.columns if c.lower() not in added]
    # Columns of the input go by number, so that none is called like one of those added here. The row
    # number is kept with the row, so that no rerun can deal it anew.
    held = df.select(
        F.monotonically_increasing_id().alias(row),
        F.col("source").alias("source"),
        size.alias("size"),
        worth.alias("worth"),
        mark.alias("mark"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)],
    )
    held = store(held, "mix-rows")
    lean = held.select(row, "source", "size", "worth", "mark")
    sums = lean.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("worth")).alias("worth_size")
    )
    sums = store(sums, "mix-sources")
    targets = source_targets(sums, weights, share, most).join(
        sums.select(F.col("source").alias("_s"), "worth_size"), F.col("source").eqNullSafe(F.col("_s"))
    )
    targets = store(targets.drop("_s"), "mix-targets")

    docs = _with_source(lean, targets)
    expected = F.when(
        F.col("worth_size") > 0, F.col("target") * F.col("worth") / F.col("worth_size")
    ).otherwise(F.lit(0.0))
    docs = docs.withColumn("expected", F.least(F.lit(float(most)), expected))
    # 1e-9: what is whole but for rounding is whole.
    whole = F.floor(F.col("expected") + 1e-9).cast("int")
    docs = docs.withColumns({"whole": whole, "p": F.greatest(F.lit(0.0), F.col("expected") - whole)})
    u = uniform(F.lit(seed), F.col("mark"))
    odds = (u / (1 - u)) * (1 - F.col("p")) / F.col("p")
    rank = F.when(F.col("p") > 1e-9, odds / (1 + odds)).otherwise(F.lit(None).cast("double"))
    docs = store(docs.select(row, "source", "size", "whole", "mark", "target", rank.alias("rank")), "mix-ranks")

    taken = _lowest_ranks(docs, row)
    decided = docs.select(row, "whole").join(taken.select(row, F.lit(1).alias("extra")), row, "left")
    copies = (F.col("whole") + F.coalesce(F.col("extra"), F.lit(0))).alias("copies")
    sized = _with_source(held, targets.select("source", "source_size", "target"))
    return sized.join(decided.select(row, copies), row).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *added
    )


def _with_source(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds what is known of a row's source; there are few sources, one row each."""
    return df.join(
        targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left"
    ).drop("_s")


def _lowest_ranks(docs: DataFrame, row: str) -> DataFrame:
    """Documents of the lowest ranks of each source, as long as its missing words allow, and one.

    A histogram of the ranks tells the cell in which the words run out, a second one divides that
    cell again; only what is left in that small cell is sorted.
    """
    lacking = docs.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("size") * F.col("whole"))).alias("lacks")
    )
    ranked = docs.where(F.col("rank").isNotNull() & (F.col("size") > 0))
    fine = F.floor(F.col("rank") * (CELLS * CELLS)).cast("long")
    ranked = ranked.withColumn("fine", F.least(fine, F.lit(CELLS * CELLS - 1))).withColumn(
        "cell", F.floor(F.col("fine") / CELLS).cast("long")
    )
    edge = store(_edge(ranked, "cell", lacking), "mix-cells")
    inside = _join_source(ranked, edge.select("source", F.col("cell").alias("at"), "lacks"))
    inner = inside.where(F.col("cell") == F.col("at"))
    edges = _edge(inner.drop("at", "lacks"), "fine", edge.select("source", "lacks"))
    edges = store(
        edge.select("source", "cell").join(
            edges.select(F.col("source").alias("_s"), "fine", "lacks"), F.col("source").eqNullSafe(F.col("_s"))
        ).select("source", F.col("fine").alias("edge"), "lacks"),
        "mix-edges",
    )
    at = _join_source(ranked, edges)
    order = Window.partitionBy("source").orderBy("rank", "mark", row)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.col("before") + F.col("size") <= F.col("lacks")
    last = at.where(F.col("fine") == F.col("edge")).withColumn("before", before).withColumn("fits", fits)
    last = store(last.drop("before"), "mix-last")
    taken = at.where(F.col("fine") < F.col("edge")).select(row).unionByName(last.where("fits").select(row))

    # What is left is less than the next document. The one whose size comes nearest closes the gap.
    used = F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))
    rest = last.groupBy("source").agg((F.max("lacks") - used).alias("rest"))
    others = at.where(F.col("fine") > F.col("edge")).unionByName(last.where(~F.col("fits")).drop("fits"))
    off = F.abs(F.col("size") - F.col("rest"))
    near = _join_source(others, rest).where(off < F.col("rest"))
    best = near.groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "mark", F.col(row).alias("row"))).alias("b"))
    return taken.unionByName(best.select(F.col("b.row").alias(row)))


def _edge(ranked: DataFrame, cell: str, lacking: DataFrame) -> DataFrame:
    """The cell of each source in which its missing words run out (or its last), and what is
    still missing when that cell begins."""
    sums = ranked.groupBy("source", cell).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(cell)
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = _join_source(sums.withColumn("before", before), lacking)
    reached = sums.where(F.col("before") < F.col("lacks"))
    return reached.groupBy("source").agg(
        F.max(cell).alias(cell), F.max_by(F.col("lacks") - F.col("before"), cell).alias("lacks")
    )


def _join_source(df: DataFrame, by_source: DataFrame) -> DataFrame:
    return df.join(by_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
