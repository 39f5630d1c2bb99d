"""Resampling documents towards a target distribution, by importance weights of hashed n-grams.

Features of a document are its runs of 1 to ``max_n`` words, hashed into buckets. A bucket's gain is the
logarithm of its share in the target texts over its share in the documents; a document's weight is
the mean gain of its features. The highest weights plus Gumbel noise make a sample without
replacement whose distribution leans towards the target.

Line breaks part words, so a text is cut there into lines and every distinct line is looked at
once: its buckets count as often as it occurs, and its sum of gains goes to all documents that have
it. Runs of words that cross a line break are not in any line; they are found per document and
added on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovox.llm.common import places, two_hashes, words_of
from aerovox.session import store

#: A line with more than this share of all lines goes to the documents by broadcast: 1 / HOT of them at most.
HOT = 1e-4


@dataclass(frozen=True)
class Resampling:
    """``max_n`` words a feature, ``buckets`` of features, ``percent`` of the documents with at least
    ``least_words`` words drawn, ``seed`` of the noise."""

    max_n: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


def resample(docs: DataFrame, target: DataFrame, how: Resampling = Resampling(), *, id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, ``n_features``, ``weight``, ``score``, ``rank``, all long.

    ``rank`` counts from 1 by falling score, ties to the smaller id, a null id first, and is null for
    documents that are not drawn. A null text has no words, a document without features the weight
    0; its noise it gets all the same. A null id is hashed as ``-``. Repeated rows count, weigh and
    are drawn each by itself. Of an empty ``target`` all buckets have the same smoothed share. Empty
    ``docs`` give no rows. Only id and text are read, so other columns may have any name.
    """
    texts = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), texts.alias("text"))
    if how.max_n > 1:
        # Two results meet by the row's number, so it has to be the same in both.
        rows = store(rows, "numbered-texts")

    line = F.explode(F.split("text", "\n")).alias("line")
    lines = rows.select(line).groupBy(*_named(two_hashes(F.col("line")))).agg(
        F.count("*").alias("times"), F.first("line").alias("line")
    )
    lines = lines.withColumn("words", words_of(F.col("line")))
    words = F.col("words")
    lines = lines.select("h1", "h2", "times", F.size(words).cast("long").alias("n_words"), _buckets(words, how).alias("buckets"))
    lines = store(lines, "distinct-lines")

    counts = lines.select(F.explode("buckets").alias("bucket"), "times")
    crossing = None
    if how.max_n > 1:
        crossing = store(_crossing(rows, how), "crossing")
        counts = counts.unionByName(crossing.select(F.explode("buckets").alias("bucket"), F.lit(1).alias("times")))
    counts = counts.groupBy("bucket").agg(F.sum("times").alias("n"))
    wanted = target.select(words_of(F.col("text")).alias("words")).select(F.explode(_buckets(words, how)).alias("bucket"))
    gains = gain_literal(counts, wanted.groupBy("bucket").agg(F.count("*").alias("n")), how.buckets)

    def gained(buckets: Column) -> Column:
        return F.aggregate(buckets, F.lit(0).cast("long"), lambda total, b: total + F.get(gains, b))

    summed = lines.select(
        "h1", "h2", "times", "n_words", F.size("buckets").cast("long").alias("n"), gained(F.col("buckets")).alias("gain")
    )
    weighed = _of_documents(rows.select("row", "id", line), store(summed, "line-gains"))
    if crossing is not None:
        more = crossing.select("row", F.size("buckets").alias("_n"), gained(F.col("buckets")).alias("_gain"))
        weighed = weighed.join(more, "row", "left")
        weighed = weighed.withColumn("n", F.col("n") + F.coalesce("_n", F.lit(0)))
        weighed = weighed.withColumn("gain", F.col("gain") + F.coalesce("_gain", F.lit(0)))

    # Whole numbers throughout, so the mean is rounded down exactly.
    weight = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(0)
    scored = weighed.select(
        "row", "id", "n_words", F.col("n").alias("n_features"), weight.alias("weight"),
        (weight + gumbel(F.col("id"), how.seed)).alias("score"),
    )
    return _drawn(store(scored, "scored"), how).withColumnRenamed("id", id_column)


def gumbel(identity: Column, seed: str) -> Column:
    """A thousand times Gumbel noise, rounded down, that depends on the id and the seed alone."""
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("-")))
    h = F.conv(F.substring(F.sha2(mark.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def gain_literal(counts: DataFrame, wanted: DataFrame, buckets: int) -> Column:
    """The gain of every bucket as one array in the plan: as many numbers as there are buckets."""
    n, t = ({r.bucket: r.n for r in side.collect()} for side in (counts, wanted))
    total, target = sum(n.values()), sum(t.values())
    spark = counts.sparkSession
    both = spark.createDataFrame([(b, n.get(b, 0), t.get(b, 0)) for b in range(buckets)], "b int, s long, t long")

    def plus(count: Column, more: int) -> Column:
        return count.cast("double") + F.lit(float(more))

    odds = plus(F.col("t"), 1) * F.lit(float(total + buckets)) / (plus(F.col("s"), 1) * F.lit(float(target + buckets)))
    found = both.select("b", F.floor(F.lit(1000.0) * F.log(odds)).alias("gain")).orderBy("b").collect()
    return F.split(F.lit(",".join(str(r.gain) for r in found)), ",").cast("array<bigint>")


def _named(hashes: list[Column]) -> list[Column]:
    return [h.alias(f"h{i}") for i, h in enumerate(hashes, 1)]


def _bucket(feature: Column, how: Resampling) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(how.buckets)).cast("int")


def _run(words: Column, first: Column, k: int) -> Column:
    """``k`` words from number ``first`` on as one feature."""
    return F.concat_ws(" ", *[F.get(words, first + j) for j in range(k)])


def _buckets(words: Column, how: Resampling) -> Column:
    """Buckets of all runs of 1 to ``max_n`` of ``words``, repeats included. ``words`` has to be a column:
    an expression would be worked out anew for every run."""
    found = [F.transform(words, lambda w: _bucket(w, how))]
    for k in range(2, how.max_n + 1):
        found.append(F.transform(_starts(words, k), lambda i: _bucket(_run(words, i, k), how)))
    return F.concat(*found)


def _starts(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def _crossing(texts: DataFrame, how: Resampling) -> DataFrame:
    """``row`` and ``buckets``: the runs of 2 to ``max_n`` words whose first and last word are in different lines."""
    lines = texts.select("row", F.transform(F.split("text", "\n"), words_of).alias("lines"))
    numbers = F.flatten(F.transform("lines", lambda ws, i: F.array_repeat(i, F.size(ws))))
    flat = lines.select("row", F.flatten("lines").alias("words"), numbers.alias("of"))
    words, of = F.col("words"), F.col("of")
    found = []
    for k in range(2, how.max_n + 1):
        starts = F.filter(_starts(words, k), lambda i: F.get(of, i) != F.get(of, i + (k - 1)))
        found.append(F.transform(starts, lambda i: _bucket(_run(words, i, k), how)))
    # Written in between, or each word would be cut out of the text again for every run.
    flat = store(flat.where(F.array_max("of") > F.array_min("of")), "words-of-texts")
    return flat.select("row", F.concat(*found).alias("buckets")).where(F.size("buckets") > 0)


def _of_documents(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Sums over the lines of each document of ``n_words``, ``n`` and ``gain``.

    A line that very many documents have would be a hot key. There are at most 1 / HOT lines with
    more than that share of all, so these are broadcast; the others spread by their hash.
    """
    most = (lines.agg(F.sum("times")).first()[0] or 0) * HOT
    sums = ("n_words", "n", "gain")
    common = lines.where(F.col("times") > most).select("h1", "h2", *[F.col(c).alias(f"hot_{c}") for c in sums])
    kept = rows.select("row", "id", *_named(two_hashes(F.col("line")))).join(F.broadcast(common), ["h1", "h2"], "left")
    # What is already known needs no partner and goes anywhere.
    known = F.col("hot_n").isNotNull()
    kept = kept.withColumn("h1", F.when(known, F.xxhash64("row", "h1")).otherwise(F.col("h1")))
    met = kept.join(lines.where(F.col("times") <= most).select("h1", "h2", *sums), ["h1", "h2"], "left")
    return met.groupBy("row", "id").agg(*[F.sum(F.coalesce(f"hot_{c}", c)).alias(c) for c in sums])


def _drawn(scored: DataFrame, how: Resampling) -> DataFrame:
    """``rank`` for the highest scores among documents of enough words."""
    able = scored.where(F.col("n_words") >= how.least_words)
    most = able.count() * how.percent // 100
    falling = able.withColumn("_all", F.lit(0)).withColumn("_down", -F.col("score"))
    ranked = places(falling, "_all", "_down", "id", "row")
    ranked = ranked.where(F.col("place") < most).select("row", (F.col("place") + 1).alias("rank"))
    return scored.join(ranked, "row", "left").select("id", "n_features", "weight", "score", "rank")
