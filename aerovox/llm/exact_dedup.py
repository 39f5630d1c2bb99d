"""Exact duplicates by recipes: ordered lists of identifiers of content-defined chunks.

A text is cut where a rolling hash of its last 32 bytes says so, so equal passages give equal
chunks wherever they stand. A chunk's identifier is a 64-bit hash and, where chunks of different
content share it, a number that tells them apart; SHA-256 of the content decides that. Two texts
are equal if their lists are. Texts themselves never move: identifiers and digests do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from aerovox.llm.common import SPACE, small_batches
from aerovox.session import store

WINDOW = 32
LEAST, MEAN_BITS, MOST = 256, 10, 8192  # bytes of a chunk; the mean is LEAST + 2 ** MEAN_BITS
#: Bytes whose rolling hashes are in memory at a time.
BLOCK = 1 << 20

_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def normalised(text: Column) -> Column:
    """Null as empty; every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def cut_points(data: bytes) -> np.ndarray:
    """Ends of the chunks of ``data``, the last being its length; one chunk of 0 if it is empty."""
    n = len(data)
    if n <= LEAST:
        return np.array([n], dtype=np.int32)
    ends, start = [], 0
    for at in _marks(np.frombuffer(data, dtype=np.uint8)):
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST:
            ends.append(at)
            start = at
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return np.array(ends, dtype=np.int32)


def _marks(data: np.ndarray) -> Iterator[int]:
    """Positions after which the rolling hash allows a cut, by blocks."""
    for low in range(0, len(data), BLOCK):
        first = max(0, low - WINDOW + 1)
        h = _GEAR[data[first : low + BLOCK]]
        for k in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes
            grown = h.copy()
            grown[k:] += h[:-k] << np.uint32(k)
            h = grown
        found = np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + first + 1
        yield from found[found > max(low, WINDOW)].tolist()


@F.pandas_udf(ArrayType(IntegerType()))
def _cuts(text: pd.Series) -> pd.Series:
    return text.map(lambda t: cut_points(t.encode("utf-8", "surrogatepass")))


def chunk_recipes(df: DataFrame) -> DataFrame:
    """``df`` (with ``norm``) with ``chunks``: hash and digest of each chunk, in order."""
    data = F.col("norm").cast("binary")

    def chunk(end: Column, i: Column) -> Column:
        start = F.when(i > 0, F.get("_ends", i - 1)).otherwise(F.lit(0))
        # On bytes this copies the chunk alone.
        part = data.substr(start + 1, end - start)
        return F.transform(
            F.array(part), lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("d"))
        )[0]

    return df.withColumn("_ends", _cuts("norm")).withColumn("chunks", F.transform("_ends", chunk)).drop("_ends")


def exact_duplicates(df: DataFrame, *, carry: tuple[str, ...] = (), id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``carry``.

    Texts are equal if they are after ``normalised``. Of equal ones the row with the smallest id
    stays, a null id counting as the largest; of rows that are alike in id and text exactly one.
    Null and empty texts are equal to each other and make a group like any other. A carried column
    called like one of the four added is left out, others may have any name. An empty table gives an
    empty table.
    """
    small_batches(df.sparkSession)
    row, added = "_row", ("keep_id", "group_size", "kept", "text_sha256")
    # Columns of the input go by number, so that none is called like one of those added here.
    carry = tuple(c for c in carry if c != id_column and c.lower() not in added)
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = df.select(
        F.monotonically_increasing_id().alias(row), F.col(id_column).alias("id"), *carried, normalised(F.col("text")).alias("norm")
    )
    rows = chunk_recipes(rows).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    # Written once: the row numbers must not change and the chunks are read three times.
    held = store(rows.drop("norm"), "recipes")

    chunks = held.select(row, F.posexplode("chunks").alias("pos", "c")).select(row, "pos", "c.h", "c.d")
    shared = (
        chunks.select("h", "d")
        .distinct()
        .groupBy("h")
        .agg(F.sort_array(F.collect_set("d")).alias("all"))
        .where(F.size("all") > 1)
    )
    told = shared.select("h", F.posexplode("all").alias("number", "d"))
    ids = chunks.join(told, ["h", "d"], "left").groupBy(row).agg(
        F.sort_array(F.collect_list(F.struct("pos", "h", F.coalesce("number", F.lit(0)).alias("number")))).alias("ids")
    )
    ids = ids.select(row, F.transform("ids", lambda x: F.struct(x["h"].alias("h"), x["number"].alias("n"))).alias("ids"))
    recipes = held.select(row, "id").join(ids, row)
    recipes = store(recipes, "recipe-ids")
    groups = recipes.groupBy("ids").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(row).alias("row"))).alias("best"),
    )
    decided = recipes.select(row, "ids").join(groups, "ids").select(
        row,
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col(row)).alias("kept"),
    )
    return held.drop("chunks").join(decided, row).select(
        F.col("id").alias(id_column), *added, *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    )
