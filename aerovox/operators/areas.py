"""Positions in the boxes of a table, however many boxes there are.

The world is cut into cells on several levels, each half as wide as the one before. A box lies
in the level whose cells are about its size, so it touches a few of them; a position is in one cell
of each level that has boxes. Both meet on level and cell, and the limits decide.

Counts need no rows of pairs. Strips of boxes meet slices of aircraft, and a task compares ranks of
both in arrays; what it finds of each slice adds up, as every aircraft is in one. Small boxes have
few pairs and meet on cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovox.session import store

#: Cells of the last level are a thousandth of a degree wide.
LEVELS = 19

LIMITS = ("lamin", "lamax", "lomin", "lomax")


def _longitude(x: Column) -> Column:
    """What is beyond the world counts to its edge; the exact limits are compared later."""
    return F.greatest(F.lit(-181.0), F.least(F.lit(181.0), x))


def _latitude(y: Column) -> Column:
    return F.greatest(F.lit(-91.0), F.least(F.lit(91.0), y))


def _cell(x: Column, level: Column) -> Column:
    return F.floor((x + 181.0) * F.pow(F.lit(2.0), level) / 362.0)


def tag_areas(positions: DataFrame, boxes: DataFrame, *, area: str = "region") -> DataFrame:
    """One row per position and box that contains it, limits included: the position's columns and ``area``.

    ``boxes`` has ``area`` and the four limits; boxes may overlap, repeat or share a name, and each counts.
    One with a missing limit, or whose limits are the wrong way round, contains nothing, and a
    position with a missing coordinate is in none.
    """
    boxes = boxes.select(F.col(area).alias("_area"), *[F.col(c).cast("double").alias(f"_{c}") for c in LIMITS])
    boxes = boxes.where("_lamin <= _lamax AND _lomin <= _lomax")
    west, east = _longitude(F.col("_lomin")), _longitude(F.col("_lomax"))
    south, north = _latitude(F.col("_lamin")), _latitude(F.col("_lamax"))
    size = F.greatest(east - west, north - south)
    level = F.when(size > 0, F.floor(F.log2(F.lit(362.0) / size))).otherwise(LEVELS)
    boxes = boxes.withColumn("_level", F.least(F.lit(LEVELS), level).cast("int"))
    # One number a level; a position is looked up in these levels only.
    levels = [r[0] for r in boxes.select("_level").distinct().collect()]
    at = F.col("_level")
    cells = boxes.withColumn("_x", F.explode(F.sequence(_cell(west, at), _cell(east, at))))
    cells = cells.withColumn("_y", F.explode(F.sequence(_cell(south, at), _cell(north, at))))
    longitude, latitude = F.col("longitude"), F.col("latitude")
    known = positions.where(longitude.isNotNull() & latitude.isNotNull())
    known = known.withColumn("_level", F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>")))
    known = known.withColumns({"_x": _cell(_longitude(longitude), at), "_y": _cell(_latitude(latitude), at)})
    inside = latitude.between(F.col("_lamin"), F.col("_lamax")) & longitude.between(F.col("_lomin"), F.col("_lomax"))
    return known.join(cells, ["_level", "_x", "_y"]).where(inside).select(*positions.columns, F.col("_area").alias(area))


#: Boxes up to this size in degrees meet their positions on cells, larger ones in strips of this width at least.
SMALL = 362.0 / 2**6
#: Boxes of a name, and positions of an aircraft, from which they meet on cells whatever their size.
MANY_BOXES, MANY_POSITIONS = 1 << 10, 1 << 17
#: Boxes and positions that meet in a task at a time, about.
PART_BOXES, PART_POSITIONS = 1 << 13, 1 << 17
#: Positions of an aircraft from which it is compared by itself; at most 255.
OFTEN = 200
#: Boxes that are compared with the same positions, and comparisons made at a time, about.
BLOCK_BOXES, BLOCK = 1 << 10, 1 << 18


def area_counts(positions: DataFrame, boxes: DataFrame, *, area: str = "region") -> DataFrame:
    """Positions and aircraft per name of a box; names without positions are left out.

    A position counts once for each box of the name that contains it, an aircraft once for the name.
    """
    limits = [F.col(c).cast("double").alias(f"_{c}") for c in LIMITS]
    boxes = boxes.select(F.col(area).alias("_area"), *limits).where("_lamin <= _lamax AND _lomin <= _lomax")
    positions = positions.select("icao24", *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")])
    known = store(positions.where("latitude IS NOT NULL AND longitude IS NOT NULL"), "positions")

    west, east = _longitude(F.col("_lomin")), _longitude(F.col("_lomax"))
    size = F.greatest(east - west, _latitude(F.col("_lamax")) - _latitude(F.col("_lamin")))
    names = boxes.groupBy("_area").agg(
        F.min(west).alias("_west"), F.max(east).alias("_east"), F.max(size).alias("_size"), F.count("*").alias("_boxes")
    )
    names = store(names.withColumn("_name", F.monotonically_increasing_id()), "area-names")
    joined = boxes.join(names.withColumnRenamed("_area", "_of"), F.col("_area").eqNullSafe(F.col("_of")))
    named = store(joined.drop("_area", "_of"), "named-boxes")
    on_cells = (F.col("_size") <= SMALL) | (F.col("_boxes") > MANY_BOXES)
    wide = named.where(~on_cells)
    often = known.groupBy("icao24").agg(F.count("*").alias("_n")).where(F.col("_n") > MANY_POSITIONS)
    often = store(often.where("icao24 IS NOT NULL").select("icao24"), "frequent-aircraft")

    found = _met_on_cells(known, named.where(on_cells))
    if not often.isEmpty():
        found = found.unionByName(_met_on_cells(known.join(often, "icao24", "left_semi"), wide))
        known = known.join(often, "icao24", "left_anti")
    found = found.unionByName(_met_in_strips(known, wide))
    sums = found.groupBy("_name").agg(*[F.sum(c).alias(c) for c in ("num_events", "unique_aircraft")])
    return names.join(sums, "_name").select(F.col("_area").alias(area), "num_events", "unique_aircraft")


def _met_on_cells(positions: DataFrame, named: DataFrame) -> DataFrame:
    boxes = named.select("_name", *[F.col(f"_{c}").alias(c) for c in LIMITS])
    found = tag_areas(positions, boxes, area="_name").groupBy("_name")
    return found.agg(F.count("*").alias("num_events"), F.countDistinct("icao24").alias("unique_aircraft"))


def _met_in_strips(positions: DataFrame, named: DataFrame) -> DataFrame:
    """Counts per name and slice of aircraft. All boxes of a name are in one part, by the strip in which
    they begin; they reach into the next strip at most, so a position belongs to its own and the one before."""
    slices = -(-positions.count() // PART_POSITIONS) or 1
    width = F.col("_east") - F.col("_west")
    level = F.when(width > SMALL, F.floor(F.log2(F.lit(362.0) / width))).otherwise(6).cast("int")
    named = named.withColumn("_level", level).withColumn("_x", _cell(F.col("_west"), F.col("_level")))
    parts = named.groupBy("_level", "_x").agg(F.ceil(F.count("*") / PART_BOXES).alias("_parts"))
    parts = store(parts, "strips")
    # Names of several boxes stay together, so a part may have some more boxes.
    part = F.pmod(F.xxhash64("_name"), F.col("_parts"))
    own = ["_level", "_x", "_part", "_slice"]
    boxes = named.join(parts, ["_level", "_x"]).withColumn("_part", part)
    boxes = boxes.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    boxes = boxes.select(*own, "_name", *[f"_{c}" for c in LIMITS])
    levels = sorted(r[0] for r in parts.select("_level").distinct().collect())
    # A missing name is no aircraft; its positions may lie anywhere.
    by = F.when(F.col("icao24").isNull(), F.xxhash64("longitude", "latitude")).otherwise(F.xxhash64("icao24"))
    spots = positions.withColumn("_slice", F.pmod(by, F.lit(slices)).cast("int"))
    spots = spots.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    at = _cell(_longitude(F.col("longitude")), F.col("_level"))
    spots = spots.withColumn("_x", F.explode(F.array(at, at - 1))).join(parts, ["_level", "_x"])
    spots = spots.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    spots = spots.select(*own, "icao24", "latitude", "longitude")
    met = boxes.groupBy(*own).cogroup(spots.groupBy(*own))
    return met.applyInArrow(_counted, "_name long, num_events long, unique_aircraft long")


def _ranks(spots: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of positions, the lowest that a box contains and how many it does; NaN is the largest number."""
    order = np.sort(spots)
    kind = np.uint16 if len(order) < 1 << 16 else np.uint32
    first, after = np.searchsorted(order, low, "left"), np.searchsorted(order, high, "right")
    some = np.maximum(after - first, 0)
    return np.searchsorted(order, spots, "left").astype(kind), first.astype(kind), some.astype(kind)


class _Room:
    """Arrays that comparisons use again and again."""

    def __init__(self, kind: np.dtype) -> None:
        self.kind, self.size = kind, 0

    def inside(self, spots: tuple, boxes: tuple) -> np.ndarray:
        """Which position (row) is in which box; valid until the next call."""
        (x, y), (x0, nx, y0, ny) = [v[:, None] for v in spots], boxes
        shape, n = (len(x), len(x0)), len(x0) * len(x)
        if n > self.size:
            self.size, self.gap, self.both = n, np.empty(n, self.kind), (np.empty(n, bool), np.empty(n, bool))
        gap, (a, b) = self.gap[:n].reshape(shape), (m[:n].reshape(shape) for m in self.both)
        # An unsigned difference below zero is a large number.
        np.less(np.subtract(x, x0, out=gap), nx, out=a)
        np.less(np.subtract(y, y0, out=gap), ny, out=b)
        return np.logical_and(a, b, out=a)


def _counted(boxes: pa.Table, spots: pa.Table) -> pa.Table:
    """Positions in the boxes of each name, and the aircraft that these are of."""
    name = boxes["_name"].to_numpy()
    if not len(name) or not spots.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("_name", "num_events", "unique_aircraft")})
    limit = {c: boxes[f"_{c}"].to_numpy() for c in LIMITS}
    x, x0, nx = _ranks(spots["longitude"].to_numpy(), limit["lomin"], limit["lomax"])
    y, y0, ny = _ranks(spots["latitude"].to_numpy(), limit["lamin"], limit["lamax"])
    codes = spots["icao24"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    # Names of about one height and latitude side by side, so that a block of them leaves out most positions.
    names, of = np.unique(name, return_inverse=True)
    south, north = np.full(len(names), len(y)), np.zeros(len(names), np.int64)
    np.minimum.at(south, of, y0)
    np.maximum.at(north, of, y0.astype(np.int64) + ny)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((south, np.frexp(np.maximum(north - south, 0))[1]))] = np.arange(len(names))
    order = np.argsort(rank[of], kind="stable")
    edges = np.flatnonzero(np.diff(rank[of][order], prepend=-1))
    hits, aircraft = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    room, first = _Room(x.dtype), 0
    while first < len(edges):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + BLOCK_BOXES, "right")) - 1)
        last = len(edges) if edges[first] + BLOCK_BOXES >= len(order) else last
        some = order[edges[first] : edges[last] if last < len(edges) else len(order)]
        own = of[some[edges[first:last] - edges[first]]]
        near = np.flatnonzero((y >= south[own].min()) & (y < north[own].max()))
        box = tuple(v[some] for v in (x0, nx, y0, ny))
        hits[own], aircraft[own] = _block((x[near], y[near]), codes[near], box, edges[first:last] - edges[first], room)
        first = last
    some = hits > 0
    return pa.table({"_name": names[some], "num_events": hits[some], "unique_aircraft": aircraft[some]})


def _block(
    spots: tuple, codes: np.ndarray, boxes: tuple, edges: np.ndarray, room: _Room
) -> tuple[np.ndarray, np.ndarray]:
    """Counts per name; ``edges`` are the first boxes of the names."""
    hits, aircraft = np.zeros(len(boxes[0]), np.int64), np.zeros(len(edges), np.int64)
    present, of, count = np.unique(codes, return_inverse=True, return_counts=True)
    alone = (present < 0) | (count > OFTEN)
    # The aircraft by falling counts, so that those with a position more are the first ones of any run.
    by = np.argsort(np.where(alone, 0, -count), kind="stable")
    rank = np.empty(len(present), np.int64)
    rank[by] = np.arange(len(present))
    grouped = np.argsort(rank[of], kind="stable")
    spots = tuple(v[grouped] for v in spots)
    count, starts = count[by], np.concatenate([[0], np.cumsum(count[by])])
    most, step = len(present) - int(alone.sum()), max(1, BLOCK // len(hits))
    for a in range(0, most, step):
        each, at = count[a : min(a + step, most)], starts[a : min(a + step, most)]
        times = np.zeros((len(each), len(hits)), np.uint8)
        for turn in range(int(each[0])):
            n = int(np.searchsorted(-each, -turn, "left"))
            times[:n] += room.inside(tuple(v[at[:n] + turn] for v in spots), boxes).view(np.uint8)
        hits += times.sum(axis=0, dtype=np.int64)
        whole = times if len(edges) == len(hits) else np.maximum.reduceat(times, edges, axis=1)
        aircraft += np.count_nonzero(whole, axis=0)
    for a in range(most, len(present)):
        each = np.zeros(len(hits), np.int64)
        for low in range(int(starts[a]), int(starts[a + 1]), step):
            high = min(low + step, int(starts[a + 1]))
            each += np.count_nonzero(room.inside(tuple(v[low:high] for v in spots), boxes), axis=0)
        hits += each
        if present[by[a]] >= 0:
            aircraft += np.add.reduceat(each, edges) > 0
    return np.add.reduceat(hits, edges), aircraft
