"""Document fingerprints from prefix polynomial hashes.

For a text the hashes of all its prefixes are kept as arrays modulo two primes. A difference of two
entries is the hash of a span, so any two spans compare in constant time, and binary search finds
how far two texts agree from two positions on. A fingerprint keeps some prefix hashes only: those
at up to 32 equally spaced lengths, those that give the same spans counted from the end, and those at
up to 64 places that the text around them chooses, wherever it stands. Differences of these are the
hashes of the spans in between, so two fingerprints tell common spans in the middle, moved ones too.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerovox.llm.common import small_batches

#: Two primes below 2**31, so that products fit in 64 bits, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1_000_003_397, 911_382_323)
#: Spans of a fingerprint, at most.
CELLS = 32
#: Code points that choose a mark, marks of a fingerprint at most, and code points that a common span
#: has at least unless it begins or ends both texts.
WINDOW, MARKS, LEAST = 16, 64, 8
#: Code points whose hashes are computed at a time.
BLOCK = 1 << 18

_powers = [np.ones(1, dtype=np.int64) for _ in PRIMES]


def _powers_up_to(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the bases; the tables double when they are too short."""
    for k, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
        while len(_powers[k]) <= n:
            have = _powers[k]
            step = int(have[-1]) * base % prime
            _powers[k] = np.concatenate([have, have * step % prime])
    return _powers


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Prefixes:
    """Prefix hashes of one text: entry i is the sum of code point j + 1 times base to the j, j < i."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        powers = _powers_up_to(self.n)
        self.sums = []
        for prime, power in zip(PRIMES, powers, strict=True):
            out = np.zeros(self.n + 1, dtype=np.int64)
            for low in range(0, self.n, BLOCK):
                part = (points[low : low + BLOCK].astype(np.int64) + 1) * power[low : low + len(points[low : low + BLOCK])]
                np.cumsum(part % prime, out=out[low + 1 : low + 1 + len(part)])
                out[low + 1 : low + 1 + len(part)] += out[low]
                out[low + 1 : low + 1 + len(part)] %= prime
            self.sums.append(out)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the spans that do not depend on where they stand, as unsigned numbers."""
        both = []
        for prime, sums, k in zip(PRIMES, self.sums, range(len(PRIMES)), strict=True):
            down = _inverse_powers(k, starts)
            both.append((sums[ends] - sums[starts]) % prime * down % prime)
        return both[0].astype(np.uint64) << np.uint64(31) | both[1].astype(np.uint64)

    def equal(self, start: int, other: Prefixes, at: int, length: int) -> bool:
        """Whether ``length`` code points from ``start`` equal those of ``other`` from ``at``."""
        for prime, power, a, b in zip(PRIMES, _powers_up_to(max(start, at)), self.sums, other.sums, strict=True):
            x = int(a[start + length] - a[start]) * int(power[at]) % prime
            y = int(b[at + length] - b[at]) * int(power[start]) % prime
            if x != y:
                return False
        return True

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """How many code points the texts share from the two positions on."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low


_inverses: list[dict[int, int]] = [{}, {}]


def _inverse_powers(k: int, starts: np.ndarray) -> np.ndarray:
    memory, prime = _inverses[k], PRIMES[k]
    if len(memory) > 100_000:
        memory.clear()
    out = []
    for s in starts.tolist():
        if s not in memory:
            memory[s] = pow(int(_powers_up_to(s)[k][s]), prime - 2, prime)
        out.append(memory[s])
    return np.array(out, dtype=np.int64)


_inverse_tables = [np.ones(1, dtype=np.int64)]


def _inverses_up_to(n: int) -> np.ndarray:
    """Powers 0 to n of the inverse of the first base."""
    prime, inverse = PRIMES[0], pow(BASES[0], -1, PRIMES[0])
    while len(_inverse_tables[0]) <= n:
        have = _inverse_tables[0]
        step = int(have[-1]) * inverse % prime
        _inverse_tables[0] = np.concatenate([have, have * step % prime])
    return _inverse_tables[0]


def _chosen(p: Prefixes) -> tuple[np.ndarray, np.ndarray, int]:
    """Places whose following window has a hash below 2**31 >> level, those hashes, and the level: the
    lowest that leaves ``MARKS`` places. So the marks of a higher level are some of those of a lower."""
    if p.n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    sums, at = p.sums[0], np.arange(p.n - WINDOW + 1)
    hashes = (sums[WINDOW:] - sums[: len(at)]) % PRIMES[0] * _inverses_up_to(len(at))[: len(at)] % PRIMES[0]
    # Marks are twice ``LEAST`` apart or more on average, so most spans are long enough to count.
    level = max((2 * LEAST).bit_length() - 1, math.ceil(math.log2(len(at) / MARKS)))
    while True:
        at = at[hashes[at] < (1 << 31) >> level]
        if len(at) <= MARKS:
            return at, hashes[at], level
        level += 1


def step_of(n: int) -> int:
    """Width of the spans of a fingerprint: a power of two, so that the marks of a coarse grid are
    marks of every finer one."""
    return 1 << max(0, math.ceil(math.log2(max(n, 1) / CELLS)))


def fingerprint(text: str) -> str:
    """Length, hash of the whole, hashes of the first 1, 2, ... and of the last 1, 2, ... spans, level,
    and places, hashes of windows and of prefixes of the marks that the content chooses."""
    p = Prefixes(code_points(text))
    step = step_of(p.n)
    lengths = np.arange(step, p.n + 1, step)
    zero = np.zeros(len(lengths), dtype=np.int64)
    whole = p.spans(np.zeros(1, np.int64), np.array([p.n]))
    front = p.spans(zero, lengths)
    back = p.spans(p.n - lengths, zero + p.n)
    at, windows, level = _chosen(p)
    upto = p.spans(np.zeros(len(at), np.int64), at)
    data = np.concatenate([whole, front, back, *(x.astype(np.uint64) for x in (np.array([level]), at, windows, upto))])
    return f"{p.n}:{base64.b64encode(data.astype('<u8').tobytes()).decode()}"


def likeness(a: str, b: str) -> float:
    """Share of two texts, from 0 to 1, that they have in common: a beginning, an end, spans at the
    same distance from either, and spans between marks that the content chooses, wherever they stand.

    From the fingerprints alone, so lengths are known to a span of the coarser grid. Equal texts
    have 1; two empty ones are equal, an empty and another one have 0.
    """
    (n, x), (m, y) = _parsed(a), _parsed(b)
    if n == m and x[0] == y[0]:
        return 1.0
    if not n or not m:
        return 0.0
    step = max(step_of(n), step_of(m))
    k, j = n // step_of(n), m // step_of(m)
    every, each = step // step_of(n), step // step_of(m)
    covered = [np.zeros(n, dtype=bool), np.zeros(m, dtype=bool)]
    for low, high in _runs(_cells(x[1 : 1 + k], every, step, False), _cells(y[1 : 1 + j], each, step, False), step):
        covered[0][low * step : high * step] = covered[1][low * step : high * step] = True
    back = _runs(_cells(x[1 + k : 1 + 2 * k], every, step, True), _cells(y[1 + j : 1 + 2 * j], each, step, True), step)
    for low, high in back:
        covered[0][n - high * step : n - low * step] = covered[1][m - high * step : m - low * step] = True
    marks = [_marks(n, x, k), _marks(m, y, j)]
    level = max(marks[0][0], marks[1][0])
    spans = [_between(size, mark, values[0], level) for size, mark, values in ((n, marks[0], x), (m, marks[1], y))]
    for key in spans[0].keys() & spans[1].keys():
        for low, at in zip(spans[0][key], spans[1][key], strict=False):
            covered[0][low : low + key[0]] = covered[1][at : at + key[0]] = True
    return 2.0 * min(int(c.sum()) for c in covered) / (n + m)


def _parsed(mark: str) -> tuple[int, np.ndarray]:
    n, _, data = mark.partition(":")
    return int(n), np.frombuffer(base64.b64decode(data), dtype="<u8")


def _halves(packed: np.ndarray) -> list[np.ndarray]:
    return [(packed >> np.uint64(31)).astype(np.int64), (packed & np.uint64((1 << 31) - 1)).astype(np.int64)]


def _cells(hashes: np.ndarray, every: int, step: int, from_end: bool) -> np.ndarray:
    """Hashes of the single spans of a grid, from those of the first or the last 1, 2, ... of them."""
    out = []
    for prime, base, sums in zip(PRIMES, BASES, _halves(hashes[every - 1 :: every]), strict=True):
        before = np.concatenate([np.zeros(1, np.int64), sums[:-1]])
        if from_end:  # the earlier span is the front of the longer one and shifts the rest by a step
            before = before * pow(base, step, prime) % prime
        out.append((sums - before) % prime)
    return np.stack(out)


def _runs(x: np.ndarray, y: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Runs of cells that two texts share: the one at the beginning, and others that are long enough."""
    n = min(x.shape[1], y.shape[1])
    same = np.concatenate([[False], (x[:, :n] == y[:, :n]).all(axis=0), [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if low == 0 or (high - low) * step >= LEAST:
            yield low, high


def _marks(n: int, x: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    """Level, and the chosen marks as rows: places, hashes of windows and of prefixes."""
    return int(x[1 + 2 * k]), x[2 + 2 * k :].reshape(3, -1)


def _between(n: int, mark: tuple[int, np.ndarray], whole: int, level: int) -> dict[tuple[int, int, int], list[int]]:
    """Where the spans between chosen marks of a level begin, by length and hashes."""
    kept = mark[1][:, mark[1][1] < np.uint64((1 << 31) >> level)]
    at = np.concatenate([[0], kept[0].astype(np.int64), [n]])
    upto = np.concatenate([np.zeros(1, np.uint64), kept[2], np.array([whole], np.uint64)])
    hashes = []
    for k, (prime, sums) in enumerate(zip(PRIMES, _halves(upto), strict=True)):
        hashes.append((sums[1:] - sums[:-1]) % prime * _inverse_powers(k, at[:-1]) % prime)
    found: dict[tuple[int, int, int], list[int]] = {}
    for low, length, *two in zip(at[:-1].tolist(), np.diff(at).tolist(), *(h.tolist() for h in hashes), strict=True):
        if length >= LEAST:
            found.setdefault((length, *two), []).append(low)
    return found


def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by as many characters of ``other``, or all of them."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def compare_with_next(df: DataFrame, *, id_column: str = "doc_id", pieces: int | None = None) -> DataFrame:
    """One row per row of ``df``: id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The next document has the next smaller id; after the last comes the first again. Null ids come
    last, rows of one id by their text. A null text is empty. A single row is its own next. An
    empty table gives an empty table.

    Ranges of ids are sorted side by side, each with the first row of the following one at its
    end, so a text moves once.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [] if n < 2 else docs.where("id IS NOT NULL").approxQuantile("id", [i / n for i in range(1, n)], max(0.5 / n, 1e-4))
    cuts = sorted({int(c) for c in cuts})
    # Ids are dealt out by how many cuts are at least as large, so larger ids come first.
    marks = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    docs = docs.withColumn(
        "range", F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(marks, lambda c: c >= F.col("id"))))
    )
    first = docs.groupBy("range").agg(F.min(_order()).alias("f"))
    first = first.select("range", "f.*").collect()  # a row per range: no text, only where it begins
    if not first:
        return _described(docs, id_column)
    first.sort(key=lambda r: r.range)
    follows = {r.range: first[i - 1].range if i else first[-1].range for i, r in enumerate(first)}
    pairs = spark.createDataFrame(
        [(r.range, r.down, r.mark, r.more, follows[r.range]) for r in first],
        "range int, down long, mark long, more long, before int",
    )
    # Rows alike in id and hashes are alike, so one of them stands for all.
    heads = docs.select("*", _order().alias("o")).join(F.broadcast(pairs.withColumnRenamed("range", "r")), 
        (F.col("range") == F.col("r")) & F.col("o.down").eqNullSafe(F.col("down")) & (F.col("o.mark") == F.col("mark")) & (F.col("o.more") == F.col("more"))
    ).dropDuplicates(["r"]).select("id", "text", F.col("before").alias("range"), F.lit(True).alias("guest"))
    every = docs.withColumn("guest", F.lit(False)).unionByName(heads)
    return _described(every, id_column)


def _order():  # noqa: ANN202
    """Smallest for what comes first: not null, large id, hashes of the text."""
    return F.struct(
        F.col("id").isNull().alias("none"),
        (-F.col("id")).alias("down"),
        F.xxhash64("text").alias("mark"),
        F.xxhash64(F.lit(3), "text").alias("more"),
    )


def _described(rows: DataFrame, id_column: str) -> DataFrame:
    if "guest" not in rows.columns:
        rows = rows.withColumn("guest", F.lit(False))
    order = _order()
    dealt = rows.repartition("range").sortWithinPartitions("range", "guest", order["none"], order["down"], order["mark"], order["more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("range", "guest", "id", "text"))
            for piece, guest, ident, text in zip(*columns, strict=True):
                now = (piece, ident, text, fingerprint(text))
                if held is not None and held[0] == piece:
                    out.append(_row(held, now))
                held = None if guest else now
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema(
        [
            ("id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ]
    )
    done = dealt.select("range", "guest", "id", "text").mapInArrow(
        run,
        "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
    return done.select(
        F.col("id").alias(id_column),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def _row(held: tuple, following: tuple) -> dict:
    _, ident, text, mark = held
    changed = edited(text, following[2])
    other = fingerprint(changed)
    return {
        "id": ident, "n_chars": len(text), "edited": changed, "fingerprint": mark, "edited_fingerprint": other,
        "near_edited": likeness(mark, other), "near_next": likeness(mark, following[3]),
    }
