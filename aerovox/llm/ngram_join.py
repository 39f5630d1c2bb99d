"""Similarity join on word shingles with prefix filters under several token orders.

Similar sets share a token among the first few of their tokens, whatever total order the tokens
are sorted by. One order makes the candidates: by hash, but with tokens that many documents have
at the end, so that common passages make none. Two more orders, by other hashes, filter them: a
pair has to share a prefix token under each. The first order looks further than the prefix: of so
many tokens more, a pair has to share one more than that. What is left is verified on whole sets.

A group of thousands of near copies has millions of similar pairs, and the classes need only
enough of them to hang together. So documents of equal sets are one vertex; a few rounds then
compare each document with those pivots of its buckets that it shares most with and unite what
is similar; at the end all
pairs of a bucket that still lie in different classes are compared, those of a large bucket in blocks
and without a row for each pair. No link between two classes is
lost, and pairs within a class are never listed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerovox.llm.common import small_batches
from aerovox.llm.components import components
from aerovox.llm.words import mixed, shingle_sets, text_bytes, word_hashes
from aerovox.session import scratch_path, store

#: A token in more sketches than this comes behind all rarer ones in the first order.
COMMON = 64
#: Rounds of comparing with pivots of the buckets before the rest is compared in full.
ROUNDS = 2
#: Pivots of a bucket in a round, and how many of those it meets a document is compared with.
PIVOTS, COMPARED = 8, 2
#: Rows of a bucket from which its vertices are compared by their differences from a pivot, and the share
#: of its own size up to which a vertex that differs from the pivot is close to it.
LARGE, CLOSE = 64, 1.0
#: Vertices near a pivot, and their differences from it, that a slice has on average; a task compares
#: two slices at a time. Places where rare differences meet, and columns of frequent ones, in memory at a time.
SLICE_ROWS, SLICE_TOKENS, INCIDENCES, COLUMNS = 1024, 1 << 17, 1 << 20, 1024
#: Rows of a narrow table up to which it is broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 300_000
#: Sets that a task remembers, so that it sends repeated ones on once.
SEEN = 100_000

_SALTS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], dtype=np.uint64)


def prefix_length(n, percent: int):  # noqa: ANN001, ANN201
    """Tokens of a set of ``n`` of which a similar set has one; for numbers and arrays."""
    return n - (n * percent + 99) // 100 + 1


def _signature(s: np.ndarray) -> tuple[int, int]:
    u = s.view(np.uint64)
    two = [mixed(u ^ salt).sum(dtype=np.uint64) for salt in _SALTS]
    return tuple(int(x.astype(np.int64)) for x in two)


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    data, starts = text_bytes(batch.column("text"))
    return shingle_sets(*word_hashes(data, starts), k)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sketches(k: int, percent: int):  # noqa: ANN202
    """Size, signature and the lowest tokens of every set: its prefix and half as many again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch, k)
            marks = [_signature(s) for s in sets]
            low = [s[: prefix_length(len(s), percent) * 3 // 2 + 1] for s in sets]
            columns = {
                "row": batch.column("row"),
                "id": batch.column("id"),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "s1": pa.array([m[0] for m in marks], pa.int64()),
                "s2": pa.array([m[1] for m in marks], pa.int64()),
                "low": _lists(low),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _whole_sets(k: int, percent: int):  # noqa: ANN202
    """The whole sets, and their prefixes under the second and the third order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            sets, marks = [], []
            for s in _sets(batch, k):
                mark = (*_signature(s), len(s))
                if mark not in seen:
                    seen.add(mark)
                    sets.append(s)
                    marks.append(mark)
            orders = []
            for salt in _SALTS:
                orders.append([])
                for s in sets:
                    p = prefix_length(len(s), percent)
                    keys = mixed(s.view(np.uint64) + salt)
                    orders[-1].append(s[np.argpartition(keys, p - 1)[:p]] if p < len(s) else s)
            columns = {
                "s1": pa.array([m[0] for m in marks], pa.int64()),
                "s2": pa.array([m[1] for m in marks], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "tokens": _lists(sets),
                "p2": _lists(orders[0]),
                "p3": _lists(orders[1]),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _small(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if a count shows it to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ngram_classes(df: DataFrame, *, words: int = 5, percent: int = 80, id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id``.

    Words, shingles and links are those of the contract: two sets link if their Jaccard
    similarity is at least ``percent`` hundredths. ``component_id`` is the smallest id that links
    reach, the row's own included. Sets are compared as 64-bit hashes of their shingles.

    Null and empty texts have no shingles and stand alone. Repeated rows link with each other;
    null ids count only where a whole component has no other. Other columns are ignored; an empty
    table gives an empty table.
    """
    spark = df.sparkSession
    small_batches(spark, 1)
    docs = df.select(F.col(id_column).cast("long").alias("id"), "text")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    held = store(
        numbered.mapInArrow(
            _sketches(words, percent), "row long, id long, n long, s1 long, s2 long, low array<long>"
        ),
        "sketches",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = held.where("n > 0").groupBy("s1", "s2", "n").agg(first.alias("f"))
    classes = store(classes.select("s1", "s2", "n", F.col("f.id").alias("id"), F.col("f.row").alias("v")), "classes")

    members, prefixes, sets = _members(docs, held, classes, words, percent)
    labels = _united(members, prefixes, sets, percent)

    linked = labels.where("v <> l")
    of = classes.join(linked, "v", "left").select("s1", "s2", "n", "id", F.coalesce("l", "v").alias("l"))
    names = of.groupBy("l").agg(F.min("id").alias("component_id"))
    of = of.join(names, "l").select("s1", "s2", "n", "component_id")
    rows = held.select("id", "n", "s1", "s2")
    return rows.join(of, ["s1", "s2", "n"], "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def _members(
    docs: DataFrame, held: DataFrame, classes: DataFrame, words: int, percent: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Buckets (t, v, n, need) of classes by token under the first order, prefixes under the other
    two (v, r2, r3), the tokens that several classes have only, and the sets (v, n, tokens)."""
    reps = _small(classes.select("v"))
    low = held.join(reps, F.col("row") == F.col("v"), "left_semi").select(
        F.col("row").alias("v"), F.explode("low").alias("t")
    )
    counts = _small(store(low.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "token-counts"))
    p = (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1).cast("long")
    # Two similar sets share more than one token of their sketches: as many as the shorter sketch is
    # longer than its prefix, and one. The smallest partner has ``percent`` hundredths of the size.
    m = F.ceil(F.col("n") * percent / 100)
    q = (m - F.floor((m * percent + 99) / 100) + 1).cast("long")
    needed = F.least(m, F.floor(q * 3 / 2) + 1) - q + 1
    # The rarer tokens of a sketch are the first ones of the set in the first order.
    common, whole = (F.col("c") > COMMON).cast("int"), Window.partitionBy("v")
    sizes = held.select(F.col("row").alias("v"), "n", F.size("low").alias("e"))
    shared = low.join(counts, "t").join(sizes, "v").withColumns(
        {"all": F.sum(common).over(whole), "shared": F.count("*").over(whole)}
    )
    ranked = store(
        shared.where(F.col("shared") >= needed).select(
            "v",
            "t",
            (F.col("e") - F.col("all") < F.least(p, F.col("n"))).alias("short"),
            (F.col("c") <= COMMON).alias("in"),
            (F.col("e") - F.col("all") - p + 1).alias("need"),
        ),
        "ranked",
    )
    # Where the sketch has too few of the rarer tokens, the prefix is taken from the whole set.
    short = ranked.where("short").select("v").distinct()
    short_sets = store(_fetched(docs, short, classes, words, percent), "short-sets")
    # Repeats of a token would take the places of others.
    once = short_sets.select("v", "n", "tokens").repartition("v").dropDuplicates(["v"])
    full = once.select("v", "n", F.explode("tokens").alias("t"))
    order = Window.partitionBy("v").orderBy(F.coalesce("c", F.lit(0)), "t")
    late = full.join(counts.where(F.col("c") > COMMON), "t", "left").withColumn("place", F.row_number().over(order))
    far = F.least(F.col("n"), F.floor(p * 3 / 2) + 1)
    late = store(late.where(F.col("place") <= far).select("v", "t"), "late")
    needs = ranked.where("NOT short").select("v", "need").distinct().unionByName(
        short_sets.select("v", (far - p + 1).alias("need")).distinct()
    )
    # Such a prefix may hold tokens that one other sketch has, so they weren't counted as shared.
    new = _small(store(late.select("t").distinct().join(counts, "t", "left_anti"), "late-tokens"))
    missed = low.join(new, "t").select("v", "t")
    early = ranked.where("in").select("v", "t").unionByName(missed)
    kept = store(_shared(early.join(short, "v", "left_anti").unionByName(late), "r1"), "prefixes")

    others = kept.select("v").join(short, "v", "left_anti")
    sets = _bucketed(short_sets.unionByName(_fetched(docs, others, classes, words, percent)))
    for name in ("p2", "p3"):
        other = sets.join(kept.select("v"), "v", "left_semi").select("v", F.explode(name).alias("t"))
        kept = kept.join(_shared(other, "r" + name[1]), "v")
    kept = store(kept.join(sets.select("v", "n").distinct(), "v").join(needs, "v", "left"), "kept-prefixes")
    need = F.coalesce("need", F.lit(1)).alias("need")
    members = store(kept.select(F.explode("r1").alias("t"), "v", "n", need), "members")
    return members, kept.select("v", "r2", "r3"), sets.select("v", "n", "tokens")


def _bucketed(sets: DataFrame) -> DataFrame:
    """The sets by vertex, each once, in a bucketed table, so that no join moves them again."""
    spark = sets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"token_sets_{uuid.uuid4().hex}"
    writer = sets.repartition(n, "v").dropDuplicates(["v"]).write.bucketBy(n, "v").sortBy("v")
    writer.option("path", scratch_path(spark, "token-sets")).saveAsTable(name)
    return spark.table(name)


def _fetched(docs: DataFrame, vertices: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The whole sets (v, n, tokens, p2, p3) of some classes, from the texts of their first ids.

    Rows alike in id and text may bring a set more than once."""
    wanted = _small(store(vertices.join(classes, "v"), "wanted"))
    ids = _small(store(wanted.select(F.col("id").alias("i")).distinct(), "wanted-ids"))
    texts = docs.join(ids, F.col("id").eqNullSafe(F.col("i")), "left_semi")
    whole = texts.select("text").mapInArrow(
        _whole_sets(words, percent), "s1 long, s2 long, n long, tokens array<long>, p2 array<long>, p3 array<long>"
    )
    return whole.join(wanted, ["s1", "s2", "n"]).select("v", "n", "tokens", "p2", "p3")


def _shared(prefixes: DataFrame, name: str) -> DataFrame:
    """(v, t) to (v, ``name``): the tokens that several have; those without any go."""
    prefixes = store(prefixes, "prefix-tokens")
    several = prefixes.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t")
    return prefixes.join(several, "t").groupBy("v").agg(F.sort_array(F.collect_list("t")).alias(name))


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Sizes that two similar sets can have."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _united(members: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Labels (v, l) of the classes of ``members``, equal where links lead from one to another."""
    labels = store(members.select("v").distinct().withColumn("l", F.col("v")), "labels")
    for turn in range(ROUNDS):
        pairs = _pivot_pairs(members, labels, turn, percent)
        labels, found = _unite(labels, pairs, sets, percent)
        if not found:
            break
    labels, _ = _unite(labels, _rest_pairs(members, prefixes, sets, labels, percent), sets, percent)
    return labels


def _unite(labels: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, bool]:
    links = store(_verified(pairs, sets, percent), "links")
    if links.isEmpty():
        return labels, False
    a = labels.select(F.col("v").alias("x"), F.col("l").alias("a"))
    b = labels.select(F.col("v").alias("y"), F.col("l").alias("b"))
    moved = components(links.join(a, "x").join(b, "y").select("a", "b")).select(
        F.col("v").alias("l"), F.col("l").alias("to")
    )
    return store(labels.join(moved, "l", "left").select("v", F.coalesce("to", "l").alias("l")), "labels"), True


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of similar sets."""
    x = sets.select(F.col("v").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    y = sets.select(F.col("v").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty"))
    tested = pairs.join(x, "x").join(y, "y")
    return tested.where(both * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent).select("x", "y")


def _pivot_pairs(members: DataFrame, labels: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each vertex the pivots of other classes with which it shares the most tokens."""
    rows = members.join(_small(labels), "v")
    # The lowest marks of a bucket; each task sends no more than these.
    order = Window.partitionBy("t").orderBy(F.xxhash64(F.lit(turn), "v"), "v")
    pivots = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS).select(
        "t", F.col("v").alias("w"), F.col("n").alias("m"), F.col("need").alias("want"), F.col("l").alias("k")
    )
    met = rows.join(pivots, "t").where((F.col("l") != F.col("k")) & _alike(F.col("n"), F.col("m"), percent))
    votes = met.groupBy("v", "w").agg(F.count("*").alias("votes"), F.min(F.least("need", "want")).alias("least"))
    near = votes.where(F.col("votes") >= F.col("least")).groupBy("v").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("votes", "w")), asc=False), 1, COMPARED).alias("b")
    )
    return near.select(F.col("v").alias("x"), F.explode("b.w").alias("y"))


def _rest_pairs(
    members: DataFrame, prefixes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int
) -> DataFrame:
    """All pairs of different classes that pass the filters of every order.

    In a small bucket they are compared as they are. A large one is mostly a group of near copies that
    share nearly all tokens; there a vertex is replaced by what tells it from a pivot, the label of the
    bucket's main class, and tasks compare slices of the vertices by these differences.
    """
    rows = _mixed(store(members.join(_small(labels), "v"), "labelled"), "t")
    large = rows.where((F.col("rows") > LARGE) & (F.col("v") != F.col("main")))
    apart = _differences(large.select("v", F.col("main").alias("p"), "n", "l").distinct(), sets, percent)
    # What is close to the pivot, and the pivot itself, is compared by differences only.
    close = apart.where("close").select(F.col("v").alias("cv"), F.col("p").alias("cp"))
    far = large.join(close, (F.col("v") == F.col("cv")) & (F.col("main") == F.col("cp")), "left_anti")
    met = _unlike(rows.where(F.col("rows") <= LARGE).unionByName(far), percent, "t")
    votes = met.groupBy("x", "y").agg(F.count("*").alias("votes"), F.min("need").alias("least"))
    plain = votes.where(F.col("votes") >= F.col("least")).select("x", "y")
    r = (100 - percent) / (100 + percent)
    direct = apart.where((F.col("l") != F.col("p")) & (F.col("d") <= F.lit(r + 1e-9) * (F.col("n") + F.col("m"))))
    direct = direct.select(F.least("v", "p").alias("x"), F.greatest("v", "p").alias("y"))
    pairs = plain.unionByName(_by_differences(apart, percent)).unionByName(direct).distinct()
    x = prefixes.select(F.col("v").alias("x"), F.col("r2").alias("x2"), F.col("r3").alias("x3"))
    y = prefixes.select(F.col("v").alias("y"), F.col("r2").alias("y2"), F.col("r3").alias("y3"))
    filtered = pairs.join(x, "x").join(y, "y").where(F.arrays_overlap("x2", "y2") & F.arrays_overlap("x3", "y3"))
    return filtered.select("x", "y")


def _mixed(rows: DataFrame, *bucket: str) -> DataFrame:
    """The rows (with ``v`` and ``l``) of buckets of several classes, with the largest class ``main`` and
    the number of ``rows``."""
    parts = rows.groupBy(*bucket, "l").agg(F.count("*").alias("c"))
    main = parts.groupBy(*bucket).agg(
        F.max(F.struct("c", "l")).alias("b"), F.count("*").alias("k"), F.sum("c").alias("rows")
    )
    main = main.where("k > 1").select(*bucket, F.col("b.l").alias("main"), "rows")
    return store(rows.join(main, list(bucket)), "mixed-buckets")


def _unlike(rows: DataFrame, percent: int, *bucket: str) -> DataFrame:
    """The pairs x < y of different classes and possible sizes in each bucket, and what they need.

    The largest class stands against the others only, never against itself. Which one that is
    differs by bucket and with it the side a vertex stands on, so pairs are given in order.
    """
    few = rows.where("l <> main").select(
        *bucket, F.col("v").alias("w"), F.col("n").alias("m"), F.col("l").alias("k"), F.col("need").alias("want")
    )
    met = few.join(rows, list(bucket)).where(
        (F.col("k") != F.col("l"))
        & ((F.col("l") == F.col("main")) | (F.col("w") < F.col("v")))
        & _alike(F.col("m"), F.col("n"), percent)
    )
    return met.select(F.least("w", "v").alias("x"), F.greatest("w", "v").alias("y"), F.least("need", "want").alias("need"))


def _differences(vertices: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``vertices`` (v, p, n, l) near their pivots p: size ``m`` of the pivot's set, the tokens ``diff`` of
    one of both only, their number ``d``, and whether v is ``close`` to p.

    A link has |x - y| <= q * |x| differing tokens, and |y - p| <= |y - x| + |x - p|. So whatever links with a close
    vertex is near, and two vertices that are not close are left to the buckets.
    """
    q = (100 - percent) / percent
    near = (CLOSE + q) * 100 / percent + 1e-9
    pivots = sets.select(F.col("v").alias("p"), F.col("n").alias("m"), F.col("tokens").alias("tp"))
    # The pivots' sets go to the vertices, whose own sets lie where they are.
    told = vertices.join(pivots, "p").join(sets.select("v", "tokens"), "v")
    # A token that only the pivot has is told from one that only the vertex has.
    lacks = F.transform(F.array_except("tp", "tokens"), lambda t: F.xxhash64(t))
    told = told.withColumn("diff", F.concat(F.array_except("tokens", "tp"), lacks))
    told = told.select("v", "p", "n", "l", "m", "diff", F.size("diff").cast("long").alias("d"))
    told = told.where(F.col("d") <= F.lit(near) * F.col("n"))
    return store(told.withColumn("close", F.col("d") <= F.lit(CLOSE) * F.col("n")), "differences")


def _by_differences(apart: DataFrame, percent: int) -> DataFrame:
    """Similar pairs (x, y) of vertices near one pivot: for any two slices of these vertices as many as tie
    together the classes that links between the slices join.

    The sets of x and y differ in dx + dy - 2c tokens, where c differences from the pivot are the same.
    """
    most = F.greatest(F.ceil(F.count("*") / SLICE_ROWS), F.ceil(F.sum("d") / SLICE_TOKENS), F.lit(1))
    groups = apart.groupBy("p").agg(most.alias("k"), F.min("l").alias("lo"), F.max("l").alias("hi"))
    groups = store(groups.where("lo <> hi").select("p", "k"), "slice-counts")
    dealt = apart.join(groups, "p").withColumn("i", F.pmod(F.xxhash64("v"), F.col("k")))
    rows = F.collect_list(F.struct("v", "n", "l", "d", "diff")).alias("s")
    slices = store(
        dealt.groupBy("p", "i").agg(rows).select("p", "i", "s.v", "s.n", "s.l", "s.d", F.flatten("s.diff").alias("t")),
        "slices",
    )
    both = groups.select("p", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("xi"), "k").select(
        "p", "xi", F.explode(F.sequence("xi", F.col("k") - 1)).alias("yi")
    )
    for side in "xy":
        both = both.join(slices.select("p", *[F.col(c).alias(side + c) for c in ("i", "v", "n", "l", "d", "t")]), ["p", side + "i"])
    return both.drop("p", "xi", "yi").mapInArrow(_slice_links(percent), "x long, y long").distinct()


def _slice_links(percent: int):  # noqa: ANN202
    """Links (x, y) between the vertices of two slices, none between classes that others join already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in range(batch.num_rows):
                x, y = ([batch.column(side + c)[r].values.to_numpy() for c in "vnldt"] for side in "xy")
                c = _common(x[3], x[4], y[3], y[4])
                sizes, apart = x[1][:, None] + y[1], x[3][:, None] + y[3]
                links = (sizes - apart + 2 * c) * (100 + percent) >= 2 * sizes * percent
                a, b = np.nonzero(links & (x[2][:, None] != y[2]))
                found += _forest(x[0][a], x[2][a], y[0][b], y[2][b])
            ends = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"x": pa.array(ends.min(axis=1)), "y": pa.array(ends.max(axis=1))})

    return run


def _common(dx: np.ndarray, tx: np.ndarray, dy: np.ndarray, ty: np.ndarray) -> np.ndarray:
    """How many tokens each list of one slice shares with each of another; lists of ``dx`` tokens stand
    one after the other in ``tx``, and none has a token twice."""
    shape = (len(dx), len(dy))
    out = np.zeros(shape[0] * shape[1], dtype=np.int64)
    ox, oy = np.argsort(tx, kind="stable"), np.argsort(ty, kind="stable")
    ax, ay = np.repeat(np.arange(shape[0]), dx)[ox], np.repeat(np.arange(shape[1]), dy)[oy]
    ux, sx, cx = np.unique(tx[ox], return_index=True, return_counts=True)
    uy, sy, cy = np.unique(ty[oy], return_index=True, return_counts=True)
    _, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    sx, cx, sy, cy = sx[i], cx[i], sy[j], cy[j]
    # Tokens of many lists by products of matrices, others by listing where they meet.
    often = np.flatnonzero(cx * cy * COLUMNS >= len(out))
    for low in range(0, len(often), COLUMNS):
        k = often[low : low + COLUMNS]
        out += (_marks(ax, sx[k], cx[k], shape[0]) @ _marks(ay, sy[k], cy[k], shape[1]).T).astype(np.int64).ravel()
    k = np.flatnonzero(cx * cy * COLUMNS < len(out))
    sx, cx, sy, cy = sx[k], cx[k], sy[k], cy[k]
    ends = np.cumsum(cx * cy)
    low = 0
    while low < len(ends):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + INCIDENCES, side="right")))
        many = (cx * cy)[low:high]
        at = np.arange(int(ends[high - 1]) - before) - np.repeat(ends[low:high] - many - before, many)
        wide = np.repeat(cy[low:high], many)
        left = ax[np.repeat(sx[low:high], many) + at // wide]
        right = ay[np.repeat(sy[low:high], many) + at % wide]
        out += np.bincount(left * shape[1] + right, minlength=len(out))
        low = high
    return out.reshape(shape)


def _marks(lists: np.ndarray, starts: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """One row for each of ``n`` lists, one column a token, 1 where the list has it."""
    out = np.zeros((n, len(starts)), dtype=np.float32)
    at = np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)
    out[lists[at], np.repeat(np.arange(len(starts)), counts)] = 1
    return out


def _forest(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (x, y) those that join classes which the ones before leave apart."""
    root: dict[int, int] = {}

    def top(l: int) -> int:  # noqa: E741
        while (up := root.get(l, l)) != l:
            root[l] = root.get(up, up)
            l = up  # noqa: E741
        return l

    kept = []
    for v, a, w, b in zip(x.tolist(), lx.tolist(), y.tolist(), ly.tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            root[a] = b
            kept.append((v, w))
    return kept
