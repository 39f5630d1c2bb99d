"""Merkle manifest of a data set, and inclusion proofs by octopus multiproofs.

Every row is a leaf. The leaves of a source, in the order of their ids, make a tree of runs of three;
the roots of the sources, in their order, make another on top. A tree is held in strata of
``LEVELS`` levels, a stratum in blocks of ``3 ** LEVELS`` neighbours with all that stands above them
in the stratum, so a row is never more than some 70 KB and no key is hot: a node near the top of a
source is fetched by the one block below it, not by every leaf.

A proof is made block by block. The wanted leaves of a block tell which nodes are missing that
they cannot derive from each other (the octopus: the least union over all their paths); these are
fetched by one join, the interiors derived in the task, and each leaf gets its own path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from aerovox.llm.common import places, small_batches
from aerovox.session import store

ARITY = 3
LEVELS = 6
BLOCK = ARITY**LEVELS

#: The columns of a row that its leaf vouches for.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "lefts array<string>, rights array<string>, subroot string, root string"


@dataclass
class Manifest:
    """``leaves``: tree, index, digest and what was carried. ``sources``: the leaves of the tree above.
    ``strata``, ``crown``: the blocks of the trees of the sources and of the tree above, from the
    leaves up. ``root``: None without rows."""

    leaves: DataFrame
    sources: DataFrame
    strata: list[DataFrame]
    crown: list[DataFrame]
    root: str | None


# --- digests ------------------------------------------------------------------------------


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256)


def fold(digest: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf leads to: at each level the siblings on both sides and it are hashed."""
    sides = F.arrays_zip(lefts.alias("l"), rights.alias("r"))
    return F.aggregate(sides, digest, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]).cast("binary"), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """Hash of all siblings of a path, from the leaf to the root."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda l, r: F.concat(l, r)), "").cast("binary"), 256)


# --- building -----------------------------------------------------------------------------


def build_manifest(
    docs: DataFrame,
    *,
    columns: tuple[str, ...] = COLUMNS,
    source: str = "source",
    order: str = "doc_id",
    carry: dict[str, Column] | None = None,
) -> Manifest:
    """The manifest of ``docs``; ``carry`` names expressions over its rows to keep beside the leaves.

    Sources stand in the order of their UTF-8 bytes, null first; leaves in ``order``, null first, then
    by digest. Rows alike in all columns are leaves of their own, and a null differs from an empty
    text. Only ``columns``, ``source`` and ``order`` are read, so other columns may have any name.
    """
    carry = carry or {}
    # A source as a key that is never null and sorts the same way.
    tree = F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0"))
    leaves = docs.select(
        tree.alias("tree"),
        F.col(order).alias("_order"),
        leaf_digest(*[F.col(c) for c in columns]).alias("digest"),
        F.monotonically_increasing_id().alias("_tie"),
        *[e.alias(name) for name, e in carry.items()],
    )
    # Hashed once: the sort by ranges looks at its input twice.
    leaves = places(store(leaves, "leaves"), "tree", "_order", "digest", "_tie")
    leaves = store(leaves.withColumnRenamed("place", "index").drop("_order", "_tie"), "merkle-leaves")

    strata = _strata(leaves)
    roots = strata[-1].select("tree", _root().alias("digest"))
    roots = places(store(roots, "subroots").withColumn("_all", F.lit(0)), "_all", "tree")
    sources = roots.select(F.lit("").alias("tree"), F.col("place").alias("index"), "digest", F.col("tree").alias("of"))
    sources = store(sources, "crown-leaves")
    crown = _strata(sources)
    top = crown[-1].select(_root().alias("root")).first()
    return Manifest(leaves, sources, strata, crown, top and top.root)


def _root() -> Column:
    """In the uppermost stratum a tree has one block, which ends in its root."""
    return F.element_at(F.element_at("levels", -1), 1)


def _strata(nodes: DataFrame) -> list[DataFrame]:
    """Blocks (tree, block, size, levels) of each stratum; ``size``: nodes of the tree at its floor."""
    sizes = store(nodes.groupBy("tree").agg(F.count("*").alias("size")), "tree-sizes")
    most = sizes.agg(F.max("size").alias("most")).first().most or 0
    found = []
    while True:
        blocks = nodes.groupBy("tree", F.floor(F.col("index") / BLOCK).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("floor")
        )
        blocks = blocks.join(sizes, "tree").withColumn("levels", F.array(F.transform("floor", lambda x: x["digest"])))
        for level in range(LEVELS):
            # Where the whole tree has come to one node, it ends; else each run becomes its hash.
            more = F.col("size") > ARITY**level
            blocks = blocks.withColumn("levels", F.when(more, F.concat("levels", F.array(_runs()))).otherwise(F.col("levels")))
        blocks = store(blocks.select("tree", "block", "size", "levels"), "merkle-blocks")
        found.append(blocks)
        most = -(-most // BLOCK)
        if most <= 1:
            return found
        sizes = sizes.withColumn("size", F.ceil(F.col("size") / BLOCK))
        nodes = blocks.select("tree", F.col("block").alias("index"), _root().alias("digest"))


def _runs() -> Column:
    below = F.element_at("levels", -1)
    firsts = F.sequence(F.lit(0), F.size(below) - 1, F.lit(ARITY))
    return F.transform(
        firsts, lambda i: F.sha2(F.concat_ws("", *[F.get(below, i + k) for k in range(ARITY)]).cast("binary"), 256)
    )


# --- proving ------------------------------------------------------------------------------


def missing(wanted: Iterable[int], size: int, levels: int = LEVELS) -> list[list[int]]:
    """For each level the nodes that ``wanted`` need and cannot derive from each other.

    ``size`` is the number of nodes at the lowest level; a tree of one node needs none.
    """
    path, found = sorted(set(wanted)), []
    while size > 1 and len(found) < levels:
        known = set(path)
        path = sorted({i // ARITY for i in path})
        found.append([i for p in path for i in _children(p, size) if i not in known])
        size = -(-size // ARITY)
    return found


def expand(digests: dict[int, str], fetched: list[dict[int, str]], size: int) -> dict[int, tuple[list, list]]:
    """For each wanted node its path: the siblings to the left and to the right at each level."""
    levels, nodes = [], dict(digests)
    for more in fetched:
        nodes.update(more)
        levels.append((nodes, size))
        parents = {i // ARITY for i in nodes}
        nodes = {p: hashlib.sha256("".join(nodes[i] for i in _children(p, size)).encode()).hexdigest() for p in parents}
        size = -(-size // ARITY)
    paths = {}
    for wanted in digests:
        at, lefts, rights = wanted, [], []
        for nodes, width in levels:
            run = _children(at // ARITY, width)
            lefts.append("".join(nodes[i] for i in run if i < at))
            rights.append("".join(nodes[i] for i in run if i > at))
            at //= ARITY
        paths[wanted] = lefts, rights
    return paths


def _children(parent: int, size: int) -> range:
    return range(ARITY * parent, min(ARITY * parent + ARITY, size))


def prove(manifest: Manifest, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rows of ``manifest.leaves``, all or some) with a proof each.

    Adds ``lefts`` and ``rights`` (one string a level, empty where there is no sibling), ``subroot``
    and ``root``. No rows give no rows.
    """
    small_batches(wanted.sparkSession)
    none = F.array().cast("array<string>")
    ends = manifest.crown[-1].select(
        "tree", none.alias("up_lefts"), none.alias("up_rights"), F.lit(None).cast("string").alias("subroot"), _root().alias("root")
    )
    above = _paths(manifest.crown, 0, manifest.sources, ends)
    above = above.select(
        F.col("of").alias("tree"), F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"), F.col("digest").alias("subroot"), "root"
    )
    return _paths(manifest.strata, 0, wanted, store(above, "crown-paths"))


def _paths(strata: list[DataFrame], at: int, wanted: DataFrame, above: DataFrame) -> DataFrame:
    """Paths of ``wanted``, nodes of the stratum ``at``; ``above`` goes on from the trees' roots."""
    parts = wanted.groupBy("tree", F.floor(F.col("index") / BLOCK).alias("block")).agg(
        F.collect_list(F.struct(*[c for c in wanted.columns if c != "tree"])).alias("have")
    )
    parts = parts.join(strata[at], ["tree", "block"])
    parts = parts.withColumn("need", _missing(F.transform("have", lambda x: x["index"]), "size"))
    first = F.array(*[F.col("block") * ARITY ** (LEVELS - level) for level in range(LEVELS)])
    fetched = F.transform(
        "need",
        lambda nodes, level: F.transform(
            nodes, lambda i: F.get(F.get("levels", level), (i - F.get(first, level)).cast("int"))
        ),
    )
    parts = parts.select("tree", "block", "size", "have", "need", fetched.alias("got"), _root().alias("digest"))
    if at + 1 < len(strata):
        parts = store(parts, "merkle-parts")
        tops = parts.select("tree", F.col("block").alias("index"), "digest")
        up = _paths(strata, at + 1, tops, above)
        up = up.select("tree", F.col("index").alias("block"), F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"), "subroot", "root")
        parts = parts.join(up, ["tree", "block"])
    else:
        parts = parts.join(above, "tree")
    plain = ", ".join(f"`{name}` {kind}" for name, kind in wanted.dtypes)
    return parts.mapInPandas(_expanded, f"{plain}, {_PATH}")


@F.udf(ArrayType(ArrayType(LongType())), useArrow=False)
def _missing(indices: list[int], size: int) -> list[list[int]]:
    return missing(indices, size)


def _expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in batch.itertuples(index=False):
            # As objects, or a null among the whole numbers would make floats of all.
            rows = pd.DataFrame(list(part.have), dtype=object)
            fetched = [dict(zip(map(int, n), g)) for n, g in zip(part.need, part.got)]
            paths = expand(dict(zip(rows["index"].tolist(), rows["digest"])), fetched, part.size)
            paths = [paths[i] for i in rows["index"].tolist()]
            rows.insert(0, "tree", part.tree)
            rows["lefts"] = [left + list(part.up_lefts) for left, _ in paths]
            rows["rights"] = [right + list(part.up_rights) for _, right in paths]
            rows["subroot"], rows["root"] = part.subroot, part.root
            yield rows
