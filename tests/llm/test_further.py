"""License scans, Merkle manifests and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aerovox.llm import licenses, merkle, queries, resampling

LONG = "word " * 300_000
LICENSE = "Licensed under the Apache License, Version 2.0."
TEXTS = [
    None, "", "   ", "one", LICENSE, LICENSE, "x " * 70 + LICENSE + " y" * 70, "All rights reserved.\nall RIGHTS-reserved",
    "licensed under\nthe Apache License, Version 2.0", "Licensed under CC BY-NC 4.0.", "mit license", "cc by cc by, CC\nBY",
    "This work is licensed under the GNU General Public License, version 3.", "é中 ÀB \U0001f600z0 a_b", "a\nb c\n\nd",
    "a\nb c\n\nd", LONG, "the cat sat\n" * 40, "the cat sat\n" * 40, " ".join(f"w{i}" for i in range(30)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, tree string, h1 string, digest string"


@pytest.fixture(scope="module")
def rows():
    sources = [None, "b", "a", "", "é", "b", "b"]
    made = [(i, t, [None, "en"][i % 2], sources[i % 7], len(t or "") or None) for i, t in enumerate(TEXTS)]
    return [*made, made[4], made[4], (None, "the cat", None, "b", 1), (None, "the cat", None, "b", 1), (None, "dog", "de", None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "r", "t", "h", "d") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


# --- license scans ------------------------------------------------------------------------


def blocks_of(text):
    for number, line in enumerate((text or "").split("\n")):
        ws = words(line)
        half = licenses.BLOCK_WORDS // 2
        for s in range(1 + max(0, math.ceil((len(ws) - licenses.BLOCK_WORDS) / half))):
            yield number, s * half, set(ws[s * half : s * half + licenses.BLOCK_WORDS])


def joined(text, templates, threshold):
    for line, at, block in blocks_of(text):
        for number, (label, wanted) in enumerate(licenses.template_sets(templates)):
            share = len(block & set(wanted)) / len(wanted)
            if len(block & set(wanted)) >= math.ceil(round(threshold * len(wanted), 9)):
                yield line, at, number, label, share


def test_join_finds_every_block(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)] + ["rare"]
    texts = ["\n".join(" ".join(r.choices(vocabulary, k=r.choice([0, 3, 9, 20, 200]))) for _ in range(3)) for _ in range(60)]
    templates = tuple((f"t{i}", " ".join(r.sample(vocabulary, r.randint(1, 12)))) for i in range(15)) + (("none", "..."),)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for threshold in (0.5, 0.8, 1.0):
        got = licenses.find_templates(df, ("id",), templates, threshold=threshold).collect()
        got = Counter((x.id, x.line, x["at"], x.template, x.label, x.containment) for x in got)
        assert got == Counter((i, *m) for i, t in enumerate(texts) for m in joined(t, templates, threshold))
    assert licenses.find_templates(df, ("id",), ()).count() == 0


def test_scan_labels_every_row(docs, rows, nothing):
    def expected(row):
        ws = words(row[1])
        places = {label: [i for i in range(len(ws)) if ws[i : i + p.count(" ") + 1] == p.split(" ")] for p, label in licenses.PHRASES.items()}
        base = sorted(label for label, at in places.items() if at)
        at = sum(places.values(), [])
        return (row[0], len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(base))

    got = licenses.scan_licenses(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(map(expected, rows))
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].labels == by_id[6].labels == "apache-2.0" and by_id[4].score == 1.0
    assert by_id[8].labels == "" and by_id[8].score == 0.0  # two lines are two blocks
    assert by_id[9].labels == "cc-by,cc-by-nc-4.0" and by_id[12].labels == "gpl,gpl-3.0" and by_id[10].labels == ""
    assert by_id[16].n_words == 300_000
    assert licenses.scan_licenses(nothing).count() == 0
    with pytest.raises(ValueError):
        licenses.template_sets((("huge", " ".join(map(str, range(licenses.MOST_WORDS + 1)))),))


# --- Merkle manifests ---------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def tree_of(leaves):
    """All levels, and the siblings on the way up from each leaf."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    proofs = []
    for i in range(len(leaves)):
        proof, at = [], i
        for level in levels[:-1]:
            run = at // 3 * 3
            proof += [d for k, d in enumerate(level[run : run + 3], run) if k != at]
            at //= 3
        proofs.append(proof)
    return levels[-1][0], proofs


def expected_proofs(rows):
    groups = {}
    for r in rows:
        groups.setdefault("0" if r[3] is None else "1" + r[3], []).append(r)
    keys = sorted(groups, key=str.encode)
    trees = {}
    for k in keys:
        leaves = sorted(((r[0] is not None, r[0] or 0), leaf_of(r), r[0]) for r in groups[k])
        trees[k] = (leaves, *tree_of([d for _, d, _ in leaves]))
    root, up = tree_of([trees[k][1] for k in keys])
    for k, above in zip(keys, up):
        leaves, subroot, proofs = trees[k]
        for (_, leaf, identity), proof in zip(leaves, proofs):
            yield identity, leaf, subroot, root, h(*proof, *above)


def digests(manifest, wanted):
    proofs = merkle.prove(manifest, wanted)
    folded = merkle.fold(F.col("digest"), F.col("lefts"), F.col("rights"))
    return proofs.select(
        "doc_id", "digest", "subroot", "root", merkle.proof_digest(F.col("lefts"), F.col("rights")).alias("proof"), (folded == F.col("root")).alias("ok")
    ).collect()


def test_proofs_lead_to_the_root(docs, rows, nothing):
    manifest = merkle.build_manifest(docs, carry={"doc_id": F.col("doc_id")})
    got = digests(manifest, manifest.leaves)
    assert all(r.ok for r in got)
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected_proofs(rows))
    empty = merkle.build_manifest(nothing, carry={"doc_id": F.col("doc_id")})
    assert empty.root is None and merkle.prove(empty, empty.leaves).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 728, 729, 730, 2200])
def test_one_source_of_many_rows(spark, n):
    made = [(i * 7, f"text {i}", "en", "s", i) for i in range(n)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    manifest = merkle.build_manifest(df, carry={"doc_id": F.col("doc_id")})
    want = {r[0]: r for r in expected_proofs(made)}
    some = manifest.leaves.where(F.col("doc_id") % 3 == 0)
    got = digests(manifest, some)
    assert {r.doc_id: tuple(r)[:5] for r in got} == {i: r for i, r in want.items() if i % 3 == 0}
    assert all(r.ok for r in got) and manifest.root == got[0].root


def test_multiproof_is_minimal_and_enough():
    r = random.Random(3)
    for size in [1, 2, 3, 4, 9, 10, 80, 81, 82, 300]:
        leaves = [h(str(i)) for i in range(size)]
        root, proofs = tree_of(leaves)
        levels = [dict(enumerate(leaves))]
        while len(levels[-1]) > 1:
            below = list(levels[-1].values())
            levels.append(dict(enumerate(h(*below[i : i + 3]) for i in range(0, len(below), 3))))
        for _ in range(5):
            wanted = r.sample(range(size), r.randint(1, size))
            need = merkle.missing(wanted, size)
            fetched = [{i: levels[k][i] for i in nodes} for k, nodes in enumerate(need)]
            paths = merkle.expand({i: leaves[i] for i in wanted}, fetched, size)
            assert all("".join(a + b for a, b in zip(*paths[i])) == "".join(proofs[i]) for i in wanted)
            # Nothing fetched is wanted, an ancestor of what is wanted, or fetched from above.
            for k, nodes in enumerate(need):
                assert not set(nodes) & {i // 3**k for i in wanted}


def test_a_changed_row_does_not_verify(spark, small):
    got = queries.op12_octopus_manifest(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")
        assert r.verified is (not changed)


# --- resampling ---------------------------------------------------------------------------


def features(text, n):
    ws = words(text)
    return [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


def resampled(rows, target, how):
    def bucket(f):
        return zlib.crc32(f.encode()) % how.buckets

    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(bucket, features(r[1], how.max_n)))
    for text in target:
        t.update(map(bucket, features(text, how.max_n)))
    total, wanted = sum(s.values()) + how.buckets, sum(t.values()) + how.buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * total / ((s[b] + 1) * wanted))) for b in range(how.buckets)]
    made = []
    for r in rows:
        own = [gain[bucket(f)] for f in features(r[1], how.max_n)]
        weight = sum(own) // len(own) if own else 0
        u = int(h(f"{how.seed}:{'-' if r[0] is None else r[0]}")[:8], 16)
        made.append([r[0], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None, len(words(r[1]))])
    able = sorted((m for m in made if m[5] >= how.least_words), key=lambda m: (-m[3], m[0] is not None, m[0]))
    for i, m in enumerate(able[: len(able) * how.percent // 100], 1):
        m[4] = i
    return Counter(tuple(m[:5]) for m in made)


@pytest.mark.parametrize("max_n, hot", [(1, 0.05), (1, 2.0), (3, 0.0)])
def test_resampling_by_lines_equals_whole_texts(spark, docs, rows, nothing, monkeypatch, max_n, hot):
    monkeypatch.setattr(resampling, "HOT", hot)
    target = ["the cat sat on w1 w2", None, "", "licensed under\nthe w3"]
    bench = spark.createDataFrame([(t, "x") for t in target], "text string, line string")
    how = resampling.Resampling(max_n=max_n, buckets=97, percent=60, least_words=2)
    assert Counter(map(tuple, resampling.resample(docs, bench, how).collect())) == resampled(rows, target, how)
    assert Counter(map(tuple, resampling.resample(docs, bench.where("false"), how).collect())) == resampled(rows, [], how)
    assert resampling.resample(nothing, bench, how).count() == 0
