"""Each operator against brute force on small tables with nulls, empty and long texts, ties and clashes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerovox.llm import bpe, components, exact_dedup, extraction, fingerprints, lexicon, line_dedup, mixing
from aerovox.llm import ngram_join, queries, sharding, toxicity, warc, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WS = " \t\n\x0b\x0c\r"
RANDOM = random.Random(3)
PLAIN = " ".join(RANDOM.choice(["the", "of", "and", "cat", "sat", "mat", "Ünder", "x7"]) for _ in range(400))
TEXTS = [
    None, "", "   ", "one", "one", "One ", "a b c d", "a  b\tc d", PLAIN, PLAIN, PLAIN + " more words here",
    PLAIN.replace("cat", "dog", 1), "line one is long\nline two is long\nshort", "LINE ONE IS LONG \nother line here\n",
    "\n\n", "line two is long\nline two is long", "x" * 3000, PLAIN * 30, "é中\U0001f600 ok <|endoftext|> fine",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, score string, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a"][i % 3], len(t or ""), "r", "s", "t") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


# --- sharding -----------------------------------------------------------------------------


def test_shards_are_even_and_gapless(docs, nothing):
    got = sharding.shuffle_into_shards(docs, 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [4, 5, 5, 5]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r.text for r in got) == Counter(TEXTS)
    again = sharding.shuffle_into_shards(docs, 4).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert sharding.shuffle_into_shards(nothing, 3).count() == 0
    same = docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert sharding.shuffle_into_shards(same, 5).count() == 2 * len(TEXTS)


def test_matrix_adds_up(spark):
    n = [10, 0, 500, 7, 1000, 3]
    counts = spark.createDataFrame([(i * 5, x) for i, x in enumerate(n)], "p int, n long")
    ends = {r.p: r._ends for r in sharding.communication_matrix(counts, "p", len(n), sum(n), 7, 1).collect()}
    runs = np.array([np.diff([0, *ends[i * 5]]) for i in range(len(n))])
    assert (runs >= 0).all() and runs.sum(axis=1).tolist() == n
    assert sorted(runs.sum(axis=0).tolist(), reverse=True) == [218, 217, 217, 217, 217, 217, 217]


def test_hypergeometric_law(spark):
    u = [(i + 0.5) / 4000 for i in range(4000)]
    rows = spark.createDataFrame([(x,) for x in u], "u double")
    total, marked, draws = (F.lit(x).cast("long") for x in (30, 12, 9))
    got = Counter(r.x for r in rows.select(sharding.hypergeometric(total, marked, draws, F.col("u")).alias("x")).collect())
    from math import comb

    for x in range(10):
        assert abs(got[x] / 4000 - comb(12, x) * comb(18, 9 - x) / comb(30, 9)) < 2e-3


# --- fingerprints -------------------------------------------------------------------------


def test_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(2))
        x, y = (fingerprints.Prefixes(fingerprints.code_points(t)) for t in (a, b))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert x.extension(i, y, j) == n
    assert fingerprints.likeness(fingerprints.fingerprint(""), fingerprints.fingerprint("")) == 1
    assert fingerprints.likeness(fingerprints.fingerprint(""), fingerprints.fingerprint("a")) == 0


def test_likeness_sees_the_middle():
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))

    def like(a, b):
        return fingerprints.likeness(*map(fingerprints.fingerprint, (a, b)))

    for words_of in (40, 300, 3000):
        text, other = prose(words_of), prose(words_of)
        n = len(text)
        ends = "#" + text[1:-1] + "#"
        thirds = text[: n // 3] + "#" + text[n // 3 + 1 : 2 * n // 3] + "#" + text[2 * n // 3 + 1 :]
        moved = "a new title, longer " + text[9:-9] + " and a footer"
        assert like(text, ends) > 0.85 and like(text, thirds) > 0.8
        assert like(text, moved) == like(moved, text) > (0.5 if words_of == 40 else 0.8)
        assert like(text, other) < 0.1
    assert 0 <= like("a" * 5000, "b" + "a" * 4000) <= 1


def test_fingerprints_of_documents(docs, nothing):
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs, pieces=4).collect()}
    order = sorted(got, reverse=True)
    assert order == list(range(len(TEXTS)))[::-1]
    for k, i in enumerate(order):
        text, other = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + other[:third]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].fingerprint == fingerprints.fingerprint(text)
        assert 0.55 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[8].fingerprint == got[9].fingerprint != got[10].fingerprint
    assert fingerprints.compare_with_next(nothing).count() == 0
    loose = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert fingerprints.compare_with_next(loose, pieces=3).count() == 2 * len(TEXTS)


# --- n-gram join --------------------------------------------------------------------------


def shingles(text):
    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for c in WS:
        text = (text or "").replace(c, " ")
    w = [x for x in (text or "").translate(table).split(" ") if x]
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_classes(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("common, large, rounds", [(64, 64, 4), (3, 1, 4), (64, 1, 0)])
def test_ngram_classes(spark, docs, nothing, monkeypatch, common, large, rounds):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "LARGE", large)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rng = random.Random(5)
    texts = dict(enumerate(TEXTS))
    base = [f"w{rng.randint(0, 300)}" for _ in range(120)]
    shared = [f"s{k}" for k in range(30)]
    for i in range(100, 170):  # near copies of one text, some too far off, and texts that share a passage
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(120)] = f"e{rng.randint(0, 9999)}"
        texts[i] = " ".join(copy)
        texts[i + 100] = " ".join([*shared, *[f"v{rng.randint(0, 9999)}" for _ in range(rng.choice([3, 6, 60]))]])
    rows = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, v string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(rows).collect()}
    assert got == brute_classes(texts)
    assert ngram_join.ngram_classes(nothing).count() == 0
    twice = docs.unionByName(docs)
    again = {(r.doc_id, r.component_id) for r in ngram_join.ngram_classes(twice).collect()}
    assert again == {(i, c) for i, (_, c) in brute_classes(dict(enumerate(TEXTS))).items()}


def test_rest_pairs_count_votes_of_both_directions(spark):
    # 1 and 2 share four tokens; class 2 is the main one of two of the buckets, class 1 of the others.
    buckets = {1: (1, 2, 3), 2: (1, 2, 3), 3: (1, 2, 4), 4: (1, 2, 4)}
    rows = [(t, v, 10, 3) for t, vs in buckets.items() for v in vs]
    members = spark.createDataFrame(rows, "t long, v long, n long, need long")
    labels = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (3, 2)], "v long, l long")
    prefixes = spark.createDataFrame([(v, [7], [8]) for v in range(1, 5)], "v long, r2 array<long>, r3 array<long>")
    sets = spark.createDataFrame([(v, 10, list(range(10))) for v in range(1, 5)], "v long, n long, tokens array<long>")
    pairs = ngram_join._rest_pairs(members, prefixes, sets, labels, 80).collect()
    assert [(r.x, r.y) for r in pairs] == [(1, 2)]


@pytest.mark.parametrize("columns", [1024, 1])
def test_differences_meet_in_blocks_without_a_row_for_each_pair(spark, monkeypatch, columns):
    monkeypatch.setattr(ngram_join, "SLICE_ROWS", 32, raising=False)
    monkeypatch.setattr(ngram_join, "INCIDENCES", 500, raising=False)
    monkeypatch.setattr(ngram_join, "COLUMNS", columns, raising=False)
    rng = random.Random(2)
    pivot, sets = set(range(100)), {}
    variants = [sorted(rng.sample(range(100), 15)) for _ in range(12)]
    for v in range(1, 201):  # far from the pivot; near to the same variant, to another's copy by chance, or to nothing
        lost = set(variants[v % 12] if v % 3 else rng.sample(range(100), 15))
        lost ^= set(rng.sample(range(100), 2))
        sets[v] = (pivot - lost) | {1000 * v + k for k in range(rng.randint(0, 9))}
    diff = {v: [*(s - pivot), *(-1 - t for t in pivot - s)] for v, s in sets.items()}
    rows = [(v, 0, len(s), v, 100, diff[v], len(diff[v]), True) for v, s in sets.items()]
    apart = spark.createDataFrame(
        rows, "v long, p long, n long, l long, m long, diff array<long>, d long, close boolean"
    )
    got = [(r.x, r.y) for r in ngram_join._by_differences(apart, 80).collect()]
    union = lambda x, y: len(sets[x] | sets[y])
    links = {(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * union(x, y)}
    assert set(got) <= links and len(links) > 1000
    # At most one link less than there are vertices for any two of the slices, which are 7.
    assert len(got) < 7 * 200

    def classes(edges):
        found = {v: v for v in sets}
        for _ in sets:
            for x, y in edges:
                found[x] = found[y] = min(found[x], found[y])
        return found

    assert classes(got) == classes(links)


def test_ngram_classes_of_repeated_rows(spark, monkeypatch):
    # Every shingle that documents share is common, so prefixes come from whole sets; the rows of a
    # near copy stand in several batches and partitions.
    monkeypatch.setattr(ngram_join, "COMMON", 1)
    rng = random.Random(11)
    texts = {}
    for group in range(8):
        base = [f"g{group}w{k}" for k in range(60)]
        texts[2 * group] = " ".join(base)
        base[rng.randrange(10, 50)] = "other"
        texts[2 * group + 1] = " ".join(base)
    rows = spark.createDataFrame([*texts.items()] * 24, "doc_id long, text string").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(rows).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {(i, *c) for i, c in brute_classes(texts).items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 103)] + [(500, k) for k in range(501, 560)]
    got = {r.v: r.l for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(2, 41)} == {1} and got[105] == got[103] == 100 and got[559] == 500


def test_hashing_words_takes_little_memory():
    import tracemalloc

    data = np.frombuffer(b"some words of a text " * 150_000, dtype=np.uint8)
    tracemalloc.start()
    hashes, before = words.word_hashes(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert before.tolist() == [0, 750_000] and hashes.nbytes == 6_000_000
    # The hashes and what joins them, and a block's arrays.
    assert peak < 32 << 20


def test_word_hashes_by_blocks(monkeypatch):
    texts = [t or "" for t in TEXTS]
    data, starts = words.text_bytes(pa.array(TEXTS))
    whole = words.word_hashes(data, starts)
    monkeypatch.setattr(words, "BLOCK", 64)
    small = words.word_hashes(data, starts)
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()
    assert np.diff(whole[1]).tolist() == [len(t.split()) for t in texts]


# --- archives -----------------------------------------------------------------------------

PAGES = [
    (1, "http://a/", "<p>" + "x" * 200 + "</p>"), (2, "http://b/", "<p>" + "x" * 200 + "</p>"), (3, None, None),
    (4, "http://c/", ""), (5, "u", "short"), (6, "u", "short"), (7, "é\r\nX: y", "é" * 60), (8, "d", "é" * 60),
    (None, "n", "<p>" + "x" * 200 + "</p>"), (9, "long", "<i>z</i>" * 40000),
]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("?"))
    got = warc.round_trip(pages).collect()
    assert len(got) == len(PAGES)
    by_id = {r.page_id: r for r in got}
    for ident, _, page in PAGES:
        r = by_id[ident]
        body = (page or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        first = min(i for i, _, h in PAGES if i and h == page) if ident and len(body) >= 100 else ident
        assert (r.record_type, r.refers_to) == (("response", None) if first == ident else ("revisit", first))
        assert r.payload == (body if r.record_type == "response" else None)
        if r.refers_to:
            assert r.refers_to_record == by_id[r.refers_to].record_id
    assert warc.round_trip(pages.where("false")).count() == 0


def test_broken_archives():
    coder = zstandard.ZstdCompressor(write_checksum=True)
    good = warc._page_record(1, "u", "<p>hello</p>", hashlib.sha256(b"<p>hello</p>").hexdigest(), None, "d", warc.uuid.uuid4())
    frame = coder.compress(good)
    assert [*warc.frames(frame + warc.SEPARATOR.encode() + frame)] == [good, good]
    assert warc._read_record(good)["payload"] == b"<p>hello</p>"
    for bad in (frame[:-3], frame + b"rest", b"\x50\x2a\x4d\x18\x09"):
        with pytest.raises((warc.BadArchive, zstandard.ZstdError)):
            [*warc.frames(bad)]
    for bad in (good[:-1], good.replace(b"hello", b"hallo"), good.replace(b"WARC-Date", b"X-Date"), b"WARC/1.1\r\n"):
        with pytest.raises(warc.BadArchive):
            warc._read_record(bad)


# --- lines --------------------------------------------------------------------------------


def brute_lines(texts):
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(WS))

    owner = {}
    for i in sorted(texts):
        for line in (texts[i] or "").split("\n"):
            owner.setdefault(key(line), i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(docs, nothing, batches):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs, batches=batches).collect()}
    assert got == brute_lines(dict(enumerate(TEXTS)))
    assert line_dedup.dedup_lines(nothing).count() == 0
    twice = line_dedup.dedup_lines(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(TEXTS)
    assert {(r.doc_id, r.kept_text) for r in twice} == {(i, x[2]) for i, x in got.items()}


def test_runs_merge(spark):
    runs = line_dedup.LineRuns(spark, buckets=2, fanout=2)
    for k in range(5):
        keys = spark.createDataFrame([(x, x, k) for x in range(k * 2, k * 2 + 4)], "h1 long, h2 long, owner long")
        runs.add(runs.unseen(keys))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = sorted((r.h1, r.owner) for t in runs.tables() for r in t.collect())
    assert held == [(x, max(0, x // 2 - 1)) for x in range(12)]
    runs.close()


# --- BPE ----------------------------------------------------------------------------------


def test_encoding_is_the_librarys(monkeypatch):
    theirs = Tokenizer.from_file(VOCABULARY)
    ours = bpe.Vocabulary(VOCABULARY)
    frequent = sorted({b" the", b"the", b" then", b" cats", b"a", b" "})
    arrays = lexicon.build((w, ours.merge(w)) for w in frequent)
    path = f"/tmp/lexicon-test-{random.random()}"
    lexicon.save(arrays, path)
    book = lexicon.Lexicon(path)
    found = book.find([b" the", b"th", b"", b" thenn", b" cats"])
    assert [None if x is None else x.tolist() for x in found] == [ours.merge(b" the"), None, None, None, ours.merge(b" cats")]
    coder = bpe.Encoder(ours, book)
    parts = ["a", "b", "the", " ", "  ", "\n", " \n", "\t", "'s", "'ll", "é", "中", "1", "22", "!", "<|endoftext|>"]
    parts += ["\x1c", "　", "՘", "\U000323b0", "​", " ", "...", "\x00", "\x85", " the", "﻿"]
    rng = random.Random(0)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["ab" * 500, "a" * 777, "".join(rng.choice("abcé") for _ in range(3000)), ""]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    for block, pieces in ((1, 10), (50, 0), (3000, 10**6)):
        monkeypatch.setattr(bpe, "BLOCK", block)
        monkeypatch.setattr(bpe, "PIECES", pieces)
        coder = bpe.Encoder(ours, book)
        want = [np.array(theirs.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert coder.encode(texts) == want and coder.encode(texts[::-1]) == want[::-1]
        assert max(len(coder.heads), len(coder.tails)) <= pieces
    long = "".join(rng.choice("abcdeé") for _ in range(200_000)) + " and " + "word " * 100_000
    assert np.frombuffer(coder.encode([long])[0], dtype="<u4").tolist() == theirs.encode(long, add_special_tokens=False).ids
    some = [bytes(rng.choices(range(97, 110), k=rng.randint(0, bpe.SHORT))) for _ in range(3000)] + [b"ab" * 10, bytes(range(32))]
    monkeypatch.setattr(bpe, "SIDE_BY_SIDE", 700)
    for word, ids in zip(some, ours.merge_all(some), strict=True):
        assert ids.tolist() == ours._merge_long([ours.bytes[b] for b in word])


def test_rare_words_of_ascii_pieces(monkeypatch):
    """Pieces in ASCII are cut by the faster pattern only, and as the other one cuts them."""
    rng = random.Random(1)
    parts = [*map(chr, range(128)), "ab", "12", "'s", "'re", "'ll", " ", "  ", "\r\n"]
    texts = [" " * (k % 2) + "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for k in range(20_000)]
    assert all(bpe.ASCII_WORD.findall(t) == bpe.WORD.findall(t) for t in texts)
    theirs, ours = Tokenizer.from_file(VOCABULARY), bpe.Vocabulary(VOCABULARY)
    path = f"/tmp/lexicon-test-{random.random()}"
    lexicon.save(lexicon.build([(b" the", ours.merge(b" the"))]), path)
    monkeypatch.setattr(bpe, "WORD", SimpleNamespace(findall=None))
    coder = bpe.Encoder(ours, lexicon.Lexicon(path))
    for text, ids in zip(texts[:2000], coder.encode(texts[:2000]), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_lexicon_is_minimal():
    entries = [(w.encode(), [k]) for k, w in enumerate(sorted({p + s for p in ("a", "b", "ca") for s in ("", "ing", "ed")}))]
    arrays = lexicon.build(entries)
    # Root, one state after "c", and the five that "ing" and "ed" share: the suffixes are stored once.
    assert len(arrays["final"]) - 1 == 2 + 5


def test_round_trip_table(spark, docs, nothing):
    theirs = Tokenizer.from_file(VOCABULARY)
    for r in bpe.token_digests(docs, VOCABULARY).collect():
        ids = theirs.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert bpe.token_digests(nothing, VOCABULARY).count() == 0
    odd = spark.createDataFrame([(b"\xff\xff\x00\x00"[:0],), (None,)], "ids binary")
    assert {r.decoded for r in bpe.decode(odd, VOCABULARY).collect()} == {"", None}


# --- extraction ---------------------------------------------------------------------------


def test_the_scan_finds_the_borders_without_marks(spark, small):
    """With the marks of the content renamed, the same text is found on nearly all pages."""
    pages = [r.html or "" for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    weights = extraction.learn(pages)
    plain = [re.sub(r"<(/?)(article|main)\b", r"<\1div", p) for p in pages]
    same = sum(extraction.extract(p, weights) == extraction.extract(q, weights) for p, q in zip(pages, plain, strict=True))
    assert same >= 0.99 * len(pages)

ARTICLE = (
    "<html><head><title>t</title><style>p{}</style></head><body><nav><a>home</a></nav><div class='ad'>buy this now</div>"
    "<article><h1>Big &amp; small</h1><p>One  two\nthree.<p>Four <b>fi</b>ve.<br>six<div class=comments>no</div>"
    "<form>send</form><script>x('</p>')</script></article><footer>the end</footer></body></html>"
)


def test_best_run_is_the_best():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([-3, -1, 1, 2]) for _ in range(rng.randint(0, 12))]
        low, high = extraction.best_run(s)
        assert sum(s[low:high]) == max(sum(s[i:j]) for i in range(len(s) + 1) for j in range(i, len(s) + 1))


def test_extraction(spark):
    weights = extraction.learn([ARTICLE] * 3)
    assert extraction.extract(ARTICLE, weights) == "Big & small\nOne two three.\nFour five. six"
    assert extraction.extract("<div><p>just some text here</p></div><nav>menu</nav>", weights) == "just some text here"
    assert extraction.extract("no tags &lt;", weights) == "no tags <"
    assert extraction.extract("<nav>only a menu", weights) == ""
    # Quotes and comment marks in a script open nothing behind it.
    for script in ("for(i=0;i<n;i++){} // don't", "var s='<!--'", "if (a<b) x = '<p'"):
        page = f"<article><script>{script}</script><p>Body.</p><p>it's fine</p></article>"
        assert extraction.extract(page, weights) == "Body.\nit's fine"
    # The scan finds the content, wherever an article element stands.
    body = "<p>" + "One sentence after the other stands here. " * 5 + "</p>"
    text = ("One sentence after the other stands here. " * 5).strip()
    teaser = "<article class='card'><p>Read this, too</p></article>"
    assert extraction.extract(f"<div class='content has-sidebar'>{body}</div>{teaser}", weights) == text
    titled = f"<article><header class='entry-header'><h1>Title</h1></header>{body}</article>"
    assert extraction.extract(titled, weights) == "Title\n" + text
    rows = [(1, "u", ARTICLE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (3, "v", "", "x"), (4, "w", "<p>" * 5000 + "deep", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extraction.main_text(pages).collect()}
    assert got == {1: "Big & small\nOne two three.\nFour five. six", 2: "", 3: "", 4: "deep"}
    assert extraction.main_text(pages.where("false")).count() == 0


# --- toxicity -----------------------------------------------------------------------------


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.15
    right = lambda p: np.where(rng.random(3000) < p, truth, ~truth)
    votes = [np.where(right(0.95) & truth, 2, 0) for _ in range(3)] + [np.where(right(0.9), 2, 1), np.where(rng.random(3000) < 0.5, 2, 0)]
    votes[3] = np.where(truth & (rng.random(3000) < 0.9), 2, np.where(rng.random(3000) < 0.9, 1, 0))
    q = toxicity.posterior(np.stack([*votes, votes[0]], axis=1))
    assert ((q > 0.5) == truth).mean() > 0.95


def test_toxicity_held_out(spark, nothing):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_label_model_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.85 and hit / sum(r.toxic for r in rows) > 0.85
    model = toxicity.train(nothing, labels.where("false"))
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)


# --- mixing -------------------------------------------------------------------------------


def test_targets(spark):
    sizes = spark.createDataFrame([("b", 100), (None, 1000), ("a", 10), ("c", 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (3, 1, 2), 1.5, 2).collect()}
    # By weight a 3, b 1, c 2, null 3 of 2415; a and b are full at once, then c.
    assert got["a"] == 20 and got["b"] == 200 and got["c"] == pytest.approx(2195 * 2 / 5) and got[None] == pytest.approx(2195 * 3 / 5)


def test_mix(spark, nothing):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice([None, "a", "b", "b", "b"]), "x") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(4)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 2000 and all(r.copies in (0, 1, 2) for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    for source, words_wanted in target.items():
        assert abs(taken[source] - words_wanted) <= 30
    again = mixing.mix_sources(docs).collect()
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again}
    few = mixing.mix_sources(docs.where("source = 'a'"), share=0.3, weights=(1,), importance=F.col("doc_id") + 1).collect()
    low, high = ([r.copies for r in few if (r.doc_id < 1000) == part] for part in (True, False))
    assert sum(high) / len(high) > 2 * sum(low) / len(low)
    assert mixing.mix_sources(nothing).count() == 0


# --- exact dedup --------------------------------------------------------------------------


def test_cut_points_follow_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 60000, dtype=np.uint8).tobytes()
    ends = exact_dedup.cut_points(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= exact_dedup.MOST and sizes[:-1].min() >= exact_dedup.LEAST
    moved = set((exact_dedup.cut_points(b"new start " + data) - 10).tolist())
    assert len(moved & set(ends.tolist())) > 0.8 * len(ends)
    assert exact_dedup.cut_points(b"").tolist() == [0]


def test_exact_duplicates(docs, nothing):
    def normal(t):
        out = "".join(" " if c in WS else c for c in t or "")
        while "  " in out:
            out = out.replace("  ", " ")
        return out

    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[normal(t)].append(i)
    for r in exact_dedup.exact_duplicates(docs, carry=("text", "_row")).collect():
        same = groups[normal(TEXTS[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), r.doc_id == min(same))
        assert r.text_sha256 == hashlib.sha256(normal(TEXTS[r.doc_id]).encode()).hexdigest()
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    twice = docs.select("doc_id", "text").unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    kept = exact_dedup.exact_duplicates(twice.unionByName(twice)).where("kept").collect()
    assert len(kept) == len(groups) and all(r.doc_id is not None for r in kept)


def test_colliding_chunks_are_told_apart(docs, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(1).cast("long") if len(c) == 1 else real(*c))
    sizes = {r.doc_id: r.group_size for r in exact_dedup.exact_duplicates(docs).collect()}
    assert sizes[8] == 2 and sizes[10] == 1 and sizes[16] == 1
