"""The registered queries without SQL, column by column, on the smallest data."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from aerovox.llm import queries

from .test_llm import VOCABULARY, brute_classes

WS = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return "".join(" " if c in WS else c for c in text or "").split(" ")


def size(text):
    return sum(bool(w) for w in words(text))


def test_op1(spark, small, documents):
    got = {r.doc_id: r for r in queries.op1_hypergeometric_shards(spark, small).collect()}
    slots = defaultdict(list)
    for d in documents:
        r, data = got[d.doc_id], (d.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and len(got) == len(documents)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op2(spark, small, documents):
    got = {r.doc_id: r for r in queries.op2_prefix_hashes(spark, small).collect()}
    falling = documents[::-1]
    alike = defaultdict(set)
    for i, d in enumerate(falling):
        text, after = d.text or "", falling[(i + 1) % len(falling)].text or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        alike[text].add(r.fingerprint)
        alike[edited].add(r.edited_fingerprint)
        if edited == text:
            assert r.near_edited == 1.0
        elif len(text) >= 300:
            # Two thirds are left; of fingerprints of a bounded size a likeness is an estimate.
            assert 0.4 <= r.near_edited <= 0.95
    assert all(len(f) == 1 for f in alike.values())


def test_op3(spark, small, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_ngram_orders(spark, small).collect()}
    assert got == brute_classes({d.doc_id: d.text for d in documents})


def test_op6(spark, small, documents):
    theirs = Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: r for r in queries.op6_transducer_bpe(spark, small).collect()}
    for d in documents:
        ids = theirs.encode(d.text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest)
        assert r.decoded_sha256 == sha(theirs.decode(ids, skip_special_tokens=False))


def test_op7(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.op7_best_scoring_run(spark, small).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and "<" not in r.text
        assert all(line and line == " ".join(line.split()) for line in r.text.split("\n"))
    assert sum(r.n_chars > 100 for r in got) > 0.9 * len(got)


def test_op8(spark, small, documents):
    got = {r.doc_id: r for r in queries.op8_label_model_toxicity(spark, small).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for d in documents:
        r = got[d.doc_id]
        assert r.held_out is (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [(got[i].predicted, toxic) for i, toxic in labels.items() if toxic is not None]
    # There is little to learn from in this data; test_llm holds out labels of more.
    assert sum(p == t for p, t in known) >= 0.8 * len(known)


def test_op9(spark, small, documents):
    sizes = defaultdict(int)
    for d in documents:
        sizes[d.source] += size(d.text)
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, everything = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        rest = everything - set(target)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        full = {s for s in rest if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
    taken = defaultdict(int)
    rows = {r.doc_id: r for r in queries.op9_pareto_mix(spark, small).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        r = rows[d.doc_id]
        assert (r.size, r.source_size) == (size(d.text), sizes[d.source])
        assert r.target == pytest.approx(target[d.source], rel=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[d.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size(d.text) for d in documents if d.source == s)
