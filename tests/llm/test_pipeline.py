"""The stages of the pipeline against brute force, each on its own input."""

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from aerovox.session import store

from .test_llm import VOCABULARY, brute_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, store(stage(spark, docs, SF), f"test-{name}")
        kept[name] = (before, docs)
        assert docs.columns == columns or name == "tokens"
    before, after = kept["exact_dedup"]
    first = {}
    for r in before.orderBy("doc_id").collect():
        first.setdefault(" ".join((r.text or "x").split()) if r.text else "", r.doc_id)
    assert {r.doc_id for r in after.collect()} == set(first.values())
    before, after = kept["near_dedup"]
    classes = brute_classes({r.doc_id: r.text for r in before.collect()})
    assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in classes.items() if i == c}
    before, after = kept["mixing"]
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(after.collect()) / words(before.collect()) - 1.5) < 0.1
    theirs = Tokenizer.from_file(VOCABULARY)
    texts = {r.doc_id: r.text for r in after.collect()}
    rows = kept["tokens"][1].collect()
    assert len(rows) == after.count()
    for r in rows:
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


CLASH = ("_copy", "size", "copies", "target", "kept", "chunks", "norm", "_toxic", "score", "row", "c0", "_s", "_start", "id")


def odd_documents(spark):
    plain = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "  ", plain, plain, plain + " more", plain + " other", "x " * 300_000, "short text", None]
    ids = [0, 1, 2, 3, 3, None, None, 7, 7, None]
    rows = [(i, t, "en", [None, "a"][n % 2], len(t or ""), *["kept as it is"] * len(CLASH)) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    layout = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return store(spark.createDataFrame(rows, layout), "odd-documents")


def test_stages_on_odd_rows(spark):
    """Null and shared ids, null, empty and long texts, repeated rows, columns with clashing names."""
    docs = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "exact_dedup", "near_dedup", "mixing"):
        got = stages[name](spark, docs, SF)
        assert got.columns == docs.columns
        rows = got.collect()
        assert all(r[c] == "kept as it is" for r in rows for c in CLASH)
        assert stages[name](spark, docs.where("false"), SF).count() == 0
        if name == "exact_dedup":
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 0), (False, 2), (False, 3), (False, 7), (False, 7), (True, 0), (True, 0)]
        if name == "near_dedup":
            # One of the four near copies stays, that of the smallest id; both texts of id 7 stay.
            assert sorted(((r.text or "").strip()[:5], r.doc_id) for r in rows if (r.text or "").strip()) == [("short", 7), ("w0 w1", 3), ("x x x", 7)]
            assert sum(not (r.text or "").strip() for r in rows) == 4


def test_operators_keep_clashing_columns(spark):
    from aerovox.llm import mixing, sharding

    docs = odd_documents(spark)
    names = ("_mark", "_worth", "_s", "_key", "_bucket", "_rank", "_ends", "_part")
    docs = docs.select("doc_id", "text", "source", *[F.lit("mine").alias(c) for c in names])
    for got in (sharding.shuffle_into_shards(docs, 3), mixing.mix_sources(docs)):
        assert got.columns[: len(docs.columns)] == docs.columns
        assert all(r[c] == "mine" for r in got.collect() for c in names)
    renamed = docs.withColumn("target", F.lit("mine"))
    assert "mine" not in {r.target for r in mixing.mix_sources(renamed).collect()}
