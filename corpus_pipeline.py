"""Training corpus: from raw documents to token ids, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written and read again before the next one sees it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerovox.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from aerovox.session import store


# In every stage null and empty texts are documents like any other, texts may be of any length, an empty
# table gives an empty table, and columns beside those of documents stay, whatever their names.


def _numbered(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``used`` by number, and all of them under their own names again."""
    own = {c: c if c in used else f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()]), [F.col(o).alias(c) for c, o in own.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go, each row by its own text. Repeated rows go or
    stay together."""
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    numbered, named = _numbered(docs, "text")
    return toxicity.score(numbered, model).where("score < 0.5").select(*named)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one of the smallest id stays, a null id being the largest; of
    rows that share it, one."""
    numbered, named = _numbered(docs, "doc_id", "text")
    # Only the numbers of rows go through the operator, not the documents. A stage reads a written
    # table, so a row has the same number whenever it is read.
    numbered = numbered.withColumn("row", F.monotonically_increasing_id())
    found = exact_dedup.exact_duplicates(numbered.select("doc_id", "text", "row"), carry=("row",))
    gone = store(found.where("not kept").select("row"), "copies")
    return numbered.join(gone, "row", "left_anti").select(*named)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest id stays, a null id being the largest; of
    rows that share it, one. Documents without words are near copies of nothing."""
    # Rows are told apart by number, as ids may be missing or shared.
    numbered, named = _numbered(docs, "doc_id", "text")
    numbered = numbered.withColumn("row", F.monotonically_increasing_id())
    classes = ngram_join.ngram_classes(numbered.select("row", "text"), id_column="row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    groups = store(classes.select("row", "component_id"), "near-copies").join(numbered.select("row", "doc_id"), "row")
    stays = store(groups.groupBy("component_id").agg(first).select("first.row"), "near-copies-stay")
    return numbered.join(stays, "row", "left_semi").select(*named)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source by its target weight; a row stands there once for each of its copies. A null source
    is a source; documents without words are in no copy."""
    numbered, named = _numbered(docs, "doc_id", "source", "text")
    mixed = mixing.mix_sources(numbered).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*named)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every document, and how many."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("tokens", tokenize),
]

#: The classifier and the random sample have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
