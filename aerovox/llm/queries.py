"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerovox.llm.bpe import token_digests
from aerovox.llm.common import table, word_count
from aerovox.llm.exact_dedup import exact_duplicates
from aerovox.llm.extraction import main_text
from aerovox.llm.fingerprints import compare_with_next
from aerovox.llm.licenses import BLOCK_WORDS, PHRASES, TEMPLATES, THRESHOLD, scan_licenses, template_sets
from aerovox.llm.line_dedup import dedup_lines
from aerovox.llm.merkle import build_manifest, fold, leaf_digest, proof_digest, prove
from aerovox.llm.mixing import mix_sources
from aerovox.llm.ngram_join import ngram_classes
from aerovox.llm.resampling import Resampling, resample
from aerovox.llm.sharding import shuffle_into_shards
from aerovox.llm.toxicity import held_out, score, train
from aerovox.llm.warc import round_trip

SHARDS = 16


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sharded = shuffle_into_shards(docs.select("doc_id", "text"), SHARDS)
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def op3_ngram_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))


def op4_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_levelled_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op6_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_best_scoring_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_label_model_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    toxic = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", toxic.alias("predicted"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mix_sources(sized, size=F.col("words"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op11_license_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op12_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    changed = F.when(chosen, F.replace(F.col("text"), F.lit("\n"))).otherwise(F.col("text"))
    tampered = leaf_digest(*[changed if c == "text" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    manifest = build_manifest(docs, carry={"doc_id": F.col("doc_id"), "tampered": tampered})
    proofs = prove(manifest, manifest.leaves)
    folded = proofs.withColumn("folded_root", fold(F.col("tampered"), F.col("lefts"), F.col("rights")))
    return folded.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_hypergeometric_shards, op2_prefix_hashes, op3_ngram_orders, op4_zstd_warc, op5_levelled_line_runs, op6_transducer_bpe, op7_best_scoring_run, op8_label_model_toxicity, op9_pareto_mix, op10_chunk_recipes, op11_license_similarity_join, op12_octopus_manifest, op13_segment_resampling)
}

_WS = "[\\x20\\x09-\\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: CRC-32 of a hex string's bytes: the table of 256 is made by rule, the bytes are folded over it.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS crcs
)"""


def _crc(value: str) -> str:
    byte = "CAST('0x' || substr(hex(encode(v)), 2 * i + 1, 2) AS BIGINT)".replace("v", value, 1)
    return (
        f"xor(4294967295, list_reduce(list_transform(range(strlen({value})), lambda i: {byte}),"
        " lambda c, b: xor(c // 256, crcs[xor(c % 256, b) + 1]), 4294967295))"
    )


def _phrase_places(phrase: str) -> str:
    same = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split(" ")))
    return f"list_filter(range(len(words)), lambda i: coalesce({same}, false))"


def _license_sql() -> str:
    values = ", ".join(
        f"({n}, '{label}', [{', '.join(repr(w) for w in words)}])" for n, (label, words) in enumerate(template_sets(TEMPLATES))
    )
    labels = ", ".join(f"CASE WHEN len({_phrase_places(p)}) > 0 THEN '{label}' END" for p, label in PHRASES.items())
    places = " || ".join(_phrase_places(p) for p in PHRASES)
    half = BLOCK_WORDS // 2
    return f"""
WITH templates(number, label, wanted) AS (VALUES {values}),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT r, doc_id, len(words) AS n_words, {places} AS spots, list_sort(list_filter([{labels}], lambda x: x IS NOT NULL)) AS base
  FROM (SELECT r, doc_id, {_WORDS} AS words FROM texts)
), lines AS (
  SELECT r, {_WORDS} AS words FROM (SELECT r, unnest(string_split(text, chr(10))) AS text FROM texts)
), blocks AS (
  SELECT r, words[s * {half} + 1 : s * {half} + {BLOCK_WORDS}] AS block FROM (
    SELECT r, words, unnest(range(1 + greatest(0, CAST(ceil((len(words) - {BLOCK_WORDS}) / {half}.0) AS BIGINT)))) AS s FROM lines
  )
), met AS (
  SELECT r, block, label, wanted, len(list_intersect(block, wanted)) / len(wanted) AS share
  FROM (SELECT DISTINCT r, block FROM blocks) JOIN templates ON list_has_any(block, wanted)
  WHERE len(list_intersect(block, wanted)) >= ceil(round({THRESHOLD} * len(wanted), 9))
), found AS (
  SELECT r, list(DISTINCT label) AS more, max(share) AS best FROM met m
  WHERE NOT EXISTS (
    SELECT 1 FROM met o WHERE o.r = m.r AND o.block = m.block AND len(o.wanted) > len(m.wanted) AND list_has_all(o.wanted, m.wanted)
  ) GROUP BY r
)
SELECT doc_id, n_words, len(spots) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  CASE WHEN len(spots) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM base LEFT JOIN found USING (r)"""


def _tree_sql(leaves: str, name: str) -> str:
    """All nodes of the trees of ``leaves`` (tree, i, d) as the table ``name``, and their siblings."""
    run = "PARTITION BY tree, level, i // 3 ORDER BY i ROWS BETWEEN"
    return f"""{name} AS (
  SELECT tree, 0 AS level, i, d, count(*) OVER (PARTITION BY tree) AS size FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (size + 2) // 3 FROM {name}
  WHERE size > 1 GROUP BY tree, level, i // 3, size
), {name}_sides AS (
  SELECT tree, level, i,
    coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE size > 1
)"""


def _walk_sql(start: str, tree: str, name: str) -> str:
    """The way up from every row of ``start`` (key, tree, i, proof, folded) in the trees ``tree``; one end per row."""
    return f"""{name} AS (
  SELECT key, tree, 0 AS level, i, proof, folded FROM ({start})
  UNION ALL
  SELECT key, w.tree, w.level + 1, w.i // 3, proof || s.l || s.r, sha256(s.l || folded || s.r)
  FROM {name} w JOIN {tree}_sides s ON s.tree = w.tree AND s.level = w.level AND s.i = w.i
), {name}_ends AS (
  SELECT key, tree, d, proof, folded FROM {name} JOIN (SELECT tree, level, d FROM {tree} WHERE size = 1) USING (tree, level)
)"""


def _merkle_sql() -> str:
    def part(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"

    fields = [part(c) for c in ("doc_id", "source", "lang", "n_chars")]
    whole, cut = (" || ".join([*fields, part(t)]) for t in ("text", "cut"))
    leaf = "SELECT doc_id AS key, tree, i, '' AS proof, claimed AS folded FROM placed"
    on = "SELECT key, s.tree, s.i, proof, folded FROM walk_ends w JOIN subroots s ON s.source = w.tree"
    return f"""
WITH RECURSIVE {_CRC_TABLE}, changed AS (
  SELECT *, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
  FROM documents, crc_table
), leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256({whole}) AS d, sha256({cut}) AS claimed FROM changed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM leaves
), {_tree_sql("placed", "nodes")}, subroots AS (
  SELECT tree AS source, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, d FROM nodes WHERE size = 1
), {_tree_sql("subroots", "crown")}, {_walk_sql(leaf, "nodes", "walk")}, {_walk_sql(on, "crown", "climb")}
SELECT p.doc_id, p.d AS leaf, w.d AS subroot, c.d AS root, sha256(c.proof) AS proof_sha256,
  c.folded AS folded_root, c.folded = c.d AS verified
FROM placed p JOIN walk_ends w ON w.key = p.doc_id JOIN climb_ends c ON c.key = p.doc_id"""


def _resampling_sql(how: Resampling) -> str:
    return f"""
WITH {_CRC_TABLE}, texts AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), wanted AS (
  SELECT unnest({_WORDS}) AS w FROM benchmark
), had AS (
  SELECT r, unnest(words) AS w FROM texts
), hashed AS (
  SELECT w, {_crc("w")} % {how.buckets} AS b FROM (SELECT w FROM had UNION SELECT w FROM wanted), crc_table
), s AS (SELECT b, count(*) AS n FROM had JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM wanted JOIN hashed USING (w) GROUP BY b),
gains AS (
  SELECT b.b, CAST(floor(1000 * ln(
    (coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM had) + {how.buckets})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {how.buckets})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT b FROM hashed) b LEFT JOIN s ON s.b = b.b LEFT JOIN t ON t.b = b.b
), weights AS (
  SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM had JOIN hashed USING (w) JOIN gains USING (b) GROUP BY r
), noise AS (
  SELECT r, doc_id, len(words) AS n, CAST('0x' || substr(sha256('{how.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 8) AS BIGINT) AS h FROM texts
), scored AS (
  SELECT r, doc_id, n, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM noise LEFT JOIN weights USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS able
  FROM scored WHERE n >= {how.least_words}
)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN place <= able * {how.percent} // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (r)"""


ORACLES: dict[str, str] = {
    "op4_zstd_warc": """
WITH bodies AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), firsts AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest,
    min(page_id) OVER (PARTITION BY body) AS first
  FROM bodies
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM firsts""",
    "op5_levelled_line_runs": f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {_CHARS}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.*, o.owner IS NULL OR o.owner = k.doc_id AS stays FROM keyed k LEFT JOIN owners o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op10_chunk_recipes": f"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)""",
    "op11_license_similarity_join": _license_sql(),
    "op12_octopus_manifest": _merkle_sql(),
    "op13_segment_resampling": _resampling_sql(Resampling()),
}
