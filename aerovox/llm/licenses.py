"""License scans: set-similarity join of text blocks with license templates.

A block is a line of a text; a line of more than ``BLOCK_WORDS`` words is covered by runs of that many,
each beginning half a run after the last, so a passage of up to half a run is whole in one block. A
template is found in a block that holds at least ``threshold`` of its distinct words.

Words are ordered by how often the corpus has them, rarest first. Words that are in no template
never match, so a block's set is its words that some template has. If x of a template's t words have
to be found, one of its first t - x + 1 is among the first b - x + 1 of the block's b: only blocks
sharing such a prefix word are candidates, of those only the ones large enough, and of those the
ones where enough words remain behind the places at which the first common word stands. What passes
is compared word by word, so the join is exact.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovox.llm.common import two_hashes, words_of

BLOCK_WORDS = 64
THRESHOLD = 0.9
#: Templates are an argument and go to every task; more than this many words are refused.
MOST_WORDS = 100_000

#: Phrases whose places are reported, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences by which public licenses are named or begin.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "Released under the BSD License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "Licensed under CC0 1.0 Universal"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("proprietary", "may not be reproduced or distributed without the prior written permission of the publisher"),
)


def template_sets(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str]]]:
    """Label and distinct words of each template, split as a document is; empty ones are left out."""
    found = []
    for label, text in templates:
        kept = "".join(c if c.isdigit() or "a" <= c <= "z" or ord(c) > 127 else " " for c in text.translate(_LOWER))
        words = sorted(set(kept.split(" ")) - {""})
        if words:
            found.append((label, words))
    if sum(len(words) for _, words in found) > MOST_WORDS:
        raise ValueError(f"templates may have {MOST_WORDS} words in all")
    return found


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def blocks(words: Column) -> Column:
    """The blocks of a line's words, each with the number of its first word in the line."""
    half = BLOCK_WORDS // 2
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - BLOCK_WORDS) / half).cast("int"))

    def run(at: Column) -> Column:
        # Word by word: a slice looks at the whole line each time.
        return F.transform(F.sequence(at, F.least(at + BLOCK_WORDS, F.size(words)) - 1), lambda k: F.get(words, k))

    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * half).alias("at"), run(i * half).alias("words")))


def find_templates(
    texts: DataFrame,
    keys: tuple[str, ...],
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    *,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every block of ``texts`` (``keys`` and ``text``) and template that meet ``threshold``.

    Rows: ``keys``, ``line`` (its number in the text, from 0), ``at`` (the block's first word in the line), ``template``
    (its number), ``label``, ``overlap``, ``containment``, and ``part_of_wider``: whether another template found in
    the block has all words of this one and more. Null and empty texts match nothing. Rows alike in
    ``keys`` have to have the same text, and are matched once. No rows or no templates give no rows.
    """
    spark = texts.sparkSession
    sets = template_sets(templates)
    known = sorted({w for _, words in sets for w in words})
    rank = _ranks(texts, known)
    prefixes = []
    for number, (label, words) in enumerate(sets):
        need = ceil(round(threshold * len(words), 9))
        wanted = sorted(rank[w] for w in words)
        prefixes += [(number, label, wanted, need, i, r) for i, r in enumerate(wanted[: len(wanted) - need + 1])]
    # Both tables are no larger than the templates.
    order = F.broadcast(spark.createDataFrame(list(rank.items()), "word string, rank int"))
    first = sorted({r for *_, r in prefixes})
    starters = [w for w, r in rank.items() if r in set(first)]
    prefixes = F.broadcast(
        spark.createDataFrame(prefixes, "template int, label string, wanted array<int>, need int, i int, rank int")
    )

    def starts(words: Column) -> Column:
        return F.exists(words, lambda w: w.isin(starters))

    lines = texts.select(*keys, F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line", "text"))
    lines = lines.withColumn("words", words_of(F.col("text"))).where(starts(F.col("words")))
    parts = lines.select(*keys, "line", F.explode(blocks(F.col("words"))).alias("b")).where(starts(F.col("b.words")))
    block = [*keys, "line", "at"]
    words = parts.select(*keys, "line", "b.at", F.explode(F.array_distinct("b.words")).alias("word")).join(order, "word")
    have = words.groupBy(*block).agg(F.sort_array(F.collect_set("rank")).alias("have"))

    met = have.select("*", F.posexplode("have").alias("j", "rank")).join(prefixes, "rank")
    size, total = F.size("have"), F.size("wanted")
    # Length, and the block's own prefix.
    met = met.where((size >= F.col("need")) & (F.col("j") <= size - F.col("need")))
    met = met.groupBy(*block, "template", "label").agg(F.min(F.struct("i", "j", "have", "wanted", "need")).alias("m"))
    met = met.select(*block, "template", "label", "m.*")
    # Place of the first common word.
    met = met.where(1 + F.least(total - F.col("i") - 1, size - F.col("j") - 1) >= F.col("need"))
    overlap = F.size(F.array_intersect("have", "wanted"))
    met = met.withColumn("overlap", overlap).where("overlap >= need").withColumn("containment", F.col("overlap") / total)
    found = ("template", "label", "overlap", "containment")
    # No more of them in a block than there are templates.
    met = met.groupBy(*block).agg(F.collect_list(F.struct(*found, "wanted")).alias("all"))
    met = met.select(*block, "all", F.explode("all").alias("m"))
    wider = F.exists("all", lambda o: (F.size(o["wanted"]) > F.size("m.wanted")) & (F.size(F.array_except("m.wanted", o["wanted"])) == 0))
    return met.select(*block, *[f"m.{c}" for c in found], wider.alias("part_of_wider"))


def _ranks(texts: DataFrame, known: list[str]) -> dict[str, int]:
    """The words of the templates by how often the corpus has them; no more than they are is collected."""
    if not known:
        return {}
    words = texts.select(words_of(F.col("text")).alias("words"))
    words = words.select(F.explode(F.filter("words", lambda w: w.isin(known))).alias("word"))
    often = {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}
    return {w: i for i, w in enumerate(sorted(known, key=lambda w: (often.get(w, 0), w)))}


def phrase_places(words: Column, phrase: str) -> Column:
    """Numbers, from 0, of the words at which ``phrase`` begins."""
    wanted = phrase.split(" ")

    def here(i: Column) -> Column:
        found = F.lit(True)
        for k, word in enumerate(wanted):
            found = found & (F.get(words, i + k) == F.lit(word))
        return found

    return F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.coalesce(here(i), F.lit(False)))


def scan_licenses(
    docs: DataFrame,
    *,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score``.

    ``n_base`` counts the places of all phrases; the two word numbers are the smallest and the largest of
    them, null without any. Labels are distinct, sorted and joined by commas, empty without any.
    ``labels`` are those of the phrases and of the templates found, but for templates that are part of a wider one
    there. ``score`` is 1 where a phrase stands, else the highest containment of these, else 0. A null text has no
    words, like an empty one. Rows alike in id and text have the same result, each its own row; a null
    id is an id like any other. Only id and text are read, so other columns may have any name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    h1, h2 = two_hashes(F.col("text"))
    texts = texts.withColumn("h1", h1).withColumn("h2", h2)
    key = ("id", "h1", "h2")

    found = find_templates(texts, key, templates, threshold=threshold)
    # "CC BY 4.0" is said by "CC BY-NC 4.0" only in passing.
    found = found.where("not part_of_wider").groupBy(*key).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))

    none = F.array().cast("array<int>")
    base = texts.withColumn("words", words_of(F.col("text")))
    # Most texts have none of the words that a phrase begins with: these are not looked at further.
    opening = sorted({p.split(" ")[0] for p in phrases})
    maybe = F.exists("words", lambda w: w.isin(opening)) if opening else F.lit(False)
    base = base.select(
        *key,
        F.size("words").cast("long").alias("n_words"),
        *[F.when(maybe, phrase_places(F.col("words"), p)).otherwise(none).alias(f"p{i}") for i, p in enumerate(phrases)],
    )
    at = F.concat(none, *[F.col(f"p{i}") for i in range(len(phrases))])
    labels = [F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]
    base = base.select(
        *key,
        "n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *labels)))).alias("base"),
    )
    alike = [F.col(f"b.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    both = base.alias("b").join(found.alias("f"), alike, "left")
    all_labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select(
        F.col("b.id").alias(id_column), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), score.alias("score"),
    )
