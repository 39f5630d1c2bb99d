"""Toxicity by weak supervision.

Many voters look at a text: lexicons of words and of stems (first bytes of words, for languages
that inflect), some written down and some mined from labelled rows, and patterns. Each says toxic, clean or nothing. A generative model of their votes estimates how often
each is right, and which of them depend on one another, from a sample of rows without looking at
labels. Its posterior probabilities are the labels that a linear classifier learns from; the
classifier scores all texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovox.llm.common import small_batches, uniform
from aerovox.llm.words import NO_LETTERS, mixed, stem_hashes, text_bytes, word_hashes

#: Rows that the model is fitted on, at most: labelled ones first, then others; and their bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 5000, 1 << 14
#: Bytes of the stems that are looked at.
STEMS = (4, 5, 6, 7)
#: Evidence (twice the log likelihood ratio) and documents that a mined word or stem needs.
MINED_EVIDENCE, MINED_SUPPORT = 25.0, 5
#: Buckets of hashed words that the linear classifier sees besides the voters' hits.
BUCKETS = 1 << 15
#: Correlation, beyond what the class explains, from which two voters share their weight.
DEPENDENT = 0.2

# Written lexicons, each a voter of its own.
LEXICONS = {
    "stupid": "idiot idiots idiotic moron morons moronic imbecile stupid stupidity dumb dumbass fool fools cretin "
    "dimwit halfwit brainless dunce retard retarded",
    "worthless": "loser losers worthless useless pathetic failure nobody incompetent",
    "filth": "scum trash garbage filth filthy vermin parasite scumbag dirtbag lowlife",
    "loathing": "disgusting revolting repulsive vile sickening nasty despicable creep",
    "mockery": "clown clowns buffoon laughable ridiculous joke freak weirdo",
    "threat": "kill hang murder destroy shoot",
    "curse": "damn crap shit bitch bastard asshole fuck fucking whore slut",
    "german": "idioten dummkopf trottel abschaum versager widerlich schwachkopf arschloch",
    "french": "imbécile crétin abruti ordure minable salaud connard dégoûtant",
    "spanish": "idiota imbécil estúpido basura inútil asqueroso escoria payaso",
}
YOU = "you your yours youre dein deine ton tes usted"


def hashes_of(words: str) -> np.ndarray:
    data = words.encode()
    found, _ = word_hashes(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), NO_LETTERS)
    return np.unique(found)


@dataclass
class Texts:
    """What is looked at in some texts."""

    hashes: np.ndarray  # of each word, and of each of its stems
    of: np.ndarray  # text of each word
    n: np.ndarray  # words of each text
    bangs: np.ndarray  # exclamation marks of each text

    @classmethod
    def read(cls, column: pa.Array) -> Texts:
        data, starts = text_bytes(column)
        hashes, before = stem_hashes(data, starts, NO_LETTERS, STEMS)
        n = np.diff(before)
        marks = np.concatenate([[0], np.cumsum(data[starts[0] : starts[-1]] == ord("!"))])
        return cls(hashes, np.repeat(np.arange(len(n)), n), n, np.diff(marks[starts - starts[0]]))

    @property
    def words(self) -> np.ndarray:
        return self.hashes[0]

    def hits(self, lexicon: np.ndarray, rows: slice = slice(0, 1)) -> np.ndarray:
        """Words of each text of which one of the hashes is in the lexicon."""
        if not len(lexicon) or not len(self.of):
            return np.zeros(len(self.n), dtype=np.int64)
        hit = np.zeros(len(self.of), dtype=bool)
        for h in self.hashes[rows]:
            at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
            hit |= lexicon[at] == h
        return np.bincount(self.of[hit], minlength=len(self.n))


ABSTAIN, CLEAN, TOXIC = 0, 1, 2


@dataclass
class Model:
    lexicons: list[np.ndarray]  # of words
    stems: np.ndarray
    weights: np.ndarray  # of the features of hits and of buckets
    bias: float

    def counts(self, texts: Texts) -> np.ndarray:
        """Hits of each text in each lexicon of words, and in that of stems."""
        return np.stack([*map(texts.hits, self.lexicons), texts.hits(self.stems, slice(1, None))], axis=1)

    def score(self, texts: Texts) -> np.ndarray:
        few = _hit_features(self.counts(texts), texts.n)
        z = self.bias + few @ self.weights[: few.shape[1]]
        if len(texts.of):
            buckets = self.weights[few.shape[1] :][(texts.words & np.uint64(BUCKETS - 1)).astype(np.int64)]
            z = z + np.bincount(texts.of, weights=buckets, minlength=len(z)) / np.sqrt(np.maximum(texts.n, 1))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _hit_features(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each lexicon's hits up to 3; several hits of words or stems; and how dense the hits are."""
    words, stems = counts[:, :-1].sum(axis=1), counts[:, -1]
    dense = np.minimum((words + stems) / np.maximum(n, 1) / DENSE, 2.0)
    return np.column_stack([np.minimum(counts, 3) / 3.0, words >= 2, stems >= 2, stems >= 3, dense / 2.0, (dense > 1) & (stems >= 2)])


#: Share of hits from which a text is full of them.
DENSE = 0.005


# --- fitting, on a bounded sample ----------------------------------------------------------


#: A written word goes if it is in this many labelled documents, and most of them are clean.
CONTRADICTED = 3


#: Bands of equal minima over word pairs, and minima in a band: two texts that share over half of
#: their pairs agree in one nearly always, unrelated ones hardly ever.
BANDS, BAND_ROWS = 24, 3


def near_copies(texts: Texts) -> np.ndarray:
    """A number per text, equal for texts that agree in all minima of a band, or are linked so."""
    n = len(texts.n)
    parent = np.arange(n)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = texts.words.copy()
    pairs[:-1] += texts.words[1:] * np.uint64(0x9E3779B97F4A7C15)
    some = np.flatnonzero(texts.n > 0)
    starts = (np.cumsum(texts.n) - texts.n)[some]
    salts = np.random.default_rng(8).integers(0, 2**64, (BANDS, BAND_ROWS), dtype=np.uint64)
    for band in salts:
        key = np.zeros(len(some), dtype=np.uint64)
        for salt in band:
            key = mixed(key + np.minimum.reduceat(mixed(pairs ^ salt), starts)) if len(some) else key
        order = np.argsort(key, kind="stable")
        for i in np.flatnonzero(key[order][1:] == key[order][:-1]):
            a, b = top(some[order[i]]), top(some[order[i + 1]])
            parent[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)])


def _documents_of(hashes: np.ndarray, of: np.ndarray, toxic: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Which hashes there are, how many documents have each at least ``least`` times, and how many
    of these are toxic."""
    order = np.lexsort((of, hashes))
    h, d = hashes[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    first = first[np.diff(np.append(first, len(h))) >= least]
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    values, at = np.unique(h[first], return_inverse=True)
    return values, np.bincount(at).astype(float), np.bincount(at, weights=toxic[d[first]].astype(float))


def _telling(values: np.ndarray, every: np.ndarray, bad: np.ndarray, base: float) -> np.ndarray:
    """Hashes that stand in toxic documents far more often than by chance."""
    good = every - bad
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * np.where(bad > 0, bad * np.log(bad / every / base), 0)
        evidence += 2 * np.where(good > 0, good * np.log(good / every / (1 - base)), 0)
    return values[(bad >= MINED_SUPPORT) & (bad / np.maximum(every, 1) > 0.5) & (evidence >= MINED_EVIDENCE)]


def learned_lexicons(texts: Texts, labels: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The written lexicons without words that the labels contradict, one of mined words, and the
    mined stems. ``labels``: 1, 0 or -1 for unknown. Near copies count as one document, with the
    label that most of them have. A stem counts where it stands twice: once it may be chance."""
    none = np.zeros(0, np.uint64)
    written = [hashes_of(x) for x in LEXICONS.values()]
    known = labels >= 0
    if not known.any() or not len(texts.of):
        return [*written, none], none
    group = near_copies(texts)
    votes = np.bincount(group[known], weights=labels[known] * 2.0 - 1, minlength=len(group))
    toxic = votes > 0
    base = float(np.clip(toxic[np.unique(group[known])].mean(), 1e-3, 0.999))
    # Of near copies one stands for all, so that a word that stands once in each isn't there twice.
    use = (known & (group == np.arange(len(group))) | ~known[group] & known)[texts.of]
    of = group[texts.of[use]]
    words, every, bad = _documents_of(texts.words[use], of, toxic, 1)
    wrong = words[(every >= CONTRADICTED) & (bad / np.maximum(every, 1) < 0.5)]
    mined = _telling(words, every, bad, base)
    stems = [_telling(*_documents_of(h[use], of, toxic, 2), base) for h in texts.hashes[1:]]
    return [*[np.setdiff1d(x, wrong) for x in written], mined], np.unique(np.concatenate(stems))


def votes_of(texts: Texts, counts: np.ndarray) -> np.ndarray:
    """A row per text, a column per voter: ABSTAIN, CLEAN or TOXIC."""
    toxic = lambda which: np.where(which, TOXIC, ABSTAIN)
    words, stems, n = counts[:, :-1], counts[:, -1], np.maximum(texts.n, 1)
    total = words.sum(axis=1) + stems
    columns = [toxic(words[:, k] > 0) for k in range(words.shape[1])]
    columns += [
        toxic((stems >= 2) & (stems > DENSE * n)),
        toxic((stems >= 4) & (stems > 2 * DENSE * n)),
        toxic((total >= 2) & (total > DENSE * n)),  # more than a slip
        toxic((words > 0).sum(axis=1) >= 2),  # of several kinds
        toxic((total >= 2) & (texts.hits(hashes_of(YOU)) > 0)),  # said to somebody
        toxic(texts.bangs > 0.2 * n),  # shouted
        np.where((total == 0) & (texts.n >= 5), CLEAN, ABSTAIN),  # nothing found in a real text
        np.where(total <= np.maximum(1, DENSE * n / 2), CLEAN, ABSTAIN),  # next to nothing found
    ]
    return np.stack(columns, axis=1)


def posterior(votes: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Probability that each row is toxic, by expectation maximisation over what each voter says
    in each class. Voters that agree beyond what the class explains are down-weighted: the model is
    fitted, their correlations given the class are measured, and it is fitted again."""
    n, k = votes.shape
    said = np.stack([votes == v for v in (ABSTAIN, CLEAN, TOXIC)], axis=2).astype(float)
    share = np.ones(k)
    q = np.where((votes == TOXIC).sum(axis=1) > (votes == CLEAN).sum(axis=1), 0.9, 0.05)
    for fit in range(2):
        for _ in range(rounds):
            prior = np.clip(q.mean(), 0.01, 0.6)
            tables = [_table(said, w, c) for w, c in ((q, TOXIC), (1 - q, CLEAN))]
            ratio = np.log(tables[0]) - np.log(tables[1])
            z = np.log(prior / (1 - prior)) + np.einsum("nkv,kv,k->n", said, ratio, share)
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if fit == 0:
            loud = (votes == TOXIC) * 1.0 - (votes == CLEAN)
            mean = [(loud * w[:, None]).sum(axis=0) / max(w.sum(), 1e-9) for w in (q, 1 - q)]
            rest = loud - q[:, None] * mean[0] - (1 - q)[:, None] * mean[1]
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            together = np.abs(rest.T @ rest / n / spread[:, None] / spread[None, :])
            np.fill_diagonal(together, 0)
            share = 1 / (1 + np.where(together > DEPENDENT, together, 0).sum(axis=1))
    return q


def _table(said: np.ndarray, weight: np.ndarray, own: int) -> np.ndarray:
    """Of each voter the chances of what it says in a class; a voter is expected to be right."""
    start = np.full((said.shape[1], 3), 0.5)
    start[:, own] = 1.5
    counts = np.einsum("nkv,n->kv", said, weight) + start
    return counts / counts.sum(axis=1, keepdims=True)


def fit(texts: Texts, labels: np.ndarray) -> Model:
    lexicons, stems = learned_lexicons(texts, labels)
    model = Model(lexicons, stems, np.zeros(0), -2.0)
    counts = model.counts(texts)
    few = _hit_features(counts, texts.n)
    if not len(texts.n):  # nothing to learn from: any hit counts
        model.weights = np.concatenate([np.full(few.shape[1], 3.0), np.zeros(BUCKETS)])
        return model
    target = posterior(votes_of(texts, counts))
    model.weights, model.bias = _logistic(texts, few, target)
    return model


def _logistic(texts: Texts, few: np.ndarray, target: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by gradient descent with momentum; buckets of words are
    held close to zero, so they decide only what the voters leave open."""
    bucket = (texts.words & np.uint64(BUCKETS - 1)).astype(np.int64)
    value = 1 / np.sqrt(np.maximum(texts.n, 1))
    w, b, many = np.zeros(few.shape[1]), 0.0, np.zeros(BUCKETS)
    n, speed = len(target), [np.zeros_like(w), 0.0, np.zeros(BUCKETS)]
    for _ in range(rounds):
        z = b + few @ w + np.bincount(texts.of, weights=many[bucket], minlength=n) * value
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        by_word = np.bincount(bucket, weights=(error * value)[texts.of], minlength=BUCKETS)
        grads = (few.T @ error / n + 1e-4 * w, error.mean(), by_word / n + 1e-2 * many)
        speed = [0.9 * s - g for s, g in zip(speed, grads, strict=True)]
        w, b, many = w + 2.0 * speed[0], b + 2.0 * speed[1], many + 0.2 * speed[2]
    return np.concatenate([w, many]), float(b)


# --- tables --------------------------------------------------------------------------------


def held_out(ident: Column) -> Column:
    """Rows whose labels are never learned from; a null id has no label anyway."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, most: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``most`` ids of ``docs`` (doc_id, text) that aren't held out: those with a
    label (doc_id, toxic), and if they are fewer, others. Which ids depends on their hash. Texts of
    more than ``SAMPLE_BYTES`` are scored but not fitted on."""
    spark = docs.sparkSession
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.where(~held_out(F.col("doc_id"))).select("doc_id").join(marks, "doc_id", "left")
    ids = ids.withColumn("luck", uniform(F.lit(8), F.col("doc_id"))).where(F.col("doc_id").isNotNull())
    with_label, all_ = ids.agg(F.count("toxic"), F.count("*")).first()
    # Thin the rows by their hash first, so few of them are sorted.
    enough = lambda wanted, n: F.lit(min(1.0, 1.5 * wanted / max(n, 1) + 100 / max(n, 1)))
    rest = max(0, most - with_label)
    near = F.when(F.col("toxic").isNotNull(), enough(most, with_label)).otherwise(enough(rest, all_ - with_label))
    chosen = ids.where(F.col("luck") < near).orderBy(F.col("toxic").isNull(), "luck", "doc_id").limit(most).collect()
    known = {r.doc_id: -1 if r.toxic is None else int(r.toxic) for r in chosen}
    if not known:
        return fit(Texts.read(pa.array([], pa.string())), np.zeros(0, np.int64))
    picked = spark.createDataFrame([(int(i),) for i in known], "doc_id long")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = found.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(picked), "doc_id")
    # The bounded sample is fitted on in one task; only the model comes back.
    found = found.repartition(1).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(batch.column("doc_id"), batch.column("text")) for batch in batches]
        marks = np.array([known[i] for ids, _ in rows for i in ids.to_pylist()], dtype=np.int64)
        texts = Texts.read(pa.concat_arrays([pa.array([], pa.string()), *[text.cast(pa.string()) for _, text in rows]]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(fit(texts, marks)))], pa.binary())], ["model"])

    return Model(**pickle.loads(found.mapInArrow(run, "model binary").first().model))


def score(docs: DataFrame, model: Model, *, column: str = "score") -> DataFrame:
    """``docs`` with the probability that ``text`` is toxic; null and empty texts have one too.

    Only the text is looked at. Rows may repeat; other columns stay; ``column`` is replaced; an
    empty table gives an empty table.
    """
    small_batches(docs.sparkSession, 1)
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(shared.value.score(Texts.read(batch.column("text"))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{column}` double")
