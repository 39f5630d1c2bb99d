"""Byte-level BPE: a lexicon automaton for frequent words, exact merges for the others.

The vocabulary comes from a file in the format of the tokenizers library; its path is a
parameter. Frequent words of the corpus are counted in Spark, encoded once and compiled into the
automaton, which every worker maps into memory. The others are merged pair by pair in the order
of the merge list. Decoding looks the bytes of each id up.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerovox.llm import lexicon
from aerovox.llm.common import free_name, small_batches
from aerovox.session import store

#: Words that the lexicon holds at most.
LEXICON_WORDS = 1 << 17
#: Pieces of text whose ids a worker remembers, and the characters that such a piece has at most.
PIECES, PIECE_BYTES = 150_000, 64
#: Characters of text that are cut into pieces at a time.
BLOCK = 1 << 20
#: Words of more bytes than this are merged with a heap, one by one; shorter ones side by side.
SHORT = 32
#: Bytes that a word of the lexicon may have.
LEXICON_BYTES = 64

#: Words that are merged side by side.
SIDE_BY_SIDE = 4096
NEVER = 1 << 62

# The vocabulary's way of parting text into words, in the character classes of
# Unicode 16. White space:
WHITE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Code points that later editions of Unicode made letters or numbers, and that are neither here:
NEWER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    "\U0003d000-\U0003fc3f"
)
WORD = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{NEWER}]]+| ?[\p{{N}}--[{NEWER}]]+"
    rf"| ?[[^{WHITE}\p{{L}}\p{{N}}]||[{NEWER}]]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+",
    regex.V1,
)
# The same for texts in ASCII, where the library for it is faster.
ASCII_WORD = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII
)
# The same but for rare characters, for counting words in Spark.
_COUNTED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A space before anything but white space always begins a word.
_PIECES = re.compile(f" (?=[^{WHITE}])")
_ODD = re.compile(f" (?=[{WHITE}]|\\Z)")


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the file: printable ones for themselves, the others
    for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a vocabulary file says: bytes of each id, merges, special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        byte = _byte_alphabet()
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pieces = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.pieces[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.bytes = [ids[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a] << 32 | ids[b]] = rank << 32 | ids[a + b]
        # The same as sorted arrays, ending in a pair that there is not.
        pairs = sorted(self.merges)
        self.pairs = np.array([*pairs, 1 << 62], dtype=np.int64)
        self.into = np.array([*[self.merges[p] for p in pairs], NEVER], dtype=np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: of all neighbours that may merge, the pair of the lowest rank does,
        the leftmost of several, until none is left."""
        return self.merge_all([word])[0].tolist()

    def merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, as ``merge`` has them."""
        found: list[np.ndarray | None] = [None] * len(words)
        # Words of about one length side by side, so that few places stay empty.
        order = sorted((i for i, w in enumerate(words) if len(w) <= SHORT), key=lambda i: len(words[i]))
        for low in range(0, len(order), SIDE_BY_SIDE):
            some = order[low : low + SIDE_BY_SIDE]
            for i, ids in zip(some, self._merge_short([words[i] for i in some]), strict=True):
                found[i] = ids
        for i, word in enumerate(words):
            if found[i] is None:
                found[i] = np.array(self._merge_long([self.bytes[b] for b in word]), dtype="<u4")
        return found

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and result of merging each pair, ``NEVER`` where it does not; b < 0 is no neighbour."""
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((b >= 0) & (self.pairs[at] == pair), self.into[at], NEVER)

    def _merge_short(self, words: list[bytes]) -> list[np.ndarray]:
        """All words take a step at a time; a row ends in -1."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = int(lengths.max(initial=0)) + 1
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = np.full((len(words), width), -1, dtype=np.int64)
        ids[np.arange(width) < lengths[:, None]] = np.array(self.bytes, dtype=np.int64)[data]
        done: list[np.ndarray | None] = [None] * len(words)
        rows = np.arange(len(words))
        ranks = self._rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((len(words), 0), np.int64)
        places = np.arange(width)
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NEVER)
            over = low == NEVER
            ended = ids[over]
            there = ended >= 0
            flat, ends = ended[there].astype("<u4"), np.cumsum(there.sum(axis=1)).tolist()
            for r, a, b in zip(rows[over].tolist(), [0, *ends], ends, strict=False):
                done[r] = flat[a:b]
            going = ~over
            rows, ids, ranks, best, low = rows[going], ids[going], ranks[going], best[going], low[going]
            if not len(rows):
                break
            # The pair becomes one, and all behind it move up.
            shift = places[:-1] > best[:, None]
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            n = np.arange(len(rows))
            ids[n, best] = low & 0xFFFFFFFF
            ranks[:, :-1] = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NEVER
            after = np.minimum(best + 1, width - 1)
            ranks[n, best] = self._rank(ids[n, best], ids[n, after])
            before = np.flatnonzero(best)
            ranks[before, best[before] - 1] = self._rank(ids[before, best[before] - 1], ids[before, best[before]])
        return done

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            pair = ids[i] << 32 | ids[after[i]]
            if (m := get(pair)) is not None:
                heap.append((m >> 32, i, pair)) if not ready else heapq.heappush(heap, (m >> 32, i, pair))

        ready = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], ids[j] = get(pair) & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]


class Encoder:
    """Encodes texts to the bytes of little-endian 32-bit ids; remembers short pieces between texts."""

    def __init__(self, vocabulary: Vocabulary, words: lexicon.Lexicon) -> None:
        self.vocabulary, self.lexicon = vocabulary, words
        self.heads: dict[str, bytes] = {}  # pieces without a space in front
        self.tails: dict[str, bytes] = {}  # pieces after a space
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def encode(self, texts: list[str]) -> list[bytes]:
        found: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, str | bytes | None, list[str]]] = []
        size = 0
        for n, text in enumerate(texts):
            for part in self.special.split(text) if self.special else [text]:
                if part in self.vocabulary.special:
                    waiting.append((n, np.array([self.vocabulary.special[part]], dtype="<u4").tobytes(), []))
                    continue
                for head, tails, chars in self._cut(part):
                    waiting.append((n, head, tails))
                    size += chars
                    if size >= BLOCK:
                        self._flush(waiting, found)
                        size = 0
        self._flush(waiting, found)
        return [b"".join(parts) for parts in found]

    def _cut(self, text: str) -> Iterator[tuple[str | None, list[str], int]]:
        """By blocks: the piece at the beginning of the text, those after a space, and their size."""
        begin = 0
        while begin < len(text):
            end = len(text)
            if end - begin > BLOCK:
                # A block ends where a piece does; a text without spaces is one piece.
                cut = _PIECES.search(text, begin + BLOCK)
                end = cut.start() if cut else end
            part = text[begin:end]
            pieces = _PIECES.split(part) if _ODD.search(part) else part.split(" ")
            # A later block begins with a space, before which there is nothing.
            yield pieces[0] if begin == 0 else None, pieces[1:], end - begin
            begin = end

    def _flush(self, waiting: list, found: list[list[bytes]]) -> None:
        heads = self._known(self.heads, {h for _, h, _ in waiting if isinstance(h, str)}, "")
        tails: set[str] = set()
        for _, _, pieces in waiting:
            tails.update(pieces)
        tail = self._known(self.tails, tails, " ").__getitem__
        for n, head, pieces in waiting:
            if head is not None:
                found[n].append(head if isinstance(head, bytes) else heads[head])
            found[n].append(b"".join(map(tail, pieces)))
        waiting.clear()

    def _known(self, memory: dict[str, bytes], pieces: set[str], front: str) -> dict[str, bytes]:
        """The ids of at least these pieces with ``front`` before them. As many short ones as there is
        room for are remembered, the others known for this block only."""
        new = pieces.difference(memory)
        if not new:
            return memory
        if len(memory) >= PIECES and len(new) > 0.7 * len(pieces):
            memory.clear()  # the texts have become others
            new = pieces
        new, ascii_words, words_of = list(new), ASCII_WORD.findall, WORD.findall
        split = [ascii_words(front + p) if p.isascii() else words_of(front + p) for p in new]
        ids = self._words(set(chain.from_iterable(split))).__getitem__
        learned = dict(zip(new, [b"".join(map(ids, words)) for words in split], strict=True))
        room = PIECES - len(memory)
        kept = list(islice((p for p in learned if len(p) <= PIECE_BYTES), max(room, 0)))
        memory.update({p: learned[p] for p in kept})
        return memory if len(kept) == len(learned) else memory | learned

    def _words(self, words: set[str]) -> dict[str, bytes]:
        new = list(words)
        raw = [w.encode() for w in new]
        ids = self.lexicon.find(raw)
        unseen = [i for i, found in enumerate(ids) if found is None]
        for i, merged in zip(unseen, self.vocabulary.merge_all([raw[i] for i in unseen]), strict=True):
            ids[i] = merged
        return {word: found.tobytes() for word, found in zip(new, ids, strict=True)}


def compile_lexicon(df: DataFrame, vocabulary: Vocabulary, most: int = LEXICON_WORDS) -> str:
    """Counts the words of all texts, compiles the ``most`` frequent ones and hands the file to the
    executors. Returns the name under which they find it. Only ``most`` words of ``LEXICON_BYTES``
    bytes each reach the driver."""
    # What stands between spaces is counted first, so that each is cut into words once.
    pieces = df.select(F.explode(F.split("text", " ")).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    cut = F.regexp_extract_all(F.concat(F.lit(" "), "p"), F.lit(_COUNTED), F.lit(0))
    words = pieces.select("n", F.explode(cut).alias("w")).where(F.octet_length("w") <= LEXICON_BYTES)
    counts = words.groupBy("w").agg(F.sum("n").alias("c")).where("c > 1")
    counts = store(counts.withColumn("level", F.floor(F.log2("c") * 32).cast("int")), "word-counts")
    # As many levels of counts from the top as fit; there are few levels, whatever the corpus.
    levels, room = [], most
    for row in counts.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        room -= row.n
        if room < 0:
            break
        levels.append(row.level)
    top = counts.where(F.col("level") >= levels[-1]).select("w").collect() if levels else []
    frequent = sorted(row.w.encode() for row in top)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    ids = vocabulary.merge_all(frequent)
    lexicon.save(lexicon.build((w, i.tolist()) for w, i in zip(frequent, ids, strict=True)), path)
    df.sparkSession.sparkContext.addFile(path)
    return name


_ENCODERS: dict[str, Encoder] = {}  # of this worker


def _encoder(name: str, vocabulary: Vocabulary) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(vocabulary, lexicon.Lexicon(SparkFiles.get(name)))
    return _ENCODERS[name]


def encode(df: DataFrame, tokenizer: str, *, most: int = LEXICON_WORDS, column: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` as little-endian unsigned 32-bit integers in ``column``.

    Equal to what the tokenizers library gives for the vocabulary file ``tokenizer`` without adding
    special tokens; their strings in a text do become special ids. A null or empty text has no
    ids. An existing ``column`` is replaced; rows may repeat; an empty table gives an empty table.
    """
    spark = df.sparkSession
    small_batches(spark)
    df = df.drop(column)
    vocabulary = Vocabulary(tokenizer)
    name = compile_lexicon(df, vocabulary, most)
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = pa.array(encoder.encode(texts), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, `{column}` binary")


def decode(df: DataFrame, tokenizer: str, *, column: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``column``, special tokens included.

    Bytes that make no UTF-8 become replacement characters; null ids give a null text. An existing
    column ``text`` is replaced.
    """
    df = df.drop(text)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer).pieces)

    def words_of(data: bytes | None) -> str | None:
        if data is None:
            return None
        ids = np.frombuffer(data, dtype="<u4").tolist()
        return b"".join(map(shared.value.__getitem__, ids)).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([words_of(x) for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, text])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, `{text}` string")


def token_digests(df: DataFrame, tokenizer: str, *, id_column: str = "doc_id") -> DataFrame:
    """Round trip of every text: number of ids, digests of the ids and of the decoded text."""
    name = free_name(df, "ids")
    coded = encode(df.select(id_column, "text"), tokenizer, column=name)
    back = decode(coded.select(id_column, name), tokenizer, column=name, text="_decoded")
    return back.select(
        id_column,
        F.floor(F.octet_length(name) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(name), 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
