"""Hashes of words and word shingles of many texts at once, straight from Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are in memory as 64-bit numbers at a time.
BLOCK = 1 << 18

_RANDOM = np.random.default_rng(5)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_FAR = _RANDOM.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_TURN = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that part words: ASCII white space; and everything in ASCII but letters.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NO_LETTERS = (np.arange(256) < 128) & ~np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), starts


def word_hashes(data: np.ndarray, starts: np.ndarray, parts: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z taken as a-z, and the words before each text (one entry more)."""
    hashes, before = stem_hashes(data, starts, parts, ())
    return hashes[0], before


def stem_hashes(
    data: np.ndarray, starts: np.ndarray, parts: np.ndarray, stems: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, with a row of hashes for the words and one for their first bytes, for each
    number in ``stems``. Where a word has no more bytes than that, its own hash stands."""
    found, counts = [], np.zeros(len(starts), dtype=np.int64)
    n = len(starts) - 1
    begin, low = 0, int(starts[0])
    while begin < n:
        # Whole texts up to a block, or a part of one text that ends where a word does.
        end = max(begin + 1, int(np.searchsorted(starts, low + BLOCK, side="right")) - 1)
        high = int(starts[end])
        if end == begin + 1 and high - low > BLOCK:
            cut = low + BLOCK
            while cut < high:
                at = np.flatnonzero(parts[data[cut : min(high, cut + BLOCK)]])
                if len(at):
                    cut += int(at[0])
                    break
                cut = min(high, cut + BLOCK)
            high = cut
        inner = np.clip(starts[begin : end + 1], low, high) - low
        h, texts = _block(data[low:high], inner, parts, stems)
        found.append(h)
        counts[begin + 1 : end + 1] += np.bincount(texts, minlength=end - begin)[: end - begin]
        low = high
        begin = end if high == int(starts[end]) else begin
    words = np.concatenate(found, axis=1) if found else np.zeros((1 + len(stems), 0), np.uint64)
    return words, np.cumsum(counts)


def _block(data: np.ndarray, starts: np.ndarray, parts: np.ndarray, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    inside = ~parts[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = starts[:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros((1 + len(stems), 0), np.uint64), np.zeros(0, np.int64)
    begins = np.flatnonzero(first)
    runs = np.searchsorted(at, begins)
    lengths = np.diff(np.append(runs, len(at)))
    place = at - np.repeat(begins, lengths)
    weight = _PLACE[place & 4095]
    if lengths.max() > 4096:
        weight = weight * _FAR[(place >> 12) & 4095]
    terms = _BYTE[_LOWER[data[at]]] * weight
    rows = []
    for most in (None, *stems):
        kept = terms if most is None else np.where(place < most, terms, np.uint64(0))
        n = lengths if most is None else np.minimum(lengths, most)
        rows.append(mixed(np.add.reduceat(kept, runs) + n.astype(np.uint64) * _TURN[63]))
    return np.stack(rows), np.searchsorted(starts, begins, side="right") - 1


def shingle_sets(words: np.ndarray, before: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``k`` words as sorted signed numbers.

    A text of fewer words has one, all of it; a text without words has none.
    """
    whole = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for j in range(k if len(whole) else 0):
        whole += words[j : len(words) - k + 1 + j] * _TURN[j]
    whole = mixed(whole).view(np.int64)
    sets = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            few = (words[a:b] * _TURN[: b - a]).sum(dtype=np.uint64, keepdims=True) + _TURN[32 + b - a]
            sets.append(mixed(few).view(np.int64))
        else:
            sets.append(np.zeros(0, np.int64))
    return sets
