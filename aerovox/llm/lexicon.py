"""A minimal acyclic transducer from words to token ids, in arrays that can be memory-mapped.

Words are byte strings. States with equal futures are one state, so frequent suffixes are stored
once. Every arc carries how many words of its state come before it in order; these outputs add up
along a path to the number of the word, under which its ids are found.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np

_FILES = ("keys", "targets", "outputs", "final", "ends", "ids")


def build(entries: Iterable[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """Arrays of the automaton for (word, ids), which have to come in the order of the words.

    States are registered as soon as no later word can change them, so at any time only the path
    of the last word is not minimal yet.
    """
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []  # of registered states, targets being registered
    final: list[bool] = []
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]  # states of the last word
    last = b""
    ends, ids = [0], []

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            accepts, out = path.pop()
            key = (accepts, tuple(out))
            if key not in register:
                register[key] = len(arcs)
                arcs.append(out)
                final.append(accepts)
            path[-1][1].append((last[len(path) - 1], register[key]))

    for word, codes in entries:
        common = len(os.path.commonprefix([word, last]))
        close(common)
        path.extend((False, []) for _ in word[common:])
        path[-1] = (True, path[-1][1])
        last = word
        ids.extend(codes)
        ends.append(len(ids))
    close(0)
    root = len(arcs)
    arcs.append(path[0][1])
    final.append(path[0][0])

    words_from = np.zeros(len(arcs), dtype=np.int64)  # words that a state still accepts
    keys, targets, outputs = [], [], []
    for state, out in enumerate(arcs):  # targets come before their sources
        before = int(final[state])
        for byte, target in out:
            keys.append(state << 8 | byte)
            targets.append(target)
            outputs.append(before)
            before += int(words_from[target])
        words_from[state] = before
    return {
        "keys": np.array(keys, dtype=np.int64),
        "targets": np.array(targets, dtype=np.int32),
        "outputs": np.array(outputs, dtype=np.int32),
        "final": np.array([*final, root], dtype=np.int32),
        "ends": np.array(ends, dtype=np.int64),
        "ids": np.array(ids, dtype=np.uint32),
    }


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: a header with the lengths in bytes, then the arrays."""
    with open(path, "wb") as out:
        out.write(np.array([arrays[k].nbytes for k in _FILES], dtype=np.int64).tobytes())
        for k in _FILES:
            out.write(arrays[k].tobytes())


class Lexicon:
    """Looks words up in a saved automaton; the file is mapped, so workers share its pages."""

    _TYPES = (np.int64, np.int32, np.int32, np.int32, np.int64, np.uint32)

    def __init__(self, path: str) -> None:
        sizes = np.fromfile(path, dtype=np.int64, count=len(_FILES)).tolist()
        data = np.memmap(path, dtype=np.uint8, mode="r")
        at = 8 * len(_FILES)
        for name, size, kind in zip(_FILES, sizes, self._TYPES, strict=True):
            setattr(self, name, np.frombuffer(data, dtype=kind, count=size // kind().nbytes, offset=at))
            at += size
        self.root = int(self.final[-1]) if len(self.final) else 0

    def find(self, words: list[bytes]) -> list[np.ndarray | None]:
        """The ids of each word, None where the lexicon lacks it. All words walk in step."""
        n = len(words)
        if not n or not len(self.keys):
            return [None] * n
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        state = np.full(n, self.root, dtype=np.int64)
        number = np.zeros(n, dtype=np.int64)
        alive = np.flatnonzero(lengths > 0)
        state[lengths == 0] = -1
        step = 0
        while len(alive):
            key = state[alive] << 8 | data[starts[alive] + step]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            state[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            state[alive] = self.targets[at]
            number[alive] += self.outputs[at]
            step += 1
            alive = alive[lengths[alive] > step]
        known = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        ids, number = self.ids, np.where(known, number, 0)
        begins, ends = self.ends[number].tolist(), self.ends[number + 1].tolist()
        return [ids[a:b] if ok else None for a, b, ok in zip(begins, ends, known.tolist(), strict=True)]
