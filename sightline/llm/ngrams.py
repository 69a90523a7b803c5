"""Words and n-grams of texts as arrays, chunk by chunk, for the counting passes over a corpus.

A text is lower-cased (A-Z) and cut at ``BREAKS`` into pieces, and those at spaces and tabs into
words; an n-gram stays inside a piece. A chunk is some megabytes of texts of one group; its words
are numbers, so that everything but the splitting itself is array work.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Characters that end a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes(
    10 if i in BREAKS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256)
)
#: Bytes of text in a chunk. A longer piece (a run without any break) is a chunk of its own.
CHUNK = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Chunk:
    """Words of some texts of one group: ``word[i]`` numbers ``vocabulary``, -1 stands between pieces."""

    group: str
    vocabulary: list[bytes]
    word: np.ndarray

    def starts(self, n: int) -> np.ndarray:
        """Where an n-gram begins."""
        inside, size = self.word >= 0, max(len(self.word) - n + 1, 0)
        ok = np.ones(size, bool)
        for j in range(n):
            ok &= inside[j : j + size]
        return np.flatnonzero(ok)

    def hashes(self, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For n from 1 to ``longest``: places of the n-grams and 64-bit hashes of (group, words)."""
        seed = xxhash.xxh64_intdigest(self.group.encode())
        of_word = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary] + [0], np.uint64)
        single = of_word[self.word]
        out, rolled = [], single
        for n in range(1, longest + 1):
            if n > 1:
                rolled = mixed(rolled[:-1] * _ODD + single[n - 1 :])
            at = self.starts(n)
            out.append((at, rolled[at]))
        return out

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join([self.vocabulary[i] for i in self.word[at : at + n]])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of the numbers over all bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def _chunk(group: str, parts: list[bytes]) -> Chunk:
    number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    tokens = b"\n".join(parts).replace(b"\n", b" \n ").split(b" ")
    word = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    # Empty tokens (runs of spaces) go, line feeds separate the pieces.
    blank, feed = number.get(b"", -2), number.get(b"\n", -2)
    word = word[word != blank]
    word[word == feed] = -1
    return Chunk(group, list(number), word)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of (group, text as bytes) rows; null texts hold no words."""
    waiting: defaultdict[str, list[bytes]] = defaultdict(list)
    size: defaultdict[str, int] = defaultdict(int)
    for batch in batches:
        for group, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part in _parts((text.as_py() or b"").translate(_LOWER)):
                waiting[group].append(part)
                size[group] += len(part)
                if size[group] >= CHUNK:
                    yield _chunk(group, waiting.pop(group))
                    del size[group]
    for group, parts in waiting.items():
        yield _chunk(group, parts)


def _parts(text: bytes) -> Iterator[bytes]:
    """The text, cut between pieces where it is long."""
    at = 0
    while len(text) - at > CHUNK and (cut := text.find(b"\n", at + CHUNK)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]
