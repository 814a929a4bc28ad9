"""Distinct word-shingle hashes of whole texts, in numpy, a batch of documents at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.llm.common import IS_SPACE, U64, mix64, powers, seeded

BASE = 0x2545F4914F6CDD1D  # odd, hence invertible modulo 2 ** 64
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_WORDS = seeded(256, 11)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWERED = BYTE_WORDS[LOWER]
STEP = U64(0x9FB21C651E98DF25)


@dataclass
class Sets:
    """Sorted distinct shingle hashes of each document, one after another."""

    hashes: np.ndarray
    starts: np.ndarray  # n + 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.starts[i] : self.starts[i + 1]]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and per document the range of its words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    begins = np.flatnonzero(solid & (~before | fresh[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(LOWERED[data] * powers(BASE, n), out=sums[1:])
    hashes = mix64((sums[ends] - sums[begins]) * powers(INVERSE, n)[begins])
    return hashes, np.searchsorted(begins, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> Sets:
    """Distinct shingles of ``width`` words; fewer words make one shingle, no word an empty set."""
    words, bounds = word_hashes(data, offsets)
    docs, counts = len(offsets) - 1, np.diff(bounds)
    if len(words) == 0:
        return Sets(np.zeros(0, U64), np.zeros(docs + 1, np.int64))
    owner = np.repeat(np.arange(docs), counts)
    whole = len(words) - width + 1
    found_hash, found_doc = [], []
    if whole > 0:
        value = words[:whole].copy()
        for j in range(1, width):
            value *= STEP
            value += words[j : j + whole]
        inside = owner[:whole] == owner[width - 1 :]
        found_hash.append(value[inside])
        found_doc.append(owner[:whole][inside])
    for few in range(1, width):
        short = np.flatnonzero(counts == few)
        if len(short):
            at = bounds[:-1][short]
            value = words[at] + U64(few)
            for j in range(1, few):
                value = value * STEP + words[at + j]
            found_hash.append(value)
            found_doc.append(short)
    hashes, doc = mix64(np.concatenate(found_hash)), np.concatenate(found_doc)
    order = np.argsort(hashes)
    kind = np.uint16 if docs < 65536 else np.int64
    order = order[np.argsort(doc[order].astype(kind), kind="stable")]
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[first], doc[first]
    return Sets(hashes, np.searchsorted(doc, np.arange(docs + 1)))
