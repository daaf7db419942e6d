"""SuperMinHash signatures of word-shingle sets, many documents at a time.

Each element walks a permutation of the registers of its own (Fisher-Yates, drawn from its hash);
at step j it offers j + u, 0 <= u < 1, to the register it stands on, and a register keeps the least
offer. All elements of a batch take step j together; as an offer of step j + 1 is above all offers
of step j, a document stops as soon as each of its registers has one.
"""

from __future__ import annotations

import numpy as np
import xxhash

from tessel.llm.common import release_memory

#: A-Z to a-z, other bytes as they are; bytes.split() then cuts at 0x20 and 0x09-0x0D.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
EMPTY = np.uint32(2**32 - 1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = WordHashes()


def forget() -> None:
    """For the end of a task, as its worker process lives on."""
    _hashes.clear()
    release_memory()


def word_hashes(text: bytes) -> np.ndarray:
    words = text.translate(FOLD).split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(h: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash of each run of `size` words, from the words' hashes; fewer words make one."""
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * GOLDEN + h[k : len(h) - size + 1 + k])
    return out


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    return np.unique(shingle_hashes(word_hashes(text), size))


def signatures(elements: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """A row of registers for each document; `elements` holds the sets one after the other. Empty sets give EMPTY."""
    table = np.full((len(counts), registers), EMPTY, dtype=np.uint32)
    flat, doc = table.reshape(-1), np.repeat(np.arange(len(counts)), counts)

    def draw(x: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        u = mix(x + np.uint64((step + 1) * int(GOLDEN) % 2**64))
        low = (u & np.uint64(0xFFFFFFFF)) * np.uint64(registers - step) >> np.uint64(32)
        return (u >> np.uint64(40)).astype(np.uint32) | np.uint32(step << 24), low.astype(np.int64) + step

    def open_rows(d: np.ndarray) -> np.ndarray:
        return (table == EMPTY).any(axis=1)[d]

    # two steps by formula: the permutation is the identity but for the places swapped
    value, first = draw(elements, 0)
    np.minimum.at(flat, doc * registers + first, value)
    live = open_rows(doc)
    elements, doc, first = elements[live], doc[live], first[live]
    if registers > 1 and len(elements):
        value, second = draw(elements, 1)
        np.minimum.at(flat, doc * registers + np.where(second == first, 0, second), value)
        live = open_rows(doc)
        elements, doc = elements[live], doc[live]
    # parts of about 50,000 elements end where a document does, so that each document takes its steps at once
    ends = np.flatnonzero(np.diff(doc, append=-1)) + 1
    cuts = np.unique(ends[np.searchsorted(ends, np.arange(50_000, len(elements), 50_000))]) if len(elements) else ends
    for x, d in zip(np.split(elements, cuts), np.split(doc, cuts), strict=True):
        if not len(x):
            continue
        order = np.tile(np.arange(registers, dtype=np.uint8), (len(x), 1))
        for step in range(registers):
            value, other = draw(x, step)
            row = np.arange(len(x))
            here = order[row, other]
            order[row, other] = order[:, step]
            if step > 1:
                np.minimum.at(flat, d * registers + here, value)
                live = open_rows(d)
                if not live.all():
                    x, d, order = x[live], d[live], order[live]
                    if not len(x):
                        break
    return table


def band_hashes(table: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band of so many registers, for each document; bands differ by their number."""
    n, registers = table.shape
    parts = table.reshape(n, registers // rows, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(registers // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * GOLDEN + parts[:, :, k])
    return out.view(np.int64)
