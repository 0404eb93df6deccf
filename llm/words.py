"""Words of texts as 64-bit hashes, in bulk: what the operators on n-grams share inside their tasks."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
import xxhash

#: Word hashes that a task remembers at once.
REMEMBERED = 200_000
#: Bytes of text that a task works on at once, if no single text has more.
PORTION = 4 << 20
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHash(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def split_words(raw: bytes) -> list[bytes]:
    """Lower-case A-Z; words are what space and 0x09 to 0x0D keep apart."""
    return raw.lower().split()


def hashed(words: list[bytes], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; of fewer words the whole is one run; of none there are none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(n, width)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += mixed(hashes[i : n - k + 1 + i] * MULTIPLIERS[i])
    return np.unique(mixed(total))


def cells(column) -> list[bytes]:
    """The values of an Arrow column of binaries as Python bytes."""
    return column.to_pylist()


def portions(batches, column: int, most: int = PORTION):
    """Slices of Arrow batches with at most so many bytes in a column, or with one row."""
    for batch in batches:
        sizes, start, held = pc.binary_length(batch.column(column)).fill_null(0).to_pylist(), 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
