"""Benchmark decontamination by greedy string tiling.

Items of the benchmark and documents are read as words: runs of letters and digits in lower case, so that case and
punctuation don't hide a copy. Windows of `seed` words of all items, hashed, are the seeds; a running Karp-Rabin hash over
each document joins its windows with them. A pair that shares a seed is tiled: of all common runs of words the longest that
lies on unmarked words of both is marked, again and again, until none of `seed` words is left. The share of an item's words
that tiles cover, in whatever order the document has them, decides.

The benchmark is taken in blocks of bounded size; each block is broadcast and meets all documents. A benchmark of any size
works, with one pass over the documents per block.

Defined results: a null or empty document has no match; an item of fewer words than a seed is never reported, as any text
might hold it; null items are passed over; repeated documents and items each give their rows; long texts are read whole;
empty tables give no rows; other columns are ignored by `matches` and kept by `clean`.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import filter_in_arrow, plain, text_or_empty

#: Words of a seed and least tile, share of an item that must be covered, bytes of items in a block.
SEED, COVERAGE, BLOCK_BYTES = 5, 0.5, 4 << 20
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def karp_rabin(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window, modulo 2 ** 64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * BASE + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    return total


class Items:
    """A block of the benchmark: its words, and where each seed is."""

    def __init__(self, items: list[tuple], seed: int):
        self.seed, self.ids, self.words = seed, {}, {}
        at = defaultdict(list)
        for number, (name, text) in enumerate(items):
            found = words(text or "")
            if len(found) < seed:
                continue
            self.ids[number] = (name, np.array([self.words.setdefault(w, len(self.words)) for w in found], np.int64))
            for place, value in enumerate(karp_rabin(self.ids[number][1], seed).tolist()):
                at[value].append((number, place))
        self.at = dict(at)
        self.seeds = np.array(sorted(at), np.uint64)

    def matches(self, text: str, coverage: float) -> list[tuple]:
        """(item, words of the item, words covered, tiles as (place in the text, place in the item, words))."""
        if not len(self.seeds):
            return []
        found = words(text)
        ids = np.fromiter(map(self.words.get, found, repeat(-1)), np.int64, len(found))
        windows = karp_rabin(ids, self.seed)
        if not len(windows):
            return []
        near = np.searchsorted(self.seeds, windows)
        near[near == len(self.seeds)] = 0
        shared = defaultdict(list)
        for place in np.flatnonzero(self.seeds[near] == windows).tolist():
            for number, other in self.at[int(windows[place])]:
                shared[number].append((place, other))
        out = []
        for number, pairs in sorted(shared.items()):
            name, item = self.ids[number]
            tiles = tile(ids, item, pairs, self.seed)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(item):
                out.append((name, len(item), covered, tiles))
        return out


def tile(text: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, length): longest first, then the earliest in the text and the item."""
    seeds = [(i, j) for i, j in seeds if np.array_equal(text[i : i + least], item[j : j + least])]
    runs, by_diagonal = [], defaultdict(list)
    for i, j in seeds:
        by_diagonal[i - j].append(i)
    for diagonal, places in by_diagonal.items():
        places.sort()
        start = last = places[0]
        for i in [*places[1:], None]:
            if i != last + 1 if i is not None else True:
                runs.append((start, start - diagonal, last - start + least))
                start = i
            last = i
    text_marked, item_marked = np.zeros(len(text), bool), np.zeros(len(item), bool)
    tiles = []
    while runs:
        runs.sort(key=lambda r: (-r[2], r[0], r[1]))
        i, j, n = runs[0]
        free = ~(text_marked[i : i + n] | item_marked[j : j + n])
        if free.all():
            tiles.append((i, j, n))
            text_marked[i : i + n] = item_marked[j : j + n] = True
            del runs[0]
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free, [0]])))
        runs[:1] = [(i + a, j + a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]
    return sorted(tiles)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, seed: int) -> Iterator:
    """The benchmark as broadcasts of bounded size."""
    items = benchmark.select(plain(item_col).alias("item"), text_or_empty(text_col).alias("text"))
    spark = benchmark.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        own = items.where(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == b).orderBy("item", "text")
        yield spark.sparkContext.broadcast(Items([tuple(r) for r in own.collect()], seed))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and item it contains: id, item, item_words, covered_words, coverage, tiles."""
    rows = docs.select(plain(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), benchmark.select(plain(item_col)).schema[0].dataType.simpleString()
    tiles = "array<struct<text_at:int,item_at:int,words:int>>"
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, item_words int, covered_words int, coverage double, tiles {tiles}"

    def run(block):
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, m) for i, text in enumerate(batch.column(1)) for m in block.value.matches(text.as_py(), coverage)]
                if found:
                    at, hits = zip(*found)
                    item, size, covered, marked = zip(*hits)
                    marked = [[dict(zip(("text_at", "item_at", "words"), t)) for t in x] for x in marked]
                    places = pa.list_(pa.struct([(x, pa.int32()) for x in ("text_at", "item_at", "words")]))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), pa.array(item), pa.array(size, pa.int32()), pa.array(covered, pa.int32()), pa.array([c / s for c, s in zip(covered, size)]), pa.array(marked, places)],
                        [id_col, item_col, "item_words", "covered_words", "coverage", "tiles"],
                    )

        return rows.mapInArrow(one, schema)

    parts = [run(block) for block in blocks(benchmark, item_col, item_text_col, seed)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The documents that contain no item, with all their columns; rows are dropped where they are read."""
    at = docs.columns.index(text_col)

    def run(block):
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not block.value.matches(text.as_py() or "", coverage) for text in batch.column(at)], pa.bool_()))

        return one

    for block in blocks(benchmark, item_col, item_text_col, seed):
        docs = filter_in_arrow(docs, run(block))
    return docs
