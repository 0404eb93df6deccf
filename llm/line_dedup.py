"""Line dedup by pairwise alignment.

Lines are compared by a 64-bit hash of their text without outer white space. From each line that several documents have, a
run goes on over neighbouring shared lines until it has `least_words` words. A run that several documents have belongs to the
first of them, the one with the smallest id; a later document is paired with the first documents of its runs. Any block of
enough words that an earlier document has starts with such a run, and there are at most as many pairs as shared lines however
many documents share one. The pair's shared lines are aligned by patience diff: lines that each has once anchor the alignment
on their longest common run in order, and the stretches between anchors are aligned in the same way. Aligned runs that are
neighbours in both documents are blocks; blocks of at least `least_words` words are deleted from the later document. In what is
left of it, blocks that the first document has in another order, or that one of them has several times, are found by a suffix
automaton of the first document and deleted as well, so no common block of enough words is left.

A line that stands in several places of one document is not deleted for that. The first document keeps the line, so every
deleted line stays once.

Defined results: null and empty texts have no lines and come back as they are; rows that repeat both id and text are one
document, each row comes back; documents of one id are ordered by a hash of their text, null ids come first; long texts are
read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import cut, look_up, plain

#: Least words of a block that is deleted.
LEAST_WORDS = 8


def anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Lines that both have once, on the longest run that is in order in both: patience sorting."""
    ones = lambda x: {v for v, n in Counter(x).items() if n == 1}
    common = ones(a) & ones(b)
    where = {v: j for j, v in enumerate(b) if v in common}
    piles: list[int] = []
    tops: list[tuple] = []
    for i, v in enumerate(a):
        if v in common:
            at = bisect_left(piles, where[v])
            link = (i, where[v], tops[at - 1] if at else None)
            piles[at : at + 1] = [where[v]]
            tops[at : at + 1] = [link]
    last = tops[-1] if tops else None
    out = []
    while last:
        out.append(last[:2])
        last = last[2]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two sequences, in order."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        found = anchors(a[a0:a1], b[b0:b1])
        if found:
            marks = [(a0 + i, b0 + j) for i, j in found]
            out += marks
            work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *marks], [*marks, (a1, b1)])]
    return sorted(out)


def runs(lines: list[dict], least_words: int) -> list[int]:
    """Hashes of the shortest runs of neighbouring lines with enough words, one from each line that has one."""
    out, end, words = [], 0, 0
    for start, x in enumerate(lines):
        if end <= start:
            end, words = start, 0
        while words < least_words and end < len(lines) and (end == start or lines[end]["place"] == lines[end - 1]["place"] + 1):
            words += lines[end]["words"]
            end += 1
        if words >= least_words:
            out.append(xxhash.xxh64_intdigest(array("q", [y["line"] for y in lines[start:end]]).tobytes()) - (1 << 63))
        words -= x["words"]
    return out


class Automaton:
    """Suffix automaton of a sequence: tells of each place of another how long the longest common run is that ends there."""

    def __init__(self, sequence: list):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for x in sequence:
            made, at = self._state({}, 0, self.length[last] + 1), last
            while at >= 0 and x not in self.next[at]:
                self.next[at][x] = made
                at = self.link[at]
            if at >= 0:
                after = self.next[at][x]
                if self.length[after] != self.length[at] + 1:
                    copy = self._state(dict(self.next[after]), self.link[after], self.length[at] + 1)
                    while at >= 0 and self.next[at].get(x) == after:
                        self.next[at][x] = copy
                        at = self.link[at]
                    self.link[after] = after = copy
                self.link[made] = after
            last = made

    def _state(self, following: dict, link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def ends(self, sequence: list) -> Iterator[int]:
        at = n = 0
        for x in sequence:
            while at and x not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if x in self.next[at]:
                at, n = self.next[at][x], n + 1
            yield n


def deleted(first: list[dict], later: list[dict], least_words: int) -> list[int]:
    """Places of the lines of the later document in common blocks of enough words."""
    out, block = [], []

    def close():
        if sum(later[j]["words"] for _, j in block) >= least_words:
            out.extend(later[j]["place"] for _, j in block)

    for i, j in patience([x["line"] for x in first], [x["line"] for x in later]):
        if block and (first[i]["place"] != first[block[-1][0]]["place"] + 1 or later[j]["place"] != later[block[-1][1]]["place"] + 1):
            close()
            block = []
        block.append((i, j))
    close()
    gone = set(out)
    left = [x for x in later if x["place"] not in gone]
    if not set(runs(left, least_words)).isdisjoint(runs(first, least_words)):
        out += left_over(first, left, least_words)
    return sorted(out)


def left_over(first: list[dict], left: list[dict], least_words: int) -> list[int]:
    """Places of what is left of the later document in common blocks of enough words, in whatever order."""
    text: list = []
    for i, x in enumerate(first):  # a mark that no document has keeps apart lines that are no neighbours
        text += [None] * (i > 0 and x["place"] != first[i - 1]["place"] + 1) + [x["line"]]
    other: list[tuple] = []
    for i, x in enumerate(left):
        other += [("", 0, -1)] * (i > 0 and x["place"] != left[i - 1]["place"] + 1) + [(x["line"], x["words"], x["place"])]
    words = [0, *accumulate(w for _, w, _ in other)]
    ends = list(Automaton(text).ends([x for x, _, _ in other]))
    out, reach = [], len(other)
    for end in range(len(other) - 1, -1, -1):
        if words[end + 1] - words[start := end + 1 - ends[end]] >= least_words:
            reach = min(reach, start)
        if reach <= end:
            out.append(other[end][2])
        else:
            reach = len(other)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per input row: id, text without the deleted lines, n_lines, deleted_lines (their places from 0)."""
    text = F.col("text")
    rows = docs.select(plain(id_col).alias("id"), plain(text_col).cast("string").alias("text"))
    rows = rows.withColumn("doc", F.struct("id", F.xxhash64("text").alias("name")))
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(i.alias("place"), F.xxhash64(F.trim(x)).alias("line"), F.size(F.split(F.trim(x), r"\s+")).alias("words"), (F.trim(x) != "").alias("filled")),
    )
    every = rows.select("doc", F.explode(lines).alias("l")).where("l.filled").select("doc", "l.place", "l.line", "l.words").distinct()
    owners = every.groupBy("line").agg(F.min("doc").alias("first"), F.max("doc").alias("other"), F.count(F.lit(1)).alias("n"))
    owners = cut(owners.where("first <> other").select("line", "first", "n"))
    shared = look_up(every, owners, "line", "n", "first").where("found IS NOT NULL")
    place = F.struct("place", "line", "words")
    sequences = cut(shared.groupBy("doc").agg(F.sort_array(F.collect_list(place)).alias("lines")))
    kind = rows.schema["id"].dataType.simpleString()

    def run_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(runs(x, least_words))) for x in batch.column(1).to_pylist()]
            at = [i for i, x in enumerate(found) for _ in x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([y for x in found for y in x], pa.int64())], ["doc", "run"])

    own = cut(sequences.mapInArrow(run_hashes, f"doc struct<id:{kind},name:bigint>, run bigint"))
    first_of = own.groupBy("run").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = look_up(own, cut(first_of), "run", "n", "first").where("doc <> found").select(F.col("found").alias("first"), "doc").distinct()
    named = sequences.join(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n")), F.col("doc") == F.col("first")).select("first", "lines", "n")
    both = look_up(pairs, cut(named), "first", "n", "lines").join(sequences, "doc").select("doc", F.col("found").alias("first"), F.col("lines").alias("later"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [deleted(a, b, least_words) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc", "places"])

    found = both.mapInArrow(align, f"doc struct<id:{kind},name:bigint>, places array<int>").where("size(places) > 0")
    gone = found.select("doc", F.explode("places").alias("place")).groupBy("doc").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    joined = rows.join(gone.select(F.col("doc").alias("at"), "gone"), F.col("doc").eqNullSafe(F.col("at")), "left")
    none = F.array().cast("array<int>")
    places = F.coalesce("gone", none)
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.select(
        F.col("id").alias(id_col), F.when(F.col("gone").isNull(), text).otherwise(kept).alias("text"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"), places.alias("deleted_lines"),
    )
