"""Sharding by sampled splitters.

Records are ordered by (key, id), the key being a 64-bit hash of the text, so equal texts are neighbours. A
size-weighted sample of these positions gives quantile boundaries of fine ranges; every record is put into its
range by a binary search over the boundaries. Ranges that came out overfull get boundaries of their own from a
sample within them. Exact sums over the ranges, of which there is a bounded number, then place every record on
the line of all bytes, and the line is cut into shards of equal length: a shard's bytes differ from an equal
share by less than its two border records.

Defined results: a null text has size 1 and the CRC of the empty text; a null id sorts first; repeated rows are
placed one after the other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.shared import cut, plain, text_or_empty

#: Fine ranges per shard, and sampled positions per range.
RANGES_PER_SHARD = 128
SAMPLES_PER_RANGE = 4
#: A range is overfull beyond so many times the mean.
OVERFULL = 3


def draw(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """About n positions (key, id), each drawn by itself with a chance in proportion to its size, 1 at most: a hash of the
    position, read as an even number u in (0, 1), is held against it. A few standard deviations bound how many come."""
    total = rows.agg(F.sum("size")).first()[0] or 1
    u = (F.pmod(F.xxhash64("key", "id", F.lit("draw")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = rows.where(u < F.col("size") * F.lit(n / total)).select("key", "id")
    return sorted((r["key"], -(1 << 63) if r["id"] is None else r["id"]) for r in drawn.collect())


def longs(numbers: list[int]) -> Column:
    """A constant array, written as one text literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def position_in(bounds: list[tuple[int, int]], key: Column, id_: Column) -> Column:
    """How many boundaries are at or below (key, id): binary search by a fold over halving steps."""
    if not bounds:
        return F.lit(0)
    keys, ids = longs([b[0] for b in bounds]), longs([b[1] for b in bounds])
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def halve(at: Column, step: Column) -> Column:
        to = at + step
        k, i = F.get(keys, to - 1), F.get(ids, to - 1)
        return F.when((to <= len(bounds)) & ((k < key) | ((k == key) & (i <= id_))), to).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), halve)


def balanced_ranges(rows: DataFrame, n_ranges: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Boundaries, and of every range its number, bytes and rows; overfull ranges are subdivided."""
    order = F.coalesce("id", F.lit(-(1 << 63)))

    def measure(bounds):
        where = position_in(bounds, F.col("key"), order).alias("range")
        return sorted(tuple(r) for r in rows.groupBy(where).agg(F.sum("size"), F.count(F.lit(1))).collect())

    sample = draw(rows, n_ranges * SAMPLES_PER_RANGE)
    bounds = sorted(set(sample[SAMPLES_PER_RANGE::SAMPLES_PER_RANGE]))
    sizes = measure(bounds)
    for _ in range(3):
        mean = sum(s[1] for s in sizes) / n_ranges
        full = [s for s in sizes if s[1] > OVERFULL * mean and s[2] > 1]
        if not full:
            break
        where = position_in(bounds, F.col("key"), order)
        parts = sum(int(s[1] / mean) + 1 for s in full)
        inside = draw(rows.where(where.isin([s[0] for s in full])), parts * SAMPLES_PER_RANGE)
        finer = sorted({*bounds, *inside[SAMPLES_PER_RANGE // 2 :: SAMPLES_PER_RANGE]})
        if finer == bounds:
            break
        bounds, sizes = finer, measure(finer)
    return bounds, sizes


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: id, size, text_crc32, shard, slot; slots of a shard run from 0 without a gap."""
    text = text_or_empty(text_col)
    rows = cut(
        docs.select(
            plain(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        )
    )
    bounds, sizes = balanced_ranges(rows, n_shards * RANGES_PER_SHARD)
    total, start, bytes_at, rows_at = sum(s[1] for s in sizes), 0, {}, {}
    first = 0
    for number, size, count in sizes:
        bytes_at[number], rows_at[number] = start, first
        start, first = start + size, first + count
    every = range(len(bounds) + 1)
    offset = lambda at: F.get(longs([at.get(i, 0) for i in every]), F.col("range"))
    ranged = rows.withColumn("range", position_in(bounds, F.col("key"), F.coalesce("id", F.lit(-(1 << 63)))))
    window = Window.partitionBy("range").orderBy("key", "id")
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = offset(bytes_at) + F.sum("size").over(upto) - F.col("size") / 2
    placed = ranged.select(
        "id", "size", "text_crc32",
        (offset(rows_at) + F.row_number().over(window) - 1).alias("place"),
        F.least(F.floor(middle * n_shards / max(1, total)), F.lit(n_shards - 1)).cast("int").alias("shard"),
    )
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("start")).alias("slot")
    )
