"""Centroid clustering on bit planes: exact dot products and distances from weighted AND-popcounts of 64-bit words.

A vector has 64 components, each the integer floor(scale * x). Plane p of a vector is one uint64 whose bit d is bit p of
component d in two's complement; its weight is 2^p, and minus that for the last plane, the signs. As many planes as the
widest component of a batch asks for are kept: 8 for the usual unit vectors, a quarter of their floats. The dot product of a
vector with a centroid is the sum over pairs of planes of the product of weights times popcount(plane AND plane), an exact
whole number; squared distances follow from it and the two norms, which are dot products as well.

The vectors are packed once and written to the shared checkpoint folder. A round reads the packed planes, assigns each vector
in its task, and adds up counts and component sums by centroid before anything is shuffled: tasks hand on at most
clusters * 64 sums, whatever the number of rows or the size of a cluster. Centroids (clusters * 64 numbers) go through the
driver. Sums are of whole numbers, so results depend neither on the order nor on the number of tasks.

Defined results: vectors that are null, have another number of components than 64, or hold null or non-finite entries give
no row; every other row gives one, repeated ones and those with a null id too. Where ids repeat, the start takes their rows
in the order of the packed vectors; a null id has no hash and comes last. With fewer vectors than clusters there are as many
clusters as vectors; without vectors there are no rows. Equal distances go to the smaller number. Components beyond
2^27 in size are refused with an error, as their distances need not fit a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import cut, plain
from llm.vectors import doubles, finite

WIDTH = 64
#: Components up to this size have distances that fit a long.
LARGEST = 1 << 27
#: Vectors that are worked on at once.
AT_ONCE = 4096


def weights(planes: int) -> np.ndarray:
    """2^p for each plane, minus that for the signs."""
    out = np.int64(1) << np.arange(planes, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def planes_needed(whole: np.ndarray) -> np.ndarray:
    """Of each row of whole numbers, the bits of its widest component, with the sign."""
    widest = np.maximum(whole.max(axis=1), -whole.min(axis=1) - 1)
    return np.frexp(np.maximum(widest, 0).astype(np.float64))[1].astype(np.int64) + 1


def pack(whole: np.ndarray) -> np.ndarray:
    """Rows of 64 whole numbers to rows of bit planes, as few as all rows need."""
    planes = int(planes_needed(whole).max(initial=1))
    bits = (whole[:, None, :] >> np.arange(planes, dtype=np.int64)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpack(planes: np.ndarray) -> np.ndarray:
    """Bit planes back to 64 whole numbers."""
    raw = np.ascontiguousarray(planes.astype("<u8")).view(np.uint8).reshape(len(planes), planes.shape[1], 8)
    return np.einsum("npd,p->nd", np.unpackbits(raw, axis=2, bitorder="little").astype(np.int64), weights(planes.shape[1]))


def dots(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Dot products of every vector with every other, as matrix, from their bit planes."""
    out = np.zeros((len(rows), len(others)), np.int64)
    for p, one in enumerate(weights(rows.shape[1])):
        for q, two in enumerate(weights(others.shape[1])):
            out += np.bitwise_count(rows[:, p, None] & others[None, :, q]).astype(np.int64) * (one * two)
    return out


def norms(rows: np.ndarray) -> np.ndarray:
    """Dot product of each vector with itself."""
    out, weight = np.zeros(len(rows), np.int64), weights(rows.shape[1])
    for p, one in enumerate(weight):
        for q, two in enumerate(weight[: p + 1]):
            out += np.bitwise_count(rows[:, p] & rows[:, q]).astype(np.int64) * (one * two * (1 if p == q else 2))
    return out


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid; of equal ones the smaller number. Both as bit planes."""
    squared = norms(rows)[:, None] + norms(centroids)[None, :] - 2 * dots(rows, centroids)
    best = squared.argmin(axis=1)
    return best, squared[np.arange(len(rows)), best]


def _packed(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, planes) of the vectors that take part; planes are little-endian 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in finite(batch.column(1)):
                if matrix.shape[1] != WIDTH:
                    continue
                whole = np.floor(scale * matrix)
                if np.abs(whole).max() > LARGEST:
                    raise ValueError(f"components beyond {LARGEST} have distances that need not fit a long")
                whole = whole.astype(np.int64)
                needed = planes_needed(whole)
                for planes in np.unique(needed):
                    some = needed == planes
                    cells = pa.array([x.tobytes() for x in pack(whole[some]).astype("<u8")], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[some])), cells], ["id", "planes"])

    rows = vectors.select(plain(id_col).alias("id"), doubles(vectors, vector_col).alias("vector"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, planes binary")


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed vectors of an Arrow column as matrices of so many rows and one number of planes: (places of the rows, planes)."""
    cells = column.to_pylist()
    sizes = np.fromiter(map(len, cells), np.int64, len(cells))
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        for at in range(0, len(places), AT_ONCE):
            some = places[at : at + AT_ONCE]
            yield some, np.frombuffer(b"".join([cells[i] for i in some]), "<u8").reshape(len(some), -1)


def _totals(packed: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of every centroid with vectors: their number, their distances added up, and their components added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(centroids)
        sums, counts, far = np.zeros((many, WIDTH), np.int64), np.zeros(many, np.int64), np.zeros(many, np.int64)
        planes = pack(centroids)
        for batch in batches:
            for _, rows in _matrices(batch.column(0)):
                near, distance = nearest(rows, planes)
                np.add.at(counts, near, 1)
                np.add.at(far, near, distance)
                whole = unpack(rows)
                for cluster in np.unique(near):
                    sums[cluster] += whole[near == cluster].sum(axis=0)
        used = np.flatnonzero(counts)
        # place 0 has the number of vectors, place 1 the distances, the others the components
        table = np.concatenate([counts[used, None], far[used, None], sums[used]], axis=1)
        columns = [np.repeat(used, WIDTH + 2), np.tile(np.arange(WIDTH + 2), len(used)), table.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["cluster", "place", "total"])

    parts = packed.select("planes").mapInArrow(run, "cluster bigint, place bigint, total bigint")
    # a sum of longs may outgrow a long; the driver gets clusters * 66 rows
    found = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by_cluster: dict[int, list[int]] = {}
    for row in found:
        by_cluster.setdefault(row.cluster, [0] * (WIDTH + 2))[row.place] = int(row.total)
    return {cluster: (x[0], x[1], x[2:]) for cluster, x in by_cluster.items()}


def cluster(
    vectors: DataFrame, clusters: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector that takes part: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The start are the vectors with the smallest sha256 of `seed:id`. Each round gives every vector to its nearest centroid
    and moves centroids to the floor of the mean of their vectors; empty ones stay.
    """
    packed = cut(_packed(vectors, id_col, vector_col, scale))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    start = packed.select(drawn.alias("drawn"), "planes").orderBy(F.col("drawn").asc_nulls_last(), "planes").limit(clusters).collect()
    kind = packed.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not start:
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = np.concatenate([unpack(np.frombuffer(bytes(r.planes), "<u8")[None, :]) for r in start])
    for _ in range(rounds):
        for number, (count, _, sums) in _totals(packed, centroids).items():
            centroids[number] = [total // count for total in sums]
    inertia = {number: far for number, (_, far, _) in _totals(packed, centroids).items()}
    every = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = pack(centroids)
        for batch in batches:
            for rows, matrix in _matrices(batch.column(1)):
                near, distance = nearest(matrix, planes)
                names = near.tolist()
                columns = [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(near, pa.int32()),
                    pa.array(distance, pa.int64()),
                    pa.array([inertia[n] for n in names], pa.int64()),
                    pa.array([every] * len(names), pa.int64()),
                    pa.array([digests[n] for n in names], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return packed.mapInArrow(run, schema)
