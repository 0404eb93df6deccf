"""N-gram Jaccard join as a blocked sparse product of the document by shingle incidence matrix.

Rows of the matrix are classes of documents with equal shingle sets, columns are shingles. A pair that links has an
overlap of at least 0.8 of the larger set, so it shares a column among the floor(0.2 n) + 1 rarest of each of its rows.

1. Column sums. Incidences are dealt to blocks of columns; a block returns, for each row, the columns that other rows
   have too. Rows of 256 shingles or more take part with one half of all columns (by hash), on which the bound holds as
   well: at most 0.2 n columns of a row are not shared. Smaller rows, and rows that may pair with them, take part with all
   columns. A column that no other row has takes a place among the rarest; a row whose places are all taken has no link.
2. What is left of a row, its rarest shared columns, is the sparse factor. Rows that are joined by such columns form
   candidate groups.
3. Groups are cut into blocks of rows of bounded size. Each block product accumulates overlap counts of the pairs that the
   bounds leave, and stops for a pair of rows that are connected already: only components are asked for. In a group of
   several blocks every block also has the group's pivots. Rows outside the group's largest component after that meet
   all blocks of the group, so every pair of rows in different components is settled exactly.

Columns that a bounded sample shows to be very frequent are ordered last and skip the first shuffle: the order of columns
is free, so this changes no result.

Classes and shingles are 64-bit hashes. Defined results: a null or empty text has no shingles and is its own component;
repeated rows each give a row; null ids are a document of their own class and lose against any id as component id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import components, cut, look_up, plain, text_or_empty
from llm.words import WordHash, cells, hashed, mixed, portions, shingles, split_words

#: A pair links when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Rows from HALF_FROM shingles on use half of the columns; rows below 5/4 of that use all of them.
HALF_FROM = 256
#: Incidences in a block of columns, rows in a block of rows, pivots of a group.
COLUMN_BLOCK, ROW_BLOCK, PIVOTS = 2_000_000, 1024, 8
#: Documents sampled for frequent columns, and how many of them have a frequent column at least.
SAMPLED, FREQUENT = 4096, 16
#: Ids that are broadcast to pick the texts of candidates; more of them are joined by a shuffle.
MOST_NAMED = 1_000_000
LAST = np.uint32(0xFFFFFFFF)


def signature(found: np.ndarray) -> int:
    """Name of a class: 63 bits, the lowest bit is free for the kind of row."""
    return xxhash.xxh64_intdigest(found.tobytes()) & ~1


def _sets(raw: list[bytes], known: WordHash) -> list[np.ndarray]:
    return [shingles(hashed(split_words(x), known)) for x in raw]


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHash()
    for batch in portions(batches, 1):
        found = _sets(cells(batch.column(1)), known)
        n, sig = [len(x) for x in found], _signed([signature(x) for x in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, mask=np.array(n, int) == 0)], ["id", "n", "sig"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, seen = WordHash(), set()
    for batch in portions(batches, 0):
        found = [x for x in _sets(cells(batch.column(0)), known) if not (s := signature(x)) in seen and not seen.add(s)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(found)))], ["shingle"])


def _isin(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def _views(sig: int, found: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """A class as rows of the matrix: the row's name, its columns, and how many shared columns it may have without a link."""
    n = len(found)
    spare = n * (100 - PERCENT) // 100
    if n < HALF_FROM * 100 // PERCENT:
        yield sig, found & ~np.uint64(1), n - spare - 1
    if n >= HALF_FROM:
        half = found[found >> np.uint64(63) == 0] | np.uint64(1)
        yield sig | 1, half, len(half) - spare - 1


def _deal(n_blocks: int, hot):
    """Incidences to blocks of columns, packed by block; a class that a task has seen is not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, often = WordHash(), set(), hot.value
        for batch in portions(batches, 0):
            names, sizes, limits, columns = [], [], [], []
            for found in _sets(cells(batch.column(0)), known):
                sig = signature(found)
                if not len(found) or sig in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(sig)
                for name, have, limit in _views(sig, found):
                    names.append(name)
                    sizes.append(len(have))
                    limits.append(limit)
                    columns.append(have)
            if not names:
                continue
            flat, names, limits = np.concatenate(columns), np.array(names, np.uint64), np.array(limits, np.int32)
            row = np.repeat(np.arange(len(names)), sizes)
            block = np.where(_isin(flat, often), mixed(names)[row], mixed(flat)) % np.uint64(n_blocks)
            order = np.argsort(block, kind="stable")
            flat, row, block = flat[order], row[order], block[order]
            starts = np.searchsorted(block, np.arange(n_blocks + 1, dtype=np.uint64))
            out = []
            for b in range(n_blocks):
                lo, hi = starts[b], starts[b + 1]
                if lo < hi:
                    own, count = np.unique(row[lo:hi], return_counts=True)
                    out.append((b, names[own].tobytes(), count.astype(np.uint32).tobytes(), limits[own].tobytes(), flat[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], ["block", "names", "counts", "limits", "columns"])

    return run


def _column_sums(n_blocks: int, hot):
    """Of a block of columns: the incidences whose column other rows have too, with the column's sum, packed by row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cat = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind)
        counts = cat("counts", np.uint32)
        name, limit, column = np.repeat(cat("names", np.uint64), counts), np.repeat(cat("limits", np.int32), counts), cat("columns", np.uint64)
        order = np.lexsort((name, column))
        name, limit, column = name[order], limit[order], column[order]
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (column[1:] != column[:-1])  # a class may come from several tasks
        name, limit, column = name[fresh], limit[fresh], column[fresh]
        first = np.ones(len(name), bool)
        first[1:] = column[1:] != column[:-1]
        sums = np.diff(np.append(np.flatnonzero(first), len(name)))[np.cumsum(first) - 1].astype(np.uint32)
        sums[_isin(column, hot.value)] = LAST
        shared = sums > 1
        name, limit, column, sums = name[shared], limit[shared], column[shared], sums[shared]
        part = (mixed(name) % np.uint64(n_blocks)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        name, limit, column, sums, part = name[order], limit[order], column[order], sums[order], part[order]
        out = []
        for b in np.unique(part):
            lo, hi = np.searchsorted(part, [b, b + 1])
            out.append((b, *(x[lo:hi].tobytes() for x in (name, limit, column, sums))))
        return pd.DataFrame(out, columns=["block", "names", "limits", "columns", "sums"])

    return run


def _rarest(rows: pd.DataFrame) -> pd.DataFrame:
    """The columns of each row among its floor(0.2 n) + 1 rarest that other rows have too."""
    cat = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind)
    name, limit, column, sums = cat("names", np.uint64), cat("limits", np.int32), cat("columns", np.uint64), cat("sums", np.uint32)
    order = np.lexsort((column, sums, name))
    name, limit, column = name[order], limit[order], column[order]
    first = np.ones(len(name), bool)
    first[1:] = name[1:] != name[:-1]
    starts = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    size = np.diff(np.append(starts, len(name)))[group]
    keep = np.arange(len(name)) - starts[group] < size - limit
    return pd.DataFrame({"shingle": _signed(column[keep]), "sig": _signed(name[keep] & ~np.uint64(1))})


def cluster(sigs: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The least name in each row's component under exact links: the product of a block with itself."""
    order = np.lexsort((sigs, [len(x) for x in sets]))
    sizes = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    column, at, sums = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(order)), sizes)
    by = np.lexsort((at, sums[at], row))
    at, ends = at[by], np.cumsum(sizes)
    label, marked = np.arange(len(order)), np.zeros(len(column), bool)
    postings: dict[int, list[int]] = {}
    for x, n in enumerate(sizes):
        own = at[ends[x] - n : ends[x]]
        rare = [c for c in own[: n * (100 - PERCENT) // 100 + 1].tolist() if sums[c] > 1]
        near = set()
        for c in rare:
            near.update(postings.get(c, ()))
            postings.setdefault(c, []).append(x)
        marked[own] = True
        for y in sorted(near, reverse=True):
            if label[y] == label[x] or 100 * sizes[y] < PERCENT * n:
                continue
            shared = np.count_nonzero(marked[at[ends[y] - sizes[y] : ends[y]]])
            if 100 * shared >= PERCENT * (n + sizes[y] - shared):
                label[label == max(label[x], label[y])] = min(label[x], label[y])
        marked[own] = False
    least = np.full(len(order), np.iinfo(np.int64).max)
    np.minimum.at(least, label, sigs[order])
    out = np.empty(len(order), np.int64)
    out[order] = least[label]
    return out


def _cluster_rows(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("sig")
    sigs = rows["sig"].to_numpy()
    return pd.DataFrame({"a": sigs, "b": cluster(sigs, [np.frombuffer(x, np.uint64) for x in rows["found"]])})


def _named_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHash()
    for batch in portions(batches, 0):
        found = _sets(cells(batch.column(0)), known)
        yield pa.RecordBatch.from_arrays([pa.array(_signed([signature(x) for x in found])), pa.array([x.tobytes() for x in found], pa.binary())], ["sig", "found"])


def links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (id, raw) and their classes (sig, n, id) to (node, root) for all classes that link with others."""
    spark = rows.sparkSession
    total, many = classes.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_blocks = max(spark.sparkContext.defaultParallelism, math.ceil((total or 0) * 0.65 / COLUMN_BLOCK))
    often = np.empty(0, np.uint64)
    if many > SAMPLED:
        chance = F.pmod(F.xxhash64("id", F.lit("frequent")), F.lit(1 << 30)) < int(SAMPLED / many * (1 << 30))
        seen = rows.where(chance).select("raw").mapInArrow(_frequent, "shingle bigint").groupBy("shingle").count()
        found = np.array([r[0] for r in seen.where(F.col("count") >= FREQUENT).select("shingle").collect()], np.int64).view(np.uint64)
        often = np.unique(np.concatenate([found & ~np.uint64(1), found | np.uint64(1)]))
    hot = spark.sparkContext.broadcast(often)

    dealt = rows.select("raw").mapInArrow(_deal(n_blocks, hot), "block int, names binary, counts binary, limits binary, columns binary")
    sums = dealt.groupBy("block").applyInPandas(_column_sums(n_blocks, hot), "block int, names binary, limits binary, columns binary, sums binary")
    factor = cut(sums.groupBy("block").applyInPandas(_rarest, "shingle bigint, sig bigint").distinct())

    least = factor.groupBy("shingle").agg(F.min("sig").alias("b"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    edges = factor.join(least, "shingle").select(F.col("sig").alias("a"), "b").where("a <> b").distinct()
    groups = components(edges)
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    sized = look_up(groups, cut(sizes.withColumn("rows", F.col("size"))), "root", "rows", "size")
    groups = cut(sized.select(F.col("node").alias("sig"), "root", F.ceil(F.col("found") / ROW_BLOCK).alias("blocks")))
    named = cut(classes.join(groups, "sig").select(F.col("id").alias("rep")))
    if named.count() <= MOST_NAMED:
        named = F.broadcast(named)
    chosen = rows.join(named, F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("raw")
    sets = chosen.mapInArrow(_named_sets, "sig bigint, found binary").join(groups, "sig")
    several = groups.where("blocks > 1")
    if not several.isEmpty():
        sets = cut(sets)
    block = F.pmod(F.xxhash64("sig"), F.col("blocks")).alias("block")
    placed = sets.select("root", block, "sig", "found")
    join_rows = lambda frame, *keys: frame.groupBy(*keys).applyInPandas(_cluster_rows, "a bigint, b bigint")
    if several.isEmpty():
        return components(join_rows(placed, "root", "block"))

    pivots = several.groupBy("root", "blocks").agg(F.slice(F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64("sig", F.lit("pivot")), F.col("blocks")) == 0, F.col("sig")))), 1, PIVOTS).alias("pivots"))
    pivots = pivots.select("root", F.explode("pivots").alias("sig"))
    everywhere = sets.join(pivots, ["root", "sig"]).select("root", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), "sig", "found")
    found = cut(join_rows(placed.union(everywhere), "root", "block"))
    now = components(found)
    state = cut(several.join(now, several["sig"] == now["node"], "left").select("sig", several["root"].alias("group"), F.coalesce(now["root"], "sig").alias("part")))
    share = state.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = cut(share.groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.sum("n").alias("rows")))
    rest = cut(look_up(state, largest, "group", "rows", "largest").where("part <> found").select("sig", "group"))
    apart = rest.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).alias("chunks")).join(largest, "group")
    apart = cut(apart.select(F.col("group").alias("root"), "chunks", "rows"))
    if apart.isEmpty():
        return now
    # every row outside the largest component, dealt to chunks, meets every block of its group
    again = look_up(sets.withColumnRenamed("found", "columns"), apart, "root", "rows", "chunks").where("found IS NOT NULL")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    chunk = F.pmod(F.xxhash64("sig", F.lit("rest")), F.col("found")).cast("int").alias("chunk")
    some = again.join(rest.select("sig"), "sig", "left_semi").select("root", every(F.col("blocks")).alias("block"), chunk, "sig", "columns")
    all_ = again.select("root", block.cast("int").alias("block"), every(F.col("found")).alias("chunk"), "sig", "columns")
    met = some.union(all_).withColumnRenamed("columns", "found")
    return components(found.union(join_rows(met, "root", "block", "chunk")))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    rows = docs.select(plain(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("raw"))
    kind = rows.schema["id"].dataType.simpleString()
    members = cut(rows.mapInArrow(_classes, f"id {kind}, n bigint, sig bigint"))
    classes = cut(members.where("n > 0").groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("size")))
    roots = cut(links(rows, classes))
    linked = roots.join(classes, roots["node"] == classes["sig"]).select("root", "sig", "id", "size")
    least = cut(linked.groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")))
    joined = look_up(linked, least, "root", "rows", "least").select("sig", F.col("found").alias("least"), "size")
    copies = classes.where("size > 1").join(joined.select("sig"), "sig", "left_anti").select("sig", F.col("id").alias("least"), "size")
    found = look_up(members, joined.union(copies), "sig", "size", "least")
    own = F.when(F.col("found").isNull(), F.col("id")).otherwise(F.col("found"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the rows with its smallest id, with all their columns. Rows that repeat that id all stay."""
    found = near_components(docs, id_col, text_col)
    dropped = found.where(~plain(id_col).eqNullSafe(F.col("component_id"))).select(plain(id_col).alias("dropped")).distinct()
    return docs.join(dropped, plain(id_col).eqNullSafe(F.col("dropped")), "left_anti")
