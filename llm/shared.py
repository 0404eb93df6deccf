"""Helpers that several operators use: input columns, checkpoints, connected components."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more of the characters that count as white space: space and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"


def plain(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(plain(name).cast("string"), F.lit(""))


def filter_in_arrow(docs: DataFrame, run) -> DataFrame:
    """docs.mapInArrow(run) for a run that drops rows and keeps all columns, of whatever names."""
    places = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return places.mapInArrow(run, places.schema).toDF(*docs.columns)


def use_checkpoints(spark: SparkSession) -> None:
    """Take the folder of spark.checkpoint.dir; without that setting a local session gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoints-"))


def cut(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from there."""
    use_checkpoints(frame.sparkSession)
    return frame.checkpoint()


#: A key with at least one row in so many is joined by broadcast; there are at most that many such keys.
HOT_KEYS = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str, weight: str, value: str) -> DataFrame:
    """rows with `found`, the value that the table has for their key, else null; keys are unique in the table.

    weight is how many rows a key has. The keys that hold a thousandth of all rows or more, of which there can be but a
    thousand, are broadcast. A row that found its value so far keeps no key, and is dealt out by a hash of all it has.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    big = plain(weight) >= max(2, total / HOT_KEYS)
    hot = table.where(big).select(key, F.struct(value).alias("hot"))
    cold = table.where(~big).select(plain(key).cast("string").alias("at"), F.struct(value).alias("cold"))
    first = rows.join(F.broadcast(hot), key, "left")
    spread = F.concat(F.lit("-"), F.xxhash64(*[plain(c) for c in rows.columns]).cast("string"))
    keyed = first.withColumn("at", F.when(F.col("hot").isNull() & plain(key).isNotNull(), plain(key).cast("string")).otherwise(F.concat(F.lit("-"), spread)))
    return keyed.join(cold, "at", "left").select(*[plain(c) for c in rows.columns], F.coalesce("hot", "cold")[value].alias("found"))


#: Edges that a task joins at once.
EDGES = 100_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges to trees: of every node, the least node it is joined with in so many edges as fit a task."""

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def flush() -> pd.DataFrame:
        nodes = list(parent)
        return pd.DataFrame({"node": nodes, "root": [find(x) for x in nodes]}, dtype="int64")

    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            one, two = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            if one != two:
                parent[max(one, two)] = min(one, two)
        if len(parent) > 4 * EDGES:
            yield flush()
            parent.clear()
    yield flush()


def components(edges: DataFrame, per_task: int = EDGES) -> DataFrame:
    """Connected components of edges (a, b) between whole numbers: (node, root) per node that has an edge; root is the
    smallest node.

    Each round joins the edges within tasks, gathers the roots that a node got in several tasks (no more than there are
    tasks), and goes on with the edges between such roots, of which there are ever fewer.
    """
    now, rounds = cut(edges.select("a", "b").where("a <> b")), []
    while (n := now.count()) > 0:
        local = now.coalesce(math.ceil(n / per_task)).mapInPandas(_forest, "node bigint, root bigint")
        found = cut(local.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("all")))
        rounds.append(found.select("node", "root"))
        several = found.where(F.size("all") > 1).select(F.explode("all").alias("a"), F.col("root").alias("b")).where("a <> b")
        now = cut(several.distinct())
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node bigint, root bigint")
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
