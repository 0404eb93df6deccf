"""Exact dedup by skew-safe combining.

Texts are equal when identical after each run of white space became one space. Copies are combined in three
stages that all group by the whole text besides its digest: within the input partition (map-side partial
aggregation), within a salted digest group, then over the salts of a digest. A text that a third of all rows
share reaches the second stage as one row per input partition and the third as one row per salt.

Defined results: a null text counts as empty; rows without an id lose against any id; of rows that repeat both
the winning id and the text, one stays; an empty table gives no rows; other columns of any name are ignored by
`mark_copies` and carried by `keep_first`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.shared import SPACES, cut, look_up, plain, text_or_empty

#: Salts over which the copies of a text are spread before they are combined globally.
SALTS = 16


def normalised(text: str) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows (id, digest, text) to one row (digest, text, keep_id, group_size) per distinct text."""
    salted = rows.withColumn("salt", F.spark_partition_id() % salts)
    local = salted.groupBy("digest", "salt", "text").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return local.groupBy("digest", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    A digest's rows find their winner by the digest alone where the digest stands for one text, which `combine`
    has established on the whole texts; where it stands for several, whole texts are compared again.
    """
    rows = docs.select(plain(id_col).alias("id"), normalised(text_col).alias("text")).withColumn("digest", F.sha2("text", 256))
    texts = combine(rows, salts)
    winners = texts.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"),
        F.min("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"),
    )
    winners = cut(winners.where("group_size > 1"))
    clashes = winners.where("texts > 1").select("digest")
    won = winners.where("texts = 1").select("digest", "group_size", F.struct("keep_id", "group_size").alias("won"))
    found = look_up(rows.select("id", "digest"), won, "digest", "group_size", "won").select(
        "id", "digest",
        F.when(F.col("found").isNull(), F.col("id")).otherwise(F.col("found.keep_id")).alias("keep_id"),
        F.coalesce("found.group_size", F.lit(1)).alias("group_size"),
    )
    if not clashes.isEmpty():
        apart = rows.join(clashes, "digest", "left_semi").join(texts, ["digest", "text"])
        found = found.join(clashes, "digest", "left_anti").select("id", "digest", "keep_id", "group_size")
        found = found.union(apart.select("id", "digest", "keep_id", "group_size"))
    first = F.row_number().over(Window.partitionBy("id", "digest").orderBy("keep_id"))
    return found.withColumn("first", first).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("first") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns. Each stage carries the row that leads so far, so none is read again."""
    norm = normalised(text_col)
    fields = [F.when(~plain(c).eqNullSafe(norm), plain(c)).alias(f"c{i}") if c == text_col else plain(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    whole = (~plain(text_col).eqNullSafe(norm)).alias("own")
    order = F.struct(plain(id_col).isNull().alias("none"), plain(id_col).alias("id")).alias("place")
    rows = docs.select(F.sha2(norm, 256).alias("digest"), norm.alias("text"), order, F.struct(*fields, whole).alias("row"), (F.spark_partition_id() % salts).alias("salt"))
    lead = lambda frame, *keys: frame.groupBy(*keys).agg(F.min_by("row", "place").alias("row"), F.min("place").alias("place"))
    best = lead(lead(rows, "digest", "salt", "text"), "digest", "text")
    out = [F.when(F.col("row.own"), F.col(f"row.c{i}")).otherwise(F.col("text")).alias(c) if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return best.select(*out)
