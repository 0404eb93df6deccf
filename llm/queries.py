"""The operators as named queries over the given tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import (
    bit_planes,
    bpe,
    contour_whitening,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    ngram_lm,
    pii,
    sharding,
    token_count,
    wrappers,
)

SHARDS = 16
#: Key of the pseudonyms. A run over real data takes its own from the caller.
PSEUDONYM_KEY = "campaign"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Tokens that a document may have before it counts as over the limit.
TOKEN_LIMIT = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def learns_language() -> Column:
    """Documents that language identification learns from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def op1_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability under the model of the training documents, and under add-half unigrams."""
    training = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    return ngram_lm.score(table(spark, folder, "documents"), training)


def op2_pii_feistel(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in which personal numbers and dates carry pseudonyms; one row per document."""
    return pii.pseudonymise(table(spark, folder, "documents"), PSEUDONYM_KEY)


def op3_host_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page, by the wrapper of its host."""
    return wrappers.main_text(table(spark, folder, "pages"))


def op4_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard and slot; sizes of shards are near equal."""
    placed = sharding.shard_by_bytes(table(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the component it is linked into by shared word 5-grams."""
    return jaccard_join.near_components(table(spark, folder, "documents"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of what they decode to."""
    return bpe.encode(table(spark, folder, "documents"), VOCABULARY, with_ids=False)


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the document that stays for its text."""
    return exact_dedup.mark_copies(table(spark, folder, "documents"))


def op8_string_kernels(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language, learnt from the training documents."""
    return language_id.predict(table(spark, folder, "documents"), learns_language())


def op9_patience_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the blocks of lines that an earlier document has as well."""
    return line_dedup.dedup_lines(table(spark, folder, "documents"))


def op10_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that contain a benchmark item, with the item, the words covered and the tiles."""
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_feast_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the four leading components of the covariance of the distinct vectors, whitened."""
    return contour_whitening.whiten(table(spark, folder, "embeddings"), components=4, scale=256)


def op12_whole_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's bytes and tokens, and whether it has too many."""
    return token_count.count_tokens(table(spark, folder, "documents"), BYTE_VOCABULARY, TOKEN_LIMIT)


def op13_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's cluster after three rounds from 16 drawn vectors, with exact distances."""
    return bit_planes.cluster(table(spark, folder, "embeddings"), clusters=16, rounds=3, scale=64, seed=1)


QUERIES = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_pii_feistel": op2_pii_feistel,
    "op3_host_wrappers": op3_host_wrappers,
    "op4_sampled_splitters": op4_sampled_splitters,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_bpe": op6_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_string_kernels": op8_string_kernels,
    "op9_patience_lines": op9_patience_lines,
    "op10_string_tiling": op10_string_tiling,
    "op11_feast_whitening": op11_feast_whitening,
    "op12_whole_tokens": op12_whole_tokens,
    "op13_bit_planes": op13_bit_planes,
}



def _bit_planes_sql() -> str:
    """Three rounds and a last assignment as common table expressions over (row, component, number)."""
    steps = []
    for at in range(4):
        steps.append(f"""
        far{at} AS (
            SELECT v.row, m.c, sum((v.x - m.x) * (v.x - m.x)) AS far FROM v JOIN mid{at} m ON m.d = v.d GROUP BY v.row, m.c
        ), near{at} AS MATERIALIZED (
            SELECT row, c, far FROM far{at} QUALIFY row_number() OVER (PARTITION BY row ORDER BY far, c) = 1
        )""")
        if at < 3:
            steps.append(f"""
        mid{at + 1} AS MATERIALIZED (
            SELECT m.c, m.d, coalesce(moved.x, m.x) AS x FROM mid{at} m LEFT JOIN (
                SELECT n.c, v.d, ((sum(v.x) - (sum(v.x) % count(*) + count(*)) % count(*)) // count(*)) AS x
                FROM near{at} n JOIN v ON v.row = n.row GROUP BY n.c, v.d
            ) moved ON moved.c = m.c AND moved.d = m.d
        )""")
    return """
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS xs
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), v AS MATERIALIZED (
            SELECT row, unnest(range(64)) AS d, unnest(xs) AS x FROM kept
        ), drawn AS (
            SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, xs) - 1 AS c FROM kept QUALIFY c < 16
        ), mid0 AS MATERIALIZED (
            SELECT c, d, x FROM drawn JOIN v USING (row)
        ), """ + ",".join(steps) + """,
        digest AS (
            SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM mid3 GROUP BY c
        )
        SELECT kept.vec_id, CAST(near3.c AS INTEGER) AS cluster, CAST(near3.far AS BIGINT) AS distance,
            CAST(sum(near3.far) OVER (PARTITION BY near3.c) AS BIGINT) AS cluster_inertia, CAST(sum(near3.far) OVER () AS BIGINT) AS inertia,
            digest.centroid_sha256
        FROM kept JOIN near3 ON near3.row = kept.row JOIN digest ON digest.c = near3.c
    """


ORACLE_SQL = {
    "op13_bit_planes": _bit_planes_sql(),
    "op5_jaccard_join": r"""
        WITH RECURSIVE tokens AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), runs AS (
            SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM tokens
        ), shingle AS (
            SELECT DISTINCT doc_id, s FROM runs
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
            FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * shared >= 80 * (x.n + y.n - shared)
        ), reach AS (
            SELECT doc_id AS node, doc_id AS other FROM documents
            UNION
            SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
        ), least AS (
            SELECT node, min(other) AS component_id FROM reach GROUP BY node
        )
        SELECT documents.doc_id, coalesce(sizes.n, 0) AS n_shingles, least.component_id
        FROM documents LEFT JOIN sizes USING (doc_id) JOIN least ON least.node = documents.doc_id
    """,
    "op7_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), groups AS (
            SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY norm
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM texts JOIN groups USING (norm)
    """,
}
