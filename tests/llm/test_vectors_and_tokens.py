"""Whitening, token counts and bit-plane clustering against brute force, the tokenizers library and SQL; odd rows."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from llm import bit_planes, contour_whitening, queries, token_count

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int"


def clashing(df):
    names = ("id", "vector", "planes", "cell", "i", "j", "total", "n", "cluster", "drawn", "component", "raw", "n_tokens", "a.b", "dimensions")
    return df.select("*", *[F.lit("x").alias(c) for c in names])


def rows_of(df):
    return sorted(map(str, df.collect()))


def unit(rand, size=64):
    v = [rand.gauss(0, 1) for _ in range(size)]
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v]


# token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_whole_strings_are_those_the_library_encodes_as_one_token(library):
    _, proof = token_count.prove(VOCABULARY)
    whole = set(proof.whole)
    assert len(whole) > 49_000
    single = {t for t in sorted(whole)[:: 17] if len(library.encode(t, add_special_tokens=False).ids) == 1}
    assert single == set(sorted(whole)[:: 17])
    texts = [library.decode([i], skip_special_tokens=False) for i in range(0, 50256, 13)]
    not_whole = [t for t in texts if "�" not in t and t not in whole]
    assert all(len(library.encode(t, add_special_tokens=False).ids) > 1 for t in not_whole)


def test_long_and_short_merging_agree():
    _, proof = token_count.prove(VOCABULARY)
    rand = random.Random(5)
    for _ in range(300):
        piece = "".join(rand.choice("aehlostnr ") for _ in range(rand.randrange(2, 60))).encode()
        symbols = [proof.of_byte[b] for b in piece]
        assert proof.merges._few(list(symbols)) == proof.merges._many(list(symbols))


def test_counts_equal_the_library(spark, library):
    rand = random.Random(3)
    _, proof = token_count.prove(VOCABULARY)
    pool = [chr(c) for c in range(0x300)] + list("\u0085 　​ ٠⅕́﻿一") + ["'s", "'LL", "<|endoftext|>", "  ", "\n\n", " the", "\U0001f600"]
    pool += rand.sample(proof.odd, 100)
    texts = ["".join(rand.choice(pool) for _ in range(rand.randrange(40))) for _ in range(3000)]
    texts += ["a" * 20000, "word " * 300_000, " " * 5000, "é" * 9000, "<|endoftext|>" * 3, "<|endoftext|", "lo" * 25 + "l" * 49, "", None]
    texts += [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_count.count_tokens(docs, VOCABULARY, 512).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 512), text
        assert got[i].n_whole <= n


def test_token_count_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, None, 2), (2, "", 3)], "doc_id long, text string, n_tokens int")
    got = token_count.count_tokens(docs, VOCABULARY, 1)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == [(0, 3, 2, True), (1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False)]
    assert token_count.count_tokens(docs.limit(0), VOCABULARY, 1).collect() == []
    assert rows_of(token_count.count_tokens(clashing(docs.drop("n_tokens")), VOCABULARY, 1)) == rows_of(got)
    broken = spark.range(1).select(F.col("id").alias("doc_id"), F.unhex(F.lit("61FF20")).alias("raw"))
    assert token_count.count_tokens(broken.select("doc_id", F.expr("cast(raw as string)").alias("text")), VOCABULARY, 9).collect()[0].n_bytes == 3


def test_memory_of_merged_pieces_is_bounded(monkeypatch, library):
    monkeypatch.setattr(token_count, "REMEMBERED", 10)
    counter = token_count.Counter(token_count.prove(VOCABULARY)[1])
    for i in range(200):
        text = f"qx{i}zv wq{i}"
        assert counter.count(text)[0] == len(library.encode(text, add_special_tokens=False).ids)
        assert len(counter) <= len(counter.whole) + 10


# bit planes


def test_planes_hold_numbers_and_dot_products():
    rand = np.random.default_rng(2)
    for most in (1, 7, 100, 2**20, 2**26):
        a, b = rand.integers(-most, most, (50, 64)), rand.integers(-3, 4, (7, 64))
        one, two = bit_planes.pack(a), bit_planes.pack(b)
        assert (bit_planes.unpack(one) == a).all()
        assert (bit_planes.dots(one, two) == a @ b.T).all()
        assert (bit_planes.norms(one) == (a * a).sum(axis=1)).all()
        near, far = bit_planes.nearest(one, two)
        squared = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        assert (near == squared.argmin(axis=1)).all() and (far == squared.min(axis=1)).all()
    assert bit_planes.pack(np.zeros((2, 64), np.int64)).shape == (2, 1)
    assert bit_planes.planes_needed(np.array([[0] * 64, [-1] * 64, [1] * 64, [-128] * 64, [128] * 64])).tolist() == [1, 1, 2, 8, 9]


def clustered(rows, clusters=16, rounds=3):
    """The contract, number by number."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    centroids = [x for _, x in order[:clusters]]
    best = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(best(x)[1], []).append(x)
        for k, xs in members.items():
            centroids[k] = [sum(col) // len(xs) for col in zip(*xs)]
    out = [(i, *best(x)) for i, x in kept]
    inertia = {k: sum(d for _, d, c in out if c == k) for k in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), k, d, inertia[k], sum(inertia.values()), sha[k]) for i, d, k in out)


@pytest.mark.parametrize("many, copies", [(300, 0), (5, 0), (40, 200), (1, 0)])
def test_clusters_equal_brute_force(spark, many, copies):
    rand = random.Random(many)
    rows = [(i, np.float32(unit(rand)).tolist()) for i in range(many)]
    rows += [(many + i, rows[0][1]) for i in range(copies)]
    odd = [(9001, None), (9002, [1.0] * 63), (9003, [None] + [0.5] * 63), (9004, [float("nan")] + [0.5] * 63), (9005, [float("-inf")] * 64), (9006, []), (None, [0.25] * 64)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], VECTORS).repartition(5)
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in bit_planes.cluster(df).collect())
    assert got == clustered(rows + odd)


def test_bit_planes_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_bit_planes"])
    names = [d[0] for d in want.description]
    got = queries.op13_bit_planes(spark, FOLDER).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_bit_planes_odd_rows(spark):
    rand = random.Random(8)
    df = spark.createDataFrame([(i % 9, unit(rand), 0) for i in range(30)] + [(None, unit(rand), None)] * 2, VECTORS)
    want = rows_of(bit_planes.cluster(df))
    assert len(want) == 32
    assert rows_of(bit_planes.cluster(clashing(df.repartition(3)))) == want
    assert bit_planes.cluster(df.limit(0)).collect() == []
    assert bit_planes.cluster(df.where("label = 7")).collect() == []
    with pytest.raises(Exception, match="need not fit"):
        bit_planes.cluster(spark.createDataFrame([(1, [1e30] * 64, 0)], VECTORS)).collect()


# whitening


@pytest.mark.parametrize("kind", ["plain", "repeated", "rank", "equal", "small", "wide"])
def test_inertia_and_contours_find_all_pairs(kind):
    rand = np.random.default_rng(4)
    d = {"small": 2, "wide": 150}.get(kind, 40)
    q, _ = np.linalg.qr(rand.standard_normal((d, d)))
    e = rand.uniform(1, 1000, d)
    if kind == "repeated":
        e[:12] = 1500.0
    if kind == "rank":
        e[3:] = 0
    if kind == "equal":
        e[:] = 3.0
    m = (q * e) @ q.T
    m = (m + m.T) / 2
    for shift in (0.5, 2.0, 400.0, 1000.5, 1600.0):
        assert contour_whitening.inertia(m, shift) == (e < shift).sum()
    found = [contour_whitening.contour_pairs(m, *i) for i in contour_whitening.leading_intervals(m, min(4, d))]
    values = np.sort(np.concatenate([v for v, _ in found]))[::-1]
    assert np.allclose(values, np.sort(e)[::-1][: len(values)], rtol=1e-11, atol=1e-9) and len(values) >= min(4, d)
    vectors = np.concatenate([x for _, x in found], axis=1)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)


def test_products_are_exact():
    rand = np.random.default_rng(6)
    for most in (100, 2**27, 2**31):
        x = rand.integers(-most, most, (30, 5))
        exact = x.astype(object)
        assert (contour_whitening.products(x).astype(object) == exact.T @ exact).all()


def whitened(rows, many=4):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.float64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:many], axes[:, ::-1][:, :many]
    out = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out[i] = [(n, deviation, w, e / np.trace(centred.T @ centred / n)) for w, e in zip((np.array(x) - fit.mean(axis=0)) @ axes / np.sqrt(values), values)]
    return out


def test_whitening_equals_brute_force(spark):
    rand = random.Random(12)
    rows = [(i, np.float32([x * (3 if k < 4 else 1) * (1 + k / 9) for k, x in enumerate(unit(rand, 12))]).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one vector of many rows is fitted once
    odd = [(9001, None), (9003, [None] + [0.5] * 11), (9004, [float("nan")] * 12), (9005, [float("inf")] * 12)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], VECTORS).repartition(6)
    got = contour_whitening.whiten(df).collect()
    want = whitened(rows + odd)
    assert len(got) == 4 * len(rows)
    signs = {}
    for r in got:
        n, deviation, white, share = want[r.vec_id][r.component - 1]
        assert (r.n, r.deviation) == (n, deviation) and n == 400
        assert abs(abs(r.whitened) - abs(white)) < 1e-9 and abs(r.explained - share) < 1e-12 and 0 <= r.identity_error < 1e-10
        if abs(white) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * white))
    assert all(len(s) == 1 for s in signs.values()) and len({r.identity_error for r in got}) == 1


def test_whitening_query_on_the_given_table(spark):
    source = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    want = whitened([(r.vec_id, r.embedding) for r in source])
    got = queries.op11_feast_whitening(spark, FOLDER).collect()
    assert len(got) == 4 * len(source)
    for r in got:
        n, deviation, white, share = want[r.vec_id][r.component - 1]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(white)) < 1e-8 and abs(r.explained - share) < 1e-10


def test_whitening_odd_rows(spark):
    rand = random.Random(2)
    df = spark.createDataFrame([(i % 7, unit(rand, 6), 0) for i in range(25)] + [(None, unit(rand, 6), None)] * 2 + [(50, unit(rand, 3), 1), (51, [], 1)], VECTORS)
    got = contour_whitening.whiten(df).collect()
    assert len(got) == 4 * 27 and {r.n for r in got} == {26}
    again = contour_whitening.whiten(clashing(df.repartition(3))).collect()
    assert sorted((str(r.vec_id), r.component, r.deviation) for r in again) == sorted((str(r.vec_id), r.component, r.deviation) for r in got)
    assert contour_whitening.whiten(df.limit(0)).collect() == []
    assert contour_whitening.whiten(df.where("label = 1 and vec_id = 50")).collect() == []  # one vector has no spread
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)], VECTORS)
    assert {r.component for r in contour_whitening.whiten(flat).collect()} == {1}  # one direction only
    doubles = spark.createDataFrame([(i, unit(rand, 5)) for i in range(9)], "vec_id long, embedding array<double>")
    assert len(contour_whitening.whiten(doubles).collect()) == 36
    assert contour_whitening.deviations(np.array([[2**31, 0]]), 2**10, [0, 0]) == [None]
    assert contour_whitening.deviations(np.array([[2**20, 1]]), 3, [1, 2]) == [(3 * 2**20 - 1) ** 2 + 1]
