"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and
clashing columns."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, ngram_lm, pii, sharding, shared, words, wrappers

SCHEMA = T.StructType(
    [T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
)
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, x, lang, "s", len(x or "")) for i, x in zip(ids, texts)], SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    rand = random.Random(seed)
    return " ".join(f"w{rand.randrange(vocabulary)}" for _ in range(n))


#: Nulls, empties, white space, a very long text, equal texts that differ in white space, repeated rows.
ODD = [None, "", "  \t\n ", "one", "One  two\nthree", "One two three", prose(1, 30000), "ÄÖ ß \U0001f600 \x1c é", "a" * 5000, "one"]


def clashing(df):
    """The same rows with columns whose names the operators use inside."""
    names = ("id", "key", "digest", "size", "row", "at", "found", "block", "sig", "n", "shard", "hot", "cold", "text_sha256", "score", "a.b", "raw", "uid")
    return df.select("*", *[F.lit("x").alias(c) for c in names])


OPERATORS = {
    "exact": lambda d: exact_dedup.mark_copies(d),
    "exact rows": lambda d: exact_dedup.keep_first(d),
    "shards": lambda d: sharding.shard_by_bytes(d, 4),
    "pii": lambda d: pii.pseudonymise(d, "k"),
    "lm": lambda d: ngram_lm.score(d, F.col("doc_id") % 2 == 0),
    "jaccard": lambda d: jaccard_join.near_components(d),
    "jaccard rows": lambda d: jaccard_join.keep_one(d),
    "bpe": lambda d: bpe.encode(d, VOCABULARY),
    "language": lambda d: language_id.predict(d, F.col("doc_id") % 2 == 0),
    "language rows": lambda d: language_id.keep_known(d, F.col("doc_id") % 2 == 0),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "benchmark": lambda d: decontaminate.matches(d, d.limit(0).select(F.col("doc_id").alias("item_id"), "text")),
    "benchmark rows": lambda d: decontaminate.clean(d, d.limit(0).select(F.col("doc_id").alias("item_id"), "text")),
}
PER_ROW = ("exact", "shards", "pii", "lm", "jaccard", "bpe", "language", "lines")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_empty_tables_and_clashing_columns(spark, name):
    run = OPERATORS[name]
    ids = [None, 0, 0, 1, 2, 3, 4, 5, None, 1]
    odd = frame(spark, ODD, ids)
    got = run(odd).collect()
    if name in PER_ROW:
        assert sorted(str(r[0]) for r in got) == sorted(map(str, ids))
    assert run(odd.limit(0)).collect() == []
    assert len(run(clashing(odd)).collect()) == len(got)
    assert len(run(odd.union(odd)).collect()) == (2 * len(got) if name not in ("exact rows",) else len(got))


def test_pages_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, path string"
    rows = [(1, None, "<article>a</article>", "t", "p"), (None, "http://h/x", None, None, None), (2, "http://h/x", "", "t", "p"), (2, "http://h/x", "", "t", "p")]
    pages = spark.createDataFrame(rows, schema)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in wrappers.main_text(pages).collect()) == [(0, "", 0), (1, "a", 1), (2, "", 0), (2, "", 0)]
    assert wrappers.main_text(pages.limit(0)).collect() == []


# components


def test_components_equal_brute_force(spark):
    rand = random.Random(11)
    path = list(range(100, 160))
    rand.shuffle(path)
    pairs = [(rand.randrange(100), rand.randrange(100)) for _ in range(70)] + list(zip(path, path[1:])) + [(200, 200 + i) for i in range(1, 40)]
    root = {x: x for p in pairs for x in p}
    for a, b in pairs:
        least, most = sorted((root[a], root[b]))
        root = {x: least if r == most else r for x, r in root.items()}
    rand.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(9)
    joined = {x for a, b in pairs if a != b for x in (a, b)}
    for per_task in (1000, 20):
        assert {r.node: r.root for r in shared.components(edges, per_task).collect()} == {x: root[x] for x in joined}
    assert shared.components(edges.limit(0)).collect() == []


# exact dedup


def test_exact_dedup_equals_brute_force(spark):
    rand = random.Random(3)
    texts = [rand.choice(["a b", "a  b", "a\tb", "c", None, "", " ", prose(rand.randrange(20), 30)]) for _ in range(400)]
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", x or "") for x in texts]
    first, size = {}, collections.Counter(norm)
    for i, x in enumerate(norm):
        first.setdefault(x, i)
    want = [(i, first[x], size[x], first[x] == i, hashlib.sha256(x.encode()).hexdigest()) for i, x in enumerate(norm)]
    docs = frame(spark, texts).repartition(7)
    assert sorted(map(tuple, exact_dedup.mark_copies(docs).collect())) == want
    kept = {(r.doc_id, r.text) for r in exact_dedup.keep_first(docs).collect()}
    assert kept == {(i, texts[i]) for i in first.values()}


def test_exact_dedup_compares_texts_of_one_digest(spark):
    rows = spark.createDataFrame([(1, "d", "x"), (2, "d", "x"), (3, "d", "y")], "id long, digest string, text string")
    assert sorted(map(tuple, exact_dedup.combine(rows).collect())) == [("d", "x", 1, 2), ("d", "y", 3, 1)]


# sharding


def test_shards_are_near_equal_gapless_and_follow_the_key(spark):
    texts = [prose(i % 300, 1 + i * 7 % 90) for i in range(1500)] + ["hot copy of one text"] * 800
    rows = sharding.shard_by_bytes(frame(spark, texts), 8).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    share = sum(sizes.values()) / 8
    assert set(sizes) == set(range(8)) and all(abs(x - share) <= max(r.size for r in rows) for x in sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    key = F.xxhash64("text").alias("key")
    keys = {r.doc_id: r.key for r in frame(spark, texts).select("doc_id", key).collect()}
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order, key=lambda i: (keys[i], i))


def test_search_in_boundaries(spark):
    bounds = [(-5, 0), (0, 3), (0, 9), (7, 1)]
    rows = [(k, i) for k in (-9, -5, 0, 3, 7, 8) for i in (0, 1, 3, 5, 9)]
    got = spark.createDataFrame(rows, "k long, i long").select("k", "i", sharding.position_in(bounds, F.col("k"), F.col("i"))).collect()
    assert all(n == sum(b <= (k, i) for b in bounds) for k, i, n in got)


# pseudonyms


def luhn(number: str) -> bool:
    figures = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(figures)) % 10 == 0


def remainder(iban: str) -> int:
    flat = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97


def test_pseudonyms_keep_format_and_link_equal_values(spark):
    values = ["4111 1111 1111 1111", "4111111111111111", "4111111111111112", "2024-02-29", "29.02.2024", "2/29/2024", "2023-02-29", "123-45-6789", "000-45-6789", "+1 (017) 555-7713", "10.0.0.255", "10.0.0.256", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "jane.doe9@example.org"]
    out = {x: r.text[1:-1] for x, r in zip(values, sorted(pii.pseudonymise(frame(spark, [f"<{x}>" for x in values]), "key").collect()))}
    for same in ("4111111111111112", "2023-02-29", "000-45-6789", "10.0.0.256", "GB82 WEST 1234 5698 7654 33"):
        assert out[same] == same
    changed = {x: y for x, y in out.items() if x != y}
    assert len(changed) == 10
    for x, y in changed.items():
        if "@" not in x:
            assert re.sub(r"\d+", "0", x) == re.sub(r"\d+", "0", y)
    assert luhn(out["4111111111111111"]) and out["4111 1111 1111 1111"].replace(" ", "") == out["4111111111111111"]
    assert remainder(out["GB82 WEST 1234 5698 7654 32"]) == 1
    day = out["2024-02-29"].split("-")
    assert out["29.02.2024"].split(".") == day[::-1] and [int(x) for x in out["2/29/2024"].split("/")] == [int(day[1]), int(day[2]), int(day[0])]
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{3}\d@example\.org", out["jane.doe9@example.org"])


def test_feistel_is_a_bijection_of_its_domain(spark):
    pair = pii.feistel(F.col("id") % 19, F.floor(F.col("id") / 19), F.lit(19), F.lit(23), "k", "test")
    rows = spark.range(19 * 23).select(pair.alias("p")).select("p.l", "p.r").distinct().collect()
    assert len(rows) == 19 * 23 and all(0 <= r.l < 19 and 0 <= r.r < 23 for r in rows)
    digits = spark.range(1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("d")).distinct().collect()
    assert len(digits) == 1000 and all(re.fullmatch(r"\d{3}", r.d) for r in digits)


def test_pseudonyms_leave_other_text_alone(spark):
    texts = ["Version 2.0. of 3. at 12", "no figures", "x 1 2 3 y", None]
    got = sorted(pii.pseudonymise(frame(spark, texts), "key").collect())
    assert [r.text for r in got] == texts and not any(r.changed for r in got)


# language model


def test_scores_equal_brute_force(spark):
    texts = [prose(i, 40, 60) for i in range(120)] + [None, "unseen words only here"]
    ids = list(range(len(texts)))
    trained = [i for i in ids if i % 5]
    rows = {r.doc_id: r for r in ngram_lm.score(frame(spark, texts), F.col("doc_id") % 5 != 0).collect()}
    tokens = {i: [*(texts[i] or "").lower().split(), "\n"] for i in ids}
    count = collections.Counter(w for i in trained for w in tokens[i])
    pairs = collections.Counter(p for i in trained for p in zip(["^", *tokens[i]], tokens[i]))
    n, v = sum(count.values()), len(count)
    model = ngram_lm.train(frame(spark, [texts[i] for i in trained], trained).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw")))
    assert (model.tokens, model.types) == (n, v) and abs(model.weights.sum(axis=1) - 1).max() < 1e-9
    for i in ids:
        base = score = 0.0
        for u, w in zip(["^", *tokens[i]], tokens[i]):
            base += math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1)))
            # every word seen is frequent at this size; unseen ones share the context of rare words, which has no tokens
            seen = len(trained) if u == "^" else count[u]
            a, b, c = model.weights[int(math.log2(seen + 1))]
            score += math.log10(a * pairs[u, w] / max(seen, 1) + b * count[w] / n + c / (v + 1))
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 0, len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_rare_words_take_the_hashed_way(spark):
    texts = [prose(i, 60, 400) for i in range(60)]
    run = lambda **k: {r.doc_id: r for r in ngram_lm.score(frame(spark, texts), F.col("doc_id") % 5 != 0, **k).collect()}
    wide, narrow = run(), run(bits=6, paired=2)
    tokens = {i: [*texts[i].split(), "\n"] for i in wide}
    count = collections.Counter(w for i in wide if i % 5 for w in tokens[i])
    n = sum(count.values())
    often = {w for w, k in count.items() if k * 64 >= n}
    assert often == {"\n"}
    trained = [texts[i] for i in wide if i % 5]
    raw = frame(spark, trained, [i for i in wide if i % 5]).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("raw"))
    model = ngram_lm.train(raw, 6, 2)
    # but for the start of a text, all contexts are one: any other word
    pairs = collections.Counter((at > 0, w) for i in wide if i % 5 for at, w in enumerate(tokens[i]))
    for i in wide:
        assert wide[i][:5] == narrow[i][:5] and narrow[i].base_score == pytest.approx(wide[i].base_score)
        want = 0.0
        for at, w in enumerate(tokens[i]):
            seen = n - len(trained) if at else len(trained)
            a, b, c = model.weights[int(math.log2(seen + 1))]
            want += math.log10(a * pairs[at > 0, w] / seen + b * count[w] / n + c / (len(count) + 1))
        assert narrow[i].score == pytest.approx(want)


def test_rare_words_are_contexts_of_their_own(spark, monkeypatch):
    texts = [prose(i, 60, 150) for i in range(60)]
    run = lambda: {r.doc_id: r for r in ngram_lm.score(frame(spark, texts), F.col("doc_id") % 5 != 0, paired=2).collect()}
    wide = run()
    monkeypatch.setattr(ngram_lm, "BITS", 6)
    narrow = run()
    for i in wide:
        assert wide[i][:5] == narrow[i][:5]
        assert narrow[i].base_score == pytest.approx(wide[i].base_score) and narrow[i].score == pytest.approx(wide[i].score)


def test_a_tenth_of_the_tokens_is_held_out(spark, monkeypatch):
    texts = [prose(i, 10, 500) for i in range(800)]
    held = []
    monkeypatch.setattr(ngram_lm, "held_out_gain", lambda events: held.append(events.agg(F.sum("n")).first()[0]) or (lambda weights: weights * 0))
    model = ngram_lm.train(frame(spark, texts, [None] * 800).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("raw")))
    assert model.tokens == 800 * 11 and 0.06 * model.tokens < held[0] < 0.14 * model.tokens


def test_mixture_finds_the_weights_of_its_source():
    import numpy as np

    rand = np.random.default_rng(1)
    estimates = rand.dirichlet([0.3] * 3, 4000)
    truth = np.array([0.6, 0.3, 0.1])
    n = rand.poisson(200 * estimates @ truth)
    got = ngram_lm.mixture(np.zeros(4000, int), estimates, n, 2, 400)
    likelihood = lambda w: (n * np.log(estimates @ w)).sum()
    assert all(likelihood(got[0]) >= likelihood(w) - 1e-6 * abs(likelihood(w)) for w in rand.dirichlet([1] * 3, 200))
    assert got[1] == pytest.approx(got[0])


def test_equal_held_out_events_are_one_and_weigh_the_same():
    import numpy as np
    import pyarrow as pa

    rand = np.random.default_rng(3)
    columns = [rand.integers(0, 3, 5000), *(rand.integers(0, 3, 5000) / 4 for _ in range(2)), np.full(5000, 0.01), rand.integers(1, 4, 5000) * 1.0]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 700]) for c in columns], list("abcde")) for i in range(0, 5000, 700)]
    (pack,) = ngram_lm._collapsed(iter(batches))
    where, *estimates, n = (np.frombuffer(c[0].as_py(), np.int64 if i == 0 else np.float64) for i, c in enumerate(pack.columns))
    assert len(n) == 27 and n.sum() == columns[4].sum()
    weights = rand.dirichlet([1] * 3, 4)
    want = ngram_lm.gained(columns[0], np.stack(columns[1:4], axis=1), columns[4], weights)
    assert ngram_lm.gained(where, np.stack(estimates, axis=1), n, weights) == pytest.approx(want)


def test_tokens_are_dealt_once_for_weights_and_scores(spark):
    rows = frame(spark, [prose(i, 30, 60) for i in range(40)]).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("raw"))
    _, blocks, n_blocks = ngram_lm._learn(rows.select("id", "raw", ngram_lm.flagged(rows, F.col("id") % 5 != 0).alias("flag")), None, 2)
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("dealt again", "blocks read a second time")
    assert blocks.mapPartitions(lambda rows: [len({r["block"] for r in rows})]).sum() <= n_blocks
    context.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup("dealt again") for s in tracker.getJobInfo(job).stageIds]
    assert sum(s is not None and s.numCompletedTasks > 0 for s in stages) == 1


def test_a_task_has_one_block_and_nothing_stays_in_memory(spark):
    rows = frame(spark, [prose(i, 30, 60) for i in range(40)]).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("raw"))
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    before = held()
    _, blocks, n_blocks = ngram_lm._learn(rows.select("id", "raw", ngram_lm.flagged(rows, F.col("id") % 5 != 0).alias("flag")), None, 2)
    found = blocks.mapPartitions(lambda rows: [sorted({r["block"] for r in rows})]).collect()
    assert held() <= before
    assert len(found) == n_blocks and all(x in ([], [i]) for i, x in enumerate(found))


def test_a_round_of_learning_sends_no_events_to_python(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    rand = np.random.default_rng(4)
    columns = {"bucket": rand.integers(0, 3, 3000), **{c: rand.integers(0, 3, 3000) / 4 for c in ("one", "two")}, "three": np.full(3000, 0.01), "n": rand.integers(1, 4, 3000) * 1.0}
    gain = ngram_lm.held_out_gain(spark.createDataFrame(pd.DataFrame(columns)))
    weights = rand.dirichlet([1] * 3, 4)
    want = ngram_lm.gained(columns["bucket"], np.stack([columns[c] for c in ("one", "two", "three")], axis=1), columns["n"], weights)
    plans, frames = [], type(spark.range(0))
    collect = frames.collect
    monkeypatch.setattr(frames, "collect", lambda frame: plans.append(frame._jdf.queryExecution().optimizedPlan().toString()) or collect(frame))
    assert gain(weights) == pytest.approx(want)
    (plan,) = plans
    assert "InMemoryRelation" in plan and "MapInArrow" not in plan.split("InMemoryRelation")[0]



# Jaccard join


def shingle_sets(texts):
    out = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def least_reachable(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def near_copies(seed: int, n: int) -> list[str]:
    rand = random.Random(seed)
    bases = [prose(seed * 100 + i, rand.choice([3, 5, 8, 40, 150, 400, 700])).split() for i in range(12)]
    out = []
    for _ in range(n):
        w = list(rand.choice(bases))
        for _ in range(rand.choice([0, 0, 1, 2, len(w) // 40, len(w) // 25])):
            w[rand.randrange(len(w))] = f"x{rand.randrange(10**6)}"
        if rand.random() < 0.3:
            w += bases[0][:30]
        out.append(" ".join(w))
    return [*out, None, "", "A b c", "a B c"]


@pytest.mark.parametrize("rows_in_block", [1024, 6])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, rows_in_block):
    monkeypatch.setattr(jaccard_join, "ROW_BLOCK", rows_in_block)
    texts = near_copies(5, 160)
    sets = shingle_sets(texts)
    want = [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, least_reachable(sets)))]
    assert sorted(map(tuple, jaccard_join.near_components(frame(spark, texts)).collect())) == want


def test_jaccard_join_with_frequent_columns_last(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SAMPLED", 40)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    texts = near_copies(9, 120)
    sets = shingle_sets(texts)
    want = [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, least_reachable(sets)))]
    assert sorted(map(tuple, jaccard_join.near_components(frame(spark, texts)).collect())) == want


def test_shingles_count_distinct_runs():
    known = words.WordHash()
    for text in (b"", b"a", b"a b c d", b"a b c d e", b"A b a b a b a b", b"x y z " * 9):
        want = shingle_sets([text.decode()])[0]
        assert len(words.shingles(words.hashed(words.split_words(text), known))) == len(want)


# BPE


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rand = random.Random(2)
    parts = ["abcdefgh", "the", "ΣσΑς", "éèñ", " \t\n", "\x1c\x85\xa0 ", "'s't'll", "0123", "!!?<|endoftext|>", "中文字", "\U0001f600", "İı", "é", "ab" * 90, "a" * 200]
    texts = [*ODD, *("".join(rand.choice(rand.choice(parts)) if rand.random() < 0.6 else rand.choice(parts) for _ in range(60)) for _ in range(150))]
    got = sorted(bpe.encode(frame(spark, texts), VOCABULARY).collect())
    byte_of = {c: b for b, c in enumerate(bpe.visible_bytes())}
    special = {i: t.content for i, t in library.get_added_tokens_decoder().items()}
    own_bytes = lambda t: bytes(byte_of[c] for c in t.removesuffix("</w>")) + b" " * t.endswith("</w>")
    spelled = lambda ids: b"".join(special[i].encode() if i in special else own_bytes(library.id_to_token(i)) for i in ids)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for text, r in zip(texts, got):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (list(r.ids), r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == sha(" ".join(map(str, ids))) and r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
        assert r.text_sha256 == sha(spelled(ids).decode())


def test_transducer_is_streaming_and_neighbours_stay_apart():
    with open(VOCABULARY, "rb") as source:
        tokenizer = bpe.Tokenizer(source.read())
    merges, rand = tokenizer.merges, random.Random(4)
    names = [t for t in list(tokenizer.ids)[:20000] if not t.endswith("</w>")]
    for _ in range(3000):
        a, b = rand.choice(names), rand.choice(names)
        if merges.merged(list(a)) == [a] and merges.merged(list(b)) == [b]:
            assert merges.stay_apart(a, b) == (merges.merged([*a, *b]) == [a, b])
    word = "".join(rand.choice("etaoinshr") for _ in range(3000))
    assert list(merges.transduce(word)) == merges.merged([*word[:-1], word[-1] + "</w>"])
    first = next(merges.transduce(word))
    assert word.startswith(first)
    assert tokenizer.decode(map(int, tokenizer.encode("Ünï 中文 \U0001f600!").split())) == "ünï 中文 \U0001f600! "


# language identification


def test_languages_are_told_apart(spark):
    alphabets = {"one": "abcdefg", "two": "defghij", "three": "xyzabcd"}
    rand = random.Random(8)
    text = lambda letters: " ".join("".join(rand.choice(letters) for _ in range(rand.randint(2, 7))) for _ in range(40))
    rows = [(i, text(alphabets[k]), k, "s", 0) for i, k in enumerate(rand.choices(list(alphabets), k=300))] + [(900, "12 34 !", "one", "s", 0), (901, None, "one", "s", 0), (902, "abc", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language_id.predict(docs, F.col("doc_id") % 3 != 1).collect()}
    held = [(got[i].lang_pred, k) for i, _, k, _, _ in rows[:300] if i % 3 == 1]
    assert all(got[i].held_out == (i % 3 == 1) for i in got) and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (900, 901)] == ["und", "und"] and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in language_id.keep_known(docs, F.col("doc_id") % 3 != 1).collect()}
    assert kept == set(got) - {900, 901}


def test_kernel_counts_shared_ngrams():
    grams = lambda s: {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    a, b = "the cat sat", "the bat"
    bits = [language_id.presence(x) for x in (a, b)]
    assert (bits[0] & bits[1]).sum() == pytest.approx(len(grams(a) & grams(b)), abs=1)
    assert bits[0].sum() == pytest.approx(len(grams(a)), abs=1)


# line dedup


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_patience_aligns_in_order():
    rand = random.Random(6)
    for _ in range(300):
        a, b = ([rand.randrange(30) for _ in range(rand.randrange(14))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found) and found == sorted(found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:])) and len(found) <= longest_common(a, b)
    unique = rand.sample(range(100), 40)
    shuffled = rand.sample(unique, 40)
    assert len(line_dedup.patience(unique, shuffled)) == longest_common(unique, shuffled)


def test_common_blocks_go_from_the_later_document(spark):
    line = lambda k: f"line {k} of eight words in all here"
    texts = ["\n".join(map(line, range(6))), "\n".join([line(90), line(2), line(3), "short", line(91)]), "short\nother", "\n".join([line(91), line(2)]), None, ""]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0].deleted_lines == []
    assert got[1].deleted_lines == [1, 2] and got[1].text == "\n".join([line(90), "short", line(91)])
    assert got[2].text == texts[2]
    assert got[3].deleted_lines == [0, 1] and got[3].text == ""
    assert got[4].text is None and got[4].n_lines == 0 and got[5].text == ""


def test_a_block_is_found_though_each_line_has_an_earlier_owner(spark):
    line = lambda k: f"line {k} of five words"
    passage = "\n".join(map(line, range(12)))
    texts = [*(f"{line(k)}\nown {k}" for k in range(12)), passage, "own\n" + passage]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got[12].deleted_lines == [] and got[13].deleted_lines == list(range(1, 13))


def test_no_common_block_is_left():
    line = lambda k: {"line": k, "words": 8}
    placed = lambda x: [line(ord(k)) | {"place": i} for i, k in enumerate(x)]
    assert line_dedup.deleted(placed("PX"), placed("RPSPT"), 8) == [1, 3]
    rand = random.Random(3)
    for _ in range(500):
        a, b = ([{"line": rand.randrange(6), "words": rand.randint(1, 4), "place": p} for p in sorted(rand.sample(range(30), 14))] for _ in range(2))
        for x in a + b:
            x["words"] = 1 + x["line"] % 4
        cuts = lambda x: [x[i:j] for i in range(len(x)) for j in range(i + 1, len(x) + 1) if x[j - 1]["place"] - x[i]["place"] == j - 1 - i and sum(y["words"] for y in x[i:j]) >= 5]
        have = {tuple(y["line"] for y in x) for x in cuts(a)}
        gone = line_dedup.deleted(a, b, 5)
        common = {y["place"] for x in cuts(b) if tuple(y["line"] for y in x) in have for y in x}
        assert len(gone) == len(set(gone)) and set(gone) <= common
        assert not any(tuple(y["line"] for y in x) in have for x in cuts([y for y in b if y["place"] not in set(gone)]))


# decontamination


def tiled(text, item, least):
    """Greedy tiling by trying all pairs of places."""
    done_a, done_b, out = set(), set(), []
    while True:
        best = (0,)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in done_a and j + n not in done_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sorted(out)
        n, i, j = best
        out.append((i, j, n))
        done_a.update(range(i, i + n))
        done_b.update(range(j, j + n))


def test_tiles_equal_brute_force():
    import numpy as np

    rand = random.Random(7)
    for _ in range(150):
        item = [rand.randrange(9) for _ in range(rand.randrange(3, 24))]
        text = [rand.randrange(9) for _ in range(rand.randrange(40))]
        for _ in range(rand.randrange(3)):
            at = rand.randrange(len(item))
            text += item[at : at + rand.randrange(3, 12)]
        a, b = np.array(text, np.int64), np.array(item, np.int64)
        seeds = [(i, j) for i in range(len(text) - 2) for j in range(len(item) - 2) if text[i : i + 3] == item[j : j + 3]]
        got = decontaminate.tile(a, b, seeds, 3)
        want = tiled(text, item, 3)
        assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want)
        assert got == want


def test_reordered_passages_are_caught(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    items = [prose(70 + i, 30, 10**6) for i in range(6)] + [None, "too short"]
    w = items[0].split()
    texts = [prose(1, 50) + " " + " ".join([*w[15:], "between", *w[:15]]) + " end", items[1].upper().replace(" ", "!! "), " ".join(items[2].split()[:9]), prose(3, 80), None, "too short"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.matches(frame(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 1)} and all(r.coverage == 1.0 for r in got)
    assert sorted(r.doc_id for r in decontaminate.clean(frame(spark, texts), bench).collect()) == [2, 3, 4, 5]


# wrappers

PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>menu</a><li>b</ul></nav><div class='ad'>buy</div>%s<footer>&copy; f</footer></body></html>"


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE % "<article><h1>T &amp; U</h1><p><b>One<br><p>two  <i>t</i>wo&nbsp;x</p></article>", "T & U One two two x"),
        (PAGE % "<article><p>a</p><form>f</form><div id='comments'><p>c</p></div><script>var x='</p>'</script><p>b</article>", "a b"),
        (PAGE % "<div class=content><p>words of the text</p><p>more words</p></div><div class='sidebar'>s</div>", "words of the text more words"),
        ("just text &lt;b&gt;", "just text <b>"),
        ("<p>open <b>bold", "open bold"),
        ("<!-- <p>x</p>", ""),
    ],
)
def test_extract(page, text):
    assert wrappers.extract(page, None) == text


def test_wrapper_has_optional_and_repeated_groups_and_slots():
    pages = [PAGE % f"<article><h1>{i}</h1><p>x{i}</p>{'<p>y</p>' * i}{'<table><tr><td>t</table>' * (i == 2)}</article>" for i in range(3)]
    made = wrappers.expression(wrappers.parse(pages[0]))
    for page in pages[1:]:
        made = wrappers.merge(made, wrappers.expression(wrappers.parse(page)))
    body = next(x for x in made["in"][0]["in"] if x["key"] == "body")
    article = next(x for x in body["in"] if x["key"] == "article")
    groups = {x["key"]: x for x in article["in"]}
    assert groups["p"]["rep"] and not groups["p"]["opt"] and groups["p"]["slot"] == -1
    assert groups["table"]["opt"] and groups["h1"]["slot"] == -1 and not groups["h1"]["rep"]
    assert wrappers.article_path(made) == ["html", "body", "article"]
    assert json.loads(json.dumps(made)) == made


def test_host_wrapper_finds_the_slot_that_varies(spark):
    page = lambda i: f"<body><div class=t>{'the same words on all pages of this host ' * 9}</div><div class=m><p>{prose(i, 20)}</p></div></body>"
    pages = spark.createDataFrame([(i, "https://Host.example:80/p", page(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.main_text(pages).collect()} == {i: prose(i, 20) for i in range(8)}


def test_bpe_reads_a_known_word_once_whatever_stands_beside_it(monkeypatch):
    with open(VOCABULARY, "rb") as source:
        tokenizer = bpe.Tokenizer(source.read())
    apart = tokenizer.read("qzalphaxx ( ) Zürïch , q")
    monkeypatch.setattr(tokenizer, "decode", lambda ids: pytest.fail("decoded again"))
    monkeypatch.setattr(tokenizer.merges, "numbers", lambda symbols: pytest.fail("encoded again"))
    assert tokenizer.read("(qzalphaxx) ZÜRÏCH, q") == tokenizer.read("( QZalphaxx ) zürïch , Q")
    assert tokenizer.read("(qzalphaxx)")[0].split() == [i for w in ("(", "qzalphaxx", ")") for i in tokenizer.read(w)[0].split()]
    assert apart == tokenizer.read("qzalphaxx ( ) zürïch , q")


def test_bpe_forgets_neighbours_beyond_its_bound(monkeypatch):
    with open(VOCABULARY, "rb") as source:
        tokenizer, small = bpe.Tokenizer(source.read()), None
        source.seek(0)
        small = bpe.Tokenizer(source.read())
    text = " ".join(f"{w}ish{w[::-1]}ness" for w in prose(5, 400).replace("w", "ab").split())
    whole = tokenizer.read(text)
    monkeypatch.setattr(bpe, "NEIGHBOURS", 5)
    assert small.read(text) == whole
    assert sum(map(len, small.merges.apart.values())) <= 10
