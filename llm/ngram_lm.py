"""LM scoring by deleted interpolation of word bigrams.

The probability of a word after its context is a mix of three maximum-likelihood estimates, those of the bigram, of the
word and of any word alike. The mixture weights depend on how often the context was seen: contexts are pooled in buckets of
powers of two, and expectation-maximisation learns each bucket's weights on the counts of a tenth of the training documents,
drawn by a hash of id and text, that is held out from the counts mixed. Each round adds up the posteriors of all held-out
bigrams in tasks; the driver gets three sums for each bucket.

Counts are those of all training documents. A context is the word before, or the start of the text; every word is a context
of its own. Frequent words, those that are a 2 ** -17 part of all tokens or more (at most 2 ** 17 words), are broadcast with
their counts, which are those of the contexts as well; rare words meet their counts where they are dealt to.

Every token is dealt once to the block of its bigram, of its word if that is rare, else of its context if that is rare; the
blocks are read twice, for the held-out bigrams that the weights are learnt on and for the scores. A block counts words and bigrams over the training documents. As a rare word is a token of its block, so is its count as a
context there. A rare word after a rare word takes the count of its word along and is dealt once more, by its context, to
where that is counted. Blocks give back one sum per document. Pairs of the 512 most frequent words, which alone can be so
frequent that a block would overflow, stay together by portion of text and are counted by partial sums.

A caller who gives `bits` asks for another model: words that are no 2 ** -bits part of all tokens make one context together.

Words are 64-bit hashes. Defined results: a null text is empty and has its end as the only token; a null id belongs to the
training documents; repeated rows each give a row, and each counts; long texts are read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import weakref
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import plain, text_or_empty
from llm.words import REMEMBERED, cells, mixed, portions, split_words

#: Bits of a word's place among the frequent ones, and the number of those whose pairs are counted beforehand.
BITS, PAIRED = 17, 512
#: Share of the training documents that is held out for the mixture weights, rounds of learning.
HELD_OUT, ROUNDS = 0.1, 30
#: Held-out bigrams in a task and in a pack, if there are more than that.
EVENTS = 500_000
#: Rows that a task gives back at once.
BATCH = 10_000
#: Tokens in a block, and blocks at least: a document's sums come from up to so many blocks at any size of input.
BLOCK, LEAST_BLOCKS = 2_500_000, 48
#: The end of a text counts as a word; no word contains a line feed.
END = xxhash.xxh64_intdigest(b"\n")
RARE = np.uint64(1 << 63)
#: Least weight of the even estimate, so that every word has a chance.
LEAST = 1e-4


class Model(NamedTuple):
    """What tasks know: frequent words (hash and count, most frequent first), the bits of their places, whether rare words
    are one context, counts of contexts (the frequent words, that one, the start of a text), totals, the parts of these held
    out, mixture weights, counts of pairs of top words."""

    bits: int
    pooled: bool
    words: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    tokens: int
    types: int
    held_counts: np.ndarray
    held_contexts: np.ndarray
    held_tokens: int
    weights: np.ndarray
    pairs: np.ndarray

    def chance(self, context: np.ndarray, bigram: np.ndarray, word: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """Mixed estimates of words after contexts, given by their places in `seen`, the counts of contexts (else those
        broadcast); the factors of each context are worked out once, not for each word."""
        seen = self.contexts if seen is None else seen
        weights = self.weights[bucket(seen)]
        out = (weights[:, 0] / np.maximum(seen, 1))[context] * bigram
        out += (weights[:, 1] / max(1, self.tokens))[context] * word
        out += (weights[:, 2] / (self.types + 1))[context]
        return out

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def bucket(count: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(count, 0) + 1).astype(np.int64)


class Codes(dict):
    """A word's place among the frequent ones, else its hash with the highest bit set."""

    def __init__(self, words: np.ndarray, bits: int, pooled: bool):
        self.place = {w: i for i, w in enumerate(words.tolist())}
        self.other, self.start, self.pooled = 1 << bits, (1 << bits) + 1, pooled

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        name = xxhash.xxh64_intdigest(word) if word != b"\n" else END
        value = self[word] = self.place.get(name, name | 1 << 63)
        return value

    def events(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens of some texts: context, word, number of the text. The words themselves are held of one text at a time."""
        found = [np.fromiter(map(self.__getitem__, [*split_words(x), b"\n"]), np.uint64) for x in raw]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        word = np.concatenate(found)
        del found
        context = np.empty(len(word), np.uint64)
        context[1:] = np.where(word[:-1] >= RARE, np.uint64(self.other), word[:-1]) if self.pooled else word[:-1]
        context[np.cumsum(sizes) - sizes] = self.start
        return context, word, np.repeat(np.arange(len(raw), dtype=np.int32), sizes)


def bigram_key(context: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """One number for a bigram: exact for frequent words, hashed if one is rare."""
    c = context.astype(np.uint64)
    return np.where((word >= RARE) | (c >= RARE), mixed(word + mixed(c) * np.uint64(0x9E3779B97F4A7C15)) | RARE, c << np.uint64(bits + 1) | word)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of rows (raw, held), with how often they stand in all of them and in those held out."""

    def flush():
        names = list({**seen, **held})
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
        return pa.RecordBatch.from_arrays([_signed(hashes), *(pa.array([c[w] for w in names], pa.int64()) for c in (seen, held))], ["word", "n", "held"])

    seen, held = Counter(), Counter()
    for batch in portions(batches, 0):
        for raw, out in zip(cells(batch.column(0)), batch.column(1).to_pylist()):
            found = [*split_words(raw), b"\n"]
            seen.update(found)
            if out:
                held.update(found)
            if len(seen) >= REMEMBERED // 2:
                yield flush()
                seen.clear()
                held.clear()
    yield flush()


def gained(buckets: np.ndarray, estimates: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How many of the n events of each bucket fall to each estimate under the weights; the last row is that of all events."""
    out = np.zeros(weights.shape)
    for groups, many in ((buckets, len(weights) - 1), (np.zeros(len(n), np.int64), 1)):
        share = weights[groups if many > 1 else groups + len(weights) - 1] * estimates
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        rows = slice(0, many) if many > 1 else slice(len(weights) - 1, None)
        out[rows] = np.stack([np.bincount(groups, share[:, k], many) for k in range(estimates.shape[1])], axis=1)
    return out


def fit(gain, size: int, rounds: int = ROUNDS, estimates: int = 3) -> np.ndarray:
    """Weights of the estimates in each bucket that make held-out events most likely, by expectation-maximisation; `gain`
    gives the posterior sums of each bucket and of all events. Buckets without events take the weights of all together."""
    weights = np.full((size + 1, estimates), 1 / estimates)
    for _ in range(rounds):
        sums = gain(weights)
        total = sums.sum(axis=1, keepdims=True)
        if not total.any():
            break
        weights = np.where(total > 0, sums / np.maximum(total, 1e-300), weights)
    weights = np.maximum(np.where(total[:-1] > 0, weights[:-1], weights[-1]), LEAST)
    return weights / weights.sum(axis=1, keepdims=True)


def mixture(buckets: np.ndarray, estimates: np.ndarray, n: np.ndarray, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """The weights for events that fit in memory."""
    return fit(lambda weights: gained(buckets, estimates, n, weights), size, rounds, estimates.shape[1])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events in packs; those of one bucket with equal estimates are one event."""

    def flush():
        *keys, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort(keys)
        keys, n = [k[order] for k in keys], n[order]
        first = np.ones(len(n), bool)
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.flatnonzero(first)
        columns = *(k[starts] for k in keys), np.add.reduceat(n, starts)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["bucket", "one", "two", "three", "n"])

    held, many = [], 0
    for batch in batches:
        if len(batch):
            held.append([x.to_numpy() for x in batch.columns])
            many += len(batch)
        if many >= EVENTS:
            yield flush()
            held, many = [], 0
    if held:
        yield flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events, equal ones of a pack as one."""
    for pack in _collapsed(batches):
        columns = [np.frombuffer(x[0].as_py(), np.int64 if i == 0 else np.float64) for i, x in enumerate(pack.columns)]
        yield from pa.table([pa.array(x) for x in columns], names=pack.schema.names).to_batches(max_chunksize=BATCH)


def held_out_gain(events: DataFrame):
    """Posterior sums over rows (bucket, one, two, three, n), added up by bucket. The events are held as columns, and meet the
    weights of a round, one row for each bucket, in a join, for as long as the function that is returned lives."""
    held = events.mapInArrow(_merged, "bucket bigint, one double, two double, three double, n double").persist()
    estimates = ("one", "two", "three")

    def posteriors(weights: list[str], names: list[str]) -> list[Column]:
        shares = [F.col(w) * F.col(e) for w, e in zip(weights, estimates)]
        scale = F.col("n") / F.greatest(sum(shares[1:], shares[0]), F.lit(1e-300))
        return [F.sum(x * scale).alias(name) for x, name in zip(shares, names)]

    def gain(weights: np.ndarray) -> np.ndarray:
        size = len(weights) - 1
        # those of the bucket and those of all buckets together
        table = {"bucket": np.arange(size)} | {f"{w}{e}": x for w, own in (("own_", weights[:-1]), ("all_", np.tile(weights[-1], (size, 1)))) for e, x in zip(estimates, own.T)}
        joined = held.join(F.broadcast(events.sparkSession.createDataFrame(pa.table(table))), "bucket")
        own, every = ([f"{w}{e}" for e in estimates] for w in ("own_", "all_"))
        sums = joined.groupBy("bucket").agg(*posteriors(own, own), *posteriors(every, every)).collect()
        out = np.zeros(weights.shape)
        for r in sums:
            out[r["bucket"]] = [r[c] for c in own]
            out[-1] += [r[c] for c in every]
        return out

    weakref.finalize(gain, held.unpersist).atexit = False
    return gain


def counted(rows: DataFrame, bits: int | None, paired: int) -> Model:
    """The model of rows (raw, flag) as far as words tell: all but the mixture weights and the pairs of top words."""
    pooled, bits = bits is not None, BITS if bits is None else bits
    words = rows.where(F.col("flag") > 0).select("raw", (F.col("flag") > 1).alias("held"))
    words = words.mapInArrow(_count_words, "word bigint, n bigint, held bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    words = words.persist()
    tokens, types, held_tokens = (x or 0 for x in words.agg(F.sum("n"), F.count(F.lit(1)), F.sum("held")).first())
    top = words.where(F.col("n") * (1 << bits) >= tokens).toArrow()
    ends = words.where(F.col("word") == int(np.uint64(END).astype(np.int64))).select("n", "held").first() or (0, 0)
    words.unpersist()
    names, counts, held_counts = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["held"].to_numpy()
    order = np.lexsort((names, -counts))
    names, counts, held_counts = names[order], counts[order], held_counts[order]
    other, start = 1 << bits, (1 << bits) + 1
    contexts, held_contexts = np.zeros(start + 1, np.int64), np.zeros(start + 1, np.int64)
    for out, found, whole, end in ((contexts, counts, tokens, ends[0]), (held_contexts, held_counts, held_tokens, ends[1])):
        placed = np.where(names == END, 0, found)
        out[: len(names)] = placed
        out[other] = whole - end - placed.sum() if pooled else 0
        out[start] = end
    size = min(paired, len(names))
    return Model(bits, pooled, names, counts, contexts, tokens, types, held_counts, held_contexts, held_tokens, np.empty(0), np.zeros((size, size), np.int64))


def flagged(rows: DataFrame, train: Column) -> Column:
    """0 for rows that are not for training, 3 for those of them whose bigrams the weights are learnt on, 1 for the others."""
    held = F.pmod(F.xxhash64("id", "raw", F.lit("held out")), F.lit(1 << 30)) < int(HELD_OUT * (1 << 30))
    return F.when(~train, 0).when(held, 3).otherwise(1)


def train(rows: DataFrame, bits: int | None = None, paired: int = PAIRED) -> Model:
    """The model of rows (id, raw)."""
    return _learn(rows.select("id", "raw", flagged(rows, F.lit(True)).alias("flag")), bits, paired)[0]


def _learn(rows: DataFrame, bits: int | None, paired: int):
    """The model of rows (id, raw, flag), the tokens of all rows dealt to blocks, and how many blocks there are."""
    context, spark = rows.sparkSession.sparkContext, rows.sparkSession
    model = counted(rows, bits, paired)
    whole = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n_blocks = max(LEAST_BLOCKS, math.ceil(max(model.tokens * 1.25, whole / 8) / BLOCK))
    shared = context.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()
    numbered = rows.select("id", F.monotonically_increasing_id().alias("uid"), "flag", "raw")
    arrow_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    dealt = numbered.mapInArrow(_deal(shared, n_blocks, arrow_kind), f"block int, {_known(kind)}, first bigint, {_binary(PACKED)}")
    # the blocks are read twice, for the weights and for the scores; one shuffle of this RDD serves both. A task has one block
    blocks = dealt.repartitionById(n_blocks, "block").rdd

    passed = spark.createDataFrame(blocks.mapPartitions(_by_block(_events(shared, n_blocks))), f"block int, {_binary(EVENTS_PASSED)}", verifySchema=False)
    found = passed.groupBy("block").applyInArrow(_estimates(shared), "bucket bigint, one double, two double, three double, n double, top bigint, whole bigint, held bigint").persist()
    sums = found.where("top IS NOT NULL").groupBy("top").agg(F.sum("whole").alias("whole"), F.sum("held").alias("held")).toArrow()
    size = len(model.pairs)
    top, n, held = (sums[c].to_numpy() for c in ("top", "whole", "held"))
    if size:
        model.pairs[top // size, top % size] = n
        top, n, held = (x[held > 0] for x in (top, n, held))
    # top pairs that are held out are events as well, no more than paired squared
    columns = _event_columns(model, (model.contexts - model.held_contexts)[top // max(1, size)], n - held, (model.counts - model.held_counts)[top % max(1, size)], held)
    events = found.where("bucket IS NOT NULL").select(*columns).union(spark.createDataFrame(pd.DataFrame(columns), "bucket bigint, one double, two double, three double, n double"))
    weights = fit(held_out_gain(events.coalesce(1 + (found.count() + len(top)) // EVENTS)), 64)
    found.unpersist()
    return model._replace(weights=weights), blocks, n_blocks


def _event_columns(m: Model, context: np.ndarray, bigram: np.ndarray, word: np.ndarray, held: np.ndarray) -> dict:
    """Held-out bigrams with their estimates, by the counts that are not held out."""
    return {
        "bucket": bucket(context), "one": bigram / np.maximum(context, 1), "two": word / max(1, m.tokens - m.held_tokens),
        "three": np.full(len(held), 1 / (m.types + 1)), "n": held.astype(np.float64),
    }


def _rows(columns: dict, schema: list[tuple]) -> pa.Table:
    """Columns in the order of a schema; those that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.table([columns[k].cast(t) if k in columns else pa.nulls(n, t) for k, t in schema], names=[k for k, _ in schema])


def packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte of all: the upper bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpacked(blobs: list, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = [np.frombuffer(x, np.uint8).reshape(size, -1).T for x in blobs if x]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind).ravel() if parts else np.empty(0, kind)


#: What is dealt to blocks, packed: texts of a portion as distances from its first, their flags, then for each kind of tokens how
#: many a text has; pairs of frequent words, rare words with contexts, frequent words with rare contexts, pairs of top words;
#: last the counts of pairs of top words in a task.
PACKED = ("texts", "flags", "sizes", "pairs", "rare_sizes", "rare", "contexts", "after_sizes", "after", "words", "top_sizes", "top", "top_keys", "top_n", "top_held")
#: What blocks pass on for the weights: held-out bigrams with counts of their words and contexts, or with contexts to be counted;
#: counts of rare words; counts of pairs of top words.
EVENTS_PASSED = ("seen", "contexts", "n", "words", "held", "names", "kept", "top_keys", "top_n", "top_held")
#: What blocks pass on for the scores: tokens whose word is counted, counts of rare words as contexts, sums of texts.
PASSED = ("texts", "sizes", "after", "n", "counts", "names", "seen", "sum_texts", "sum_known", "sum_base", "sum_score")
KNOWN = ("uid", "held_out", "n_tokens", "n_known", "base_score", "score")


def _known(kind: str) -> str:
    return f"id {kind}, uid bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _binary(names) -> str:
    return ", ".join(f"{x} binary" for x in names)


def _layout(kind: pa.DataType, blobs: tuple) -> list[tuple]:
    """Names and types of rows: documents as far as they are known, and what is packed."""
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return [("block", pa.int32()), ("id", kind), *zip(KNOWN, types), *((x, pa.int64() if x == "first" else pa.binary()) for x in blobs)]


def _deal(model, n_blocks: int, kind: pa.DataType):
    """Rows of documents, with what is known of them where they are read, and their tokens packed by block. Pairs of top words
    stay together by portion; how often they stand in training documents is counted here."""
    schema = _layout(kind, ("first", *PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        codes = Codes(m.words, m.bits, m.pooled)
        size = len(m.pairs)
        whole, held, home = np.zeros(size * size, np.int64), np.zeros(size * size, np.int64), 0
        blobs = lambda rows: _rows({k: pa.array(v, schema[[n for n, _ in schema].index(k)][1]) for k, v in rows.items()}, schema).to_batches()
        for batch in portions(batches, 3):
            uid, flag = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint8)
            context, word, text = codes.events(cells(batch.column(3)))
            total = lambda x, w=None: np.bincount(x, w, len(uid)).astype(np.int64 if w is None else np.float64)
            often = word < RARE
            count = m.counts[word[often].astype(np.int64)] if len(m.counts) else np.empty(0)
            docs = {
                "block": pa.array((uid % n_blocks).astype(np.int32)), "id": batch.column(0), "uid": pa.array(uid), "held_out": pa.array(flag == 0), "n_tokens": pa.array(total(text)),
                "n_known": pa.array(total(text[often])), "base_score": pa.array(total(text[often], m.base(count))), "score": pa.array(np.zeros(len(uid))),
            }
            yield from _rows(docs, schema).to_batches()
            top = often & (context < size) & (word < size)
            home = int(mixed(uid[:1].astype(np.uint64))[0] % np.uint64(n_blocks))
            if top.any():
                key, own = (context[top] * np.uint64(size) + word[top]).astype(np.int64), flag[text[top]]
                whole += np.bincount(key[own > 0], minlength=len(whole))
                held += np.bincount(key[own > 1], minlength=len(held))
                row = {"block": [home], "first": [uid[0]], "texts": [packed((uid - uid[0]).astype(np.uint32))], "flags": [packed(flag)]}
                row |= {k: [packed(np.zeros(len(uid), np.uint32))] for k in ("sizes", "rare_sizes", "after_sizes")}
                yield from blobs(row | {"top_sizes": [packed(np.bincount(text[top], minlength=len(uid)).astype(np.uint32))], "top": [packed(key.astype(np.uint32))]})
            rest = ~top
            context, word, text, often = context[rest], word[rest], text[rest], often[rest]
            after = often & (context >= RARE)
            key = np.where(often, np.where(after, context, bigram_key(context, word, m.bits)), word)
            block = mixed(key) % np.uint64(n_blocks)
            order = np.argsort(block, kind="stable")
            context, word, key, text, often, after, block = (x[order] for x in (context, word, key, text, often, after, block))
            starts = np.searchsorted(block, np.arange(n_blocks + 1, dtype=np.uint64))
            out = []
            for b in range(n_blocks):
                part = slice(starts[b], starts[b + 1])
                if part.start < part.stop:
                    x, k = text[part], key[part]
                    r, a = ~often[part], after[part]
                    f = ~(r | a)
                    own, at = np.unique(x, return_inverse=True)
                    sizes = lambda y: packed(np.bincount(at[y], minlength=len(own)).astype(np.uint32))
                    texts = packed((uid[own] - uid[0]).astype(np.uint32)), packed(flag[own])
                    rare = sizes(r), packed(k[r]), packed(context[part][r])
                    out.append((b, uid[0], *texts, sizes(f), packed(k[f]), *rare, sizes(a), packed(k[a]), packed(word[part][a].astype(np.uint32)), packed(np.zeros(len(own), np.uint32))))
            if out:
                yield from blobs(dict(zip(("block", "first", *PACKED[:11]), map(list, zip(*out)))))
        if (at := np.flatnonzero(whole)).size:
            yield from blobs({"block": [home], "top_keys": [packed(at)], "top_n": [packed(whole[at])], "top_held": [packed(held[at])]})

    return run


class Block:
    """The tokens of a block: its texts and their flags; contexts, words and numbers of the text of each kind of tokens. Keeps
    nothing of the rows it is made of."""

    def __init__(self, rows: list):
        texts = [r for r in rows if r["texts"]]
        get = lambda name, kind: unpacked([r[name] for r in texts], kind)
        self.uid = np.concatenate([r["first"] + unpacked([r["texts"]], np.uint32).astype(np.int64) for r in texts]) if texts else np.empty(0, np.int64)
        self.flag = get("flags", np.uint8)
        number = lambda name: np.repeat(np.arange(len(self.uid), dtype=np.int32), get(name, np.uint32))
        self.key, self.text = get("pairs", np.uint64), number("sizes")
        self.rare, self.before, self.rare_text = get("rare", np.uint64), get("contexts", np.uint64), number("rare_sizes")
        self.after, self.word, self.after_text = get("after", np.uint64), get("words", np.uint32), number("after_sizes")
        self.top, self.top_text = get("top", np.uint32), number("top_sizes")
        self.top_sums = [unpacked([r[c] for r in rows], np.int64) for c in ("top_keys", "top_n", "top_held")]
        #: The rare words of the block, which of them each rare word is, how often they stand in training documents, in those held out
        self.names, at = np.unique(self.rare, return_inverse=True)
        self.at = at.astype(np.int32)
        flag = self.flag[self.rare_text]
        self.seen = np.bincount(self.at[flag > 0], minlength=len(self.names))
        self.held = np.bincount(self.at[flag > 1], minlength=len(self.names))


def _by_block(work):
    """Work on the block of a partition."""
    return lambda rows: (out for block, own in groupby(rows, lambda r: r["block"]) for out in work(block, own))


def _events(model, n_blocks: int):
    """Of a block: its held-out bigrams, with the counts of their words and contexts that are not held out; rare words after
    rare words for the blocks of their contexts; the counts of rare words; sums of pairs of top words."""

    def run(block: int, rows: Iterator) -> Iterator[tuple]:
        m: Model = model.value
        b = Block([r for r in rows if r["uid"] is None])
        kept_words, kept_contexts, kept = m.counts - m.held_counts, m.contexts - m.held_contexts, b.seen - b.held
        ready = []
        first, n, held = _held_out(b.key, b.flag[b.text])
        key = b.key[first]
        ready.append((kept_contexts[(key >> np.uint64(m.bits + 1)).astype(np.int64)], n, kept_words[(key & np.uint64((1 << m.bits + 1) - 1)).astype(np.int64)], held))
        first, n, held = _held_out(bigram_key(b.before, b.rare, m.bits), b.flag[b.rare_text])
        context, word = b.before[first], kept[b.at[first]]
        near = context < RARE
        ready.append((kept_contexts[context[near].astype(np.int64)], n[near], word[near], held[near]))
        first, far_n, far_held = _held_out(bigram_key(b.after, b.word.astype(np.uint64), m.bits), b.flag[b.after_text])
        ready.append((kept[np.searchsorted(b.names, b.after[first])], far_n, kept_words[b.word[first]], far_held))
        seen, *rest = (packed(np.concatenate(x).astype(np.int64)) for x in zip(*ready))
        none = b""
        yield block, seen, none, *rest, packed(b.names), packed(kept), none, none, none
        context, n, word, held = context[~near], n[~near], word[~near], held[~near]
        to = mixed(context) % np.uint64(n_blocks)
        for x in np.unique(to).tolist():
            part = to == x
            yield x, none, packed(context[part]), packed(n[part]), packed(word[part]), packed(held[part]), none, none, none, none, none
        keys, at = np.unique(b.top_sums[0], return_inverse=True)
        if len(keys):
            sums = (np.bincount(at, x).astype(np.int64) for x in b.top_sums[1:])
            yield block, *[none] * 7, packed(keys), *map(packed, sums)

    return run


def _estimates(model):
    """Of a block of contexts: the held-out bigrams with their estimates, and sums of pairs of top words."""

    def run(rows: pa.Table) -> pa.Table:
        m: Model = model.value
        get = lambda part, name, kind=np.int64: unpacked(cells(part[name]), kind)
        far = pc.greater(pc.binary_length(rows["contexts"]), 0)
        near, far = rows.filter(pc.invert(far)), rows.filter(far)
        names, kept = get(near, "names", np.uint64), get(near, "kept")
        seen = kept[np.searchsorted(names, get(far, "contexts", np.uint64))] if len(names) else np.empty(0, np.int64)
        columns = [np.concatenate([x, y]) for x, y in ((get(near, "seen"), seen), *((get(near, c), get(far, c)) for c in ("n", "words", "held")))]
        types = [("bucket", pa.int64()), *((c, pa.float64()) for c in ("one", "two", "three", "n")), *((c, pa.int64()) for c in ("top", "whole", "held"))]
        events = _rows({k: pa.array(v) for k, v in _event_columns(m, *columns).items()}, types)
        top = _rows({k: pa.array(get(near, c)) for k, c in (("top", "top_keys"), ("whole", "top_n"), ("held", "top_held"))}, types)
        return _in_batches(pa.concat_tables([events, top]))

    return run


def _held_out(keys: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the bigrams that are held out: where one stands, how often it stands in other training documents and in those held out."""
    _, first, at = np.unique(keys, return_index=True, return_inverse=True)
    n, held = (np.bincount(at[flag > x], minlength=len(first)) for x in (0, 1))
    pick = held > 0
    return first[pick], (n - held)[pick], held[pick]


def _score(model, n_blocks: int):
    """Of a block: its documents as they are, of each text the sums over its tokens in the block, the counts of rare words,
    and rare words after rare words, with the counts of both, for the blocks of their contexts."""
    none = (None,) * (1 + len(KNOWN))

    def run(block: int, rows: Iterator) -> Iterator[tuple]:
        m: Model = model.value
        own = []
        for r in rows:
            if r["uid"] is None:
                own.append(r)
            else:
                yield block, r["id"], *[r[k] for k in KNOWN], *[None] * len(PASSED)
        b = Block(own)
        del own
        total = lambda text, x: np.bincount(text, x, len(b.uid))
        score, trained = np.zeros(len(b.uid)), b.flag > 0
        if len(b.key):
            n = _trained(b.key, trained[b.text])
            word, context = (b.key & np.uint64((1 << m.bits + 1) - 1)).astype(np.int64), (b.key >> np.uint64(m.bits + 1)).astype(np.int64)
            score = score + total(b.text, np.log10(m.chance(context, n, m.counts[word])))
            del word, context, n
            b.key = b.text = None
        if size := len(m.pairs):
            context, word = b.top // size, b.top % size
            score = score + total(b.top_text, np.log10(m.chance(context, m.pairs[context, word], m.counts[word])))
            del context, word
            b.top = b.top_text = None
        word = b.seen[b.at]
        known, base = total(b.rare_text, word > 0), total(b.rare_text, m.base(word))
        if len(b.rare):
            n, far = _trained(bigram_key(b.before, b.rare, m.bits), trained[b.rare_text]), b.before >= RARE
            near = ~far
            score = score + total(b.rare_text[near], np.log10(m.chance(b.before[near].astype(np.int64), n[near], word[near])))
            for x in _packed(b.uid, b.rare_text[far], b.before[far], n[far], word[far], n_blocks):
                yield x[0], *none, *x[1:]
            del n, far, near, word
            b.rare = b.before = b.rare_text = b.at = None
        if len(b.after):  # every rare context is a word of this block
            n = _trained(bigram_key(b.after, b.word.astype(np.uint64), m.bits), trained[b.after_text])
            score = score + total(b.after_text, np.log10(m.chance(np.searchsorted(b.names, b.after), n, m.counts[b.word], b.seen)))
        texts, at = np.unique(b.uid, return_inverse=True)
        sums = [np.bincount(at, x, len(texts)) for x in (known, base, score)]
        yield block, *none, *[b""] * 5, packed(b.names), packed(b.seen), packed(texts), packed(sums[0].astype(np.int64)), *(x.tobytes() for x in sums[1:])

    return run


def _trained(keys: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Of each key how often it stands in training documents."""
    _, at = np.unique(keys, return_inverse=True)
    return np.bincount(at, train)[at].astype(np.int64) if len(keys) else np.empty(0, np.int64)


def _in_batches(table: pa.Table) -> pa.Table:
    """The table in batches as Spark sends them, which are what the JVM holds of it at once."""
    return pa.Table.from_batches(table.to_batches(max_chunksize=BATCH), table.schema)


def _packed(uid, text, context, n, word, n_blocks: int) -> Iterator[tuple]:
    """Tokens after rare contexts, packed for the blocks of these."""
    block = mixed(context) % np.uint64(n_blocks)
    order = np.lexsort((text, block))
    text, context, n, word, block = (x[order] for x in (text, context, n, word, block))
    starts = np.searchsorted(block, np.arange(n_blocks + 1, dtype=np.uint64))
    for b in range(n_blocks):
        part = slice(starts[b], starts[b + 1])
        if part.start < part.stop:
            own, sizes = np.unique(text[part], return_counts=True)
            yield b, packed(uid[own]), packed(sizes.astype(np.uint32)), packed(context[part]), packed(n[part].astype(np.uint32)), packed(word[part].astype(np.uint32)), *[b""] * 6


def _score_rare(model, kind: pa.DataType):
    """Of a block of contexts: its documents as they are, and of each text the sums so far and those over its rare words
    after rare words."""
    schema = _layout(kind, ())[1:]

    def run(rows: pa.Table) -> pa.Table:
        m: Model = model.value
        here = rows["uid"].is_valid()
        docs = rows.filter(here)
        docs = _rows({k: docs[k] for k, _ in schema}, schema)
        rows = rows.filter(pc.invert(here))
        if not len(rows):
            return docs
        get = lambda name, kind: unpacked(cells(rows[name]), kind)
        plainly = lambda name: np.frombuffer(b"".join(x or b"" for x in cells(rows[name])))
        names, seen, uid = get("names", np.uint64), get("seen", np.int64), get("texts", np.int64)
        text = np.repeat(np.arange(len(uid)), get("sizes", np.uint32))
        score = np.zeros(len(uid))
        if len(text):
            chance = m.chance(np.searchsorted(names, get("after", np.uint64)), get("n", np.uint32), get("counts", np.uint32), seen)
            score = np.bincount(text, np.log10(chance), len(uid))
        own, at = np.unique(np.concatenate([get("sum_texts", np.int64), uid]), return_inverse=True)
        total = lambda x, more: np.bincount(at, np.concatenate([x, more]), len(own))
        none = np.zeros(len(uid))
        sums = {"uid": own, "n_known": total(get("sum_known", np.int64), none).astype(np.int64), "base_score": total(plainly("sum_base"), none), "score": total(plainly("sum_score"), score)}
        return _in_batches(pa.concat_tables([docs, _rows({k: pa.array(v) for k, v in sums.items()}, schema)]))

    return run


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, paired: int = PAIRED) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams), score.

    bits: 19 at most, as two places share 40 bits; if given, rarer words make one context together."""
    rows = docs.select(plain(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("raw"), F.coalesce(training, F.lit(True)).alias("train"))
    model, blocks, n_blocks = _learn(rows.select("id", "raw", flagged(rows, F.col("train")).alias("flag")), bits, paired)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()
    arrow_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    layout = f"block int, {_known(kind)}, {_binary(PASSED)}"
    passed = docs.sparkSession.createDataFrame(blocks.mapPartitions(_by_block(_score(shared, n_blocks))), layout, verifySchema=False)
    parts = passed.groupBy("block").applyInArrow(_score_rare(shared, arrow_kind), _known(kind))
    sums = parts.groupBy("uid").agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
