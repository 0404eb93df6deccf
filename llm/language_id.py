"""Language identification with string kernels.

Two texts are compared by the blended-spectrum presence kernel: how many character n-grams of one to three characters both
contain, counted once each, over the geometric mean of how many each contains. N-grams are hashed into a fixed number of
places, so a text is a row of presence bits, and kernels with many texts are one matrix product.

Learning takes a bounded sample of labelled texts. Landmarks among them, the same number for each language, give a Nyström
map of the kernel; kernel ridge regression on the mapped sample, one language against the rest, gives a weight for each
landmark and language. A text's scores are the product of its kernels with the landmarks and these weights, computed for
batches of texts. Its language is the one of the highest score; `score` is the softmax of the scores.

Defined results: a null text and one without a letter are `und` with score 0; with nothing to learn from, all are `und`; of
equal scores the first language by name wins; long texts are read whole; repeated rows each give a row; an empty table
gives no rows; other columns are ignored by `predict` and kept by `keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import filter_in_arrow, plain

#: Places of n-grams, longest n-gram, labelled texts per language at most (as expected number), landmarks per language.
PLACES, LONGEST, PER_LANGUAGE, LANDMARKS = 1 << 14, 3, 400, 24
#: Languages learnt at most, ridge, sharpness of the softmax, texts in a matrix product.
LANGUAGES, RIDGE, SHARPNESS, BATCH = 200, 1e-2, 6.0, 256
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """Places of the n-grams that a text contains, in lower case with white space as one mark between words."""
    chars = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    marked = np.zeros(PLACES, bool)
    value = np.zeros(len(chars), np.uint64)
    for n in range(1, min(LONGEST, len(chars)) + 1):
        value = value[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :] + np.uint64(n)
        spread = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        marked[(spread >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)] = True
    return marked


def normed(bits: np.ndarray) -> np.ndarray:
    """Presence rows scaled so that their inner products are the kernel."""
    rows = bits.astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, bits: np.ndarray) -> np.ndarray:
        return normed(bits) @ self.landmarks.T @ self.weights


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(presence(x.as_py())).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["lang", "bits"])


def learn(docs: DataFrame, training: Column, id_col: str, text_col: str, lang_col: str) -> Model:
    """Of each language about PER_LANGUAGE texts of the training rows, drawn by a hash of id and text; each comes to the
    driver as a row of PLACES bits, so what is gathered is bounded."""
    rows = docs.where(F.coalesce(training, F.lit(True)) & plain(text_col).isNotNull() & plain(lang_col).isNotNull())
    rows = rows.select(plain(lang_col).alias("lang"), plain(text_col).alias("text"), plain(id_col).alias("id"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    draw = F.pmod(F.xxhash64("id", "lang", F.lit("sample")), F.lit(1 << 30))
    chosen = rows.join(F.broadcast(counts), "lang").where(draw * F.col("n") < PER_LANGUAGE * (1 << 30))
    found = chosen.select("lang", "text").mapInArrow(_sampled, "lang string, bits binary").toArrow()
    if not found.num_rows:
        return Model([], np.zeros((0, PLACES), np.float32), np.zeros((0, 0), np.float32))
    table = sorted(zip(found["bits"].to_pylist(), found["lang"].to_pylist()))
    names = np.array([x[1] for x in table])
    rows = normed(np.unpackbits(np.frombuffer(b"".join(x[0] for x in table), np.uint8).reshape(len(table), -1), axis=1))
    languages = sorted(set(names.tolist()))
    picks = np.concatenate([np.flatnonzero(names == x)[np.linspace(0, (names == x).sum() - 1, min(LANDMARKS, (names == x).sum())).astype(int)] for x in languages])
    marks = rows[picks]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    mapped = (rows @ marks.T).astype(np.float64) @ root
    target = np.where(names[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = np.sqrt(1 / np.array([(names == x).sum() for x in names]))[:, None]  # each language counts alike
    a, b = mapped * weight, target * weight
    solved = np.linalg.solve(a.T @ a + RIDGE * np.eye(a.shape[1]), a.T @ b)
    return Model(languages, marks, (root @ solved).astype(np.float32))


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    read = [i for i, x in enumerate(texts) if model.languages and x is not None and has_letter(x)]
    for start in range(0, len(read), BATCH):
        part = read[start : start + BATCH]
        raw = model.scores(np.stack([presence(texts[i]) for i in part])) * SHARPNESS
        odds = np.exp(raw - raw.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        for i, k, row in zip(part, odds.argmax(axis=1), odds):
            names[i], scores[i] = model.languages[k], float(row[k])
    return names, scores


def predict(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, training, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = classify(model.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(plain(id_col).alias(id_col), (~F.coalesce(training, F.lit(True))).alias("held_out"), plain(text_col).cast("string"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that have a language, with all their columns: those are rejected whose language is `und`."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, training, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _ = classify(model.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN for x in names], pa.bool_()))

    return filter_in_arrow(docs, run)
