"""Toxicity scoring: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs around one word, hashed into
``2 ** BITS`` cells.  Training reads a sample of at most ``SAMPLE_ROWS`` labelled rows, those
with the smallest hash of their id, ``EPOCHS`` times in one task; per-coordinate learning rates
and the L1 term leave most cells at zero, so the model is a short list of weights.  Its size is
bounded by the number of cells whatever the corpus, and only that list goes to the executors.
Training runs a job while the query is being built.

Cases: a null or empty text has no features and gets the intercept's score; null labels and
labels without an id are not learned from, nor is a null id held out; equal labels of one id
count once, the rows of a repeated id each, within the bound on rows; without any labelled row
every score is 0; an empty table gives an empty result; texts of any length are scored whole;
further columns pass through whatever their names, but for the score's, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm.textkern import blocks, doc_words, mix
from pixelmill.session import free_names, from_row, row_of

BITS = 20
SAMPLE_ROWS = 12_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
EPOCHS = 10
THRESHOLD = 0.7
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(texts: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """Distinct cells of each text's words, pairs of neighbours and pairs around one word."""
    h, bounds = doc_words(texts)
    shift = np.uint64(64 - bits)
    one = (h >> shift).astype(np.int32)
    two = (mix(h[:-1] * _PAIR + h[1:]) >> shift).astype(np.int32) if len(h) > 1 else one[:0]
    gap = (mix(h[:-2] * _SKIP + h[2:]) >> shift).astype(np.int32) if len(h) > 2 else one[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        cells = np.sort(np.concatenate([one[a:b], two[a : max(a, b - 1)], gap[a : max(a, b - 2)]]))
        keep = np.ones(len(cells), np.bool_)
        np.not_equal(cells[1:], cells[:-1], out=keep[1:])
        out.append(cells[keep])
    return out


class Ftrl:
    """FTRL-proximal: z and n per coordinate; a weight is zero while ``|z|`` stays within L1.

    Features are present or absent; what long texts have many of is chance, and L1 removes that.
    """

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.z0 = self.n0 = 0.0

    @staticmethod
    def _weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, cells: np.ndarray, label: int) -> None:
        z, n = self.z[cells], self.n[cells]
        w, w0 = self._weight(z, n, L1), float(self._weight(self.z0, self.n0, 0.0))
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + w0, -50, 50))) - label
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[cells] = z + g - sigma * w
        self.n[cells] = n + g * g
        self.z0 += g - (np.sqrt(self.n0 + g * g) - np.sqrt(self.n0)) / ALPHA * w0
        self.n0 += g * g

    def weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self._weight(self.z, self.n, L1)
        cells = np.flatnonzero(w)
        return cells.astype(np.int32), w[cells].astype(np.float32), float(self._weight(self.z0, self.n0, 0.0))


def learned_from(id_col: str = "doc_id") -> F.Column:
    """Rows whose label may be learned: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(rank, label, text)`` of the rows of at most ``rows`` labelled ids, those with the smallest hash.

    The chosen ids are at most ``rows`` pairs of numbers, so they are broadcast to the documents.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("label")).where("label is not null and _id is not null").distinct()
    chosen = chosen.withColumn("rank", F.xxhash64("_id")).orderBy("rank", "label").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("rank", "label", "text")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Cells, weights and intercept learned from the sample's rows that ``learned_from`` admits."""

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, texts in blocks(batch):
                found = [f.tobytes() for f in features(texts, bits)]
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], ["rank", "label", "cells"])

    def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sorted((r, y, c) for b in it for r, y, c in zip(*(b.column(i).to_pylist() for i in range(3))))
        model, rng = Ftrl(bits), np.random.default_rng(1)
        decoded = [(np.frombuffer(c, np.int32), y) for _, y, c in data]
        for _ in range(epochs):
            for i in rng.permutation(len(decoded)).tolist():
                model.learn(*decoded[i])
        at, w, w0 = model.weights()
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([w0]), pa.array([len(decoded)])], ["cells", "weights", "intercept", "n"])

    rows_of = sample(docs, labels.where(learned_from()), label_col, rows).mapInArrow(cells, "rank bigint, label int, cells binary")
    rows_of = rows_of.orderBy("rank", "label", "cells").limit(rows)  # rows of repeated ids count towards the bound
    found = rows_of.mapInArrow(fit, "cells binary, weights binary, intercept double, n bigint").collect()
    if not found or not found[0]["n"]:
        return np.empty(0, np.int32), np.empty(0, np.float32), -700.0
    return np.frombuffer(found[0]["cells"], np.int32), np.frombuffer(found[0]["weights"], np.float32), found[0]["intercept"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, the probability of label 1; a column of that name is replaced."""
    columns = [c for c in docs.columns if c != out_col]
    source = docs.select(row_of(docs, out_col).alias("row"))
    cells, weights, intercept = model
    sent = docs.sparkSession.sparkContext.broadcast((cells, weights))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.float32)
        table[sent.value[0]] = sent.value[1]
        for batch in it:
            for at, texts in blocks(pa.RecordBatch.from_struct_array(batch.column(0)), text_col):
                found = features(texts, bits)
                s = np.array([float(table[f].sum()) for f in found]) + intercept
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(1.0 / (1.0 + np.exp(-np.clip(s, -700, 700))))], ["row", "score"])

    scored = source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.select(*from_row("row", columns), F.col("score").alias(out_col))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(~learned_from(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    (name,) = free_names(docs, "toxicity")
    return score(docs, train(docs, labels), out_col=name).where(F.col(name) < threshold).drop(name)
