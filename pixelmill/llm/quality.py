"""Weakly supervised quality classification.

Heuristic labellers vote on each text or abstain.  Expectation maximisation over the counts of
vote patterns (at most ``2 ** len(LABELLERS)`` rows, counted over all documents) estimates how
often each labeller fires on poor and on good texts, and so the probability that a pattern is
good.  These posterior labels of a bounded sample of documents (``SAMPLE_ROWS`` with the
smallest hash of their id) train a linear scorer over hashed words and word shapes, which then
scores every document.  A training row holds the distinct cells of its whole text with their
counts, at most ``2 ** BITS``.  Training runs jobs while the query is being built.

Cases: a null or empty text gets no votes and no features, so its score is the intercept's, and
it is kept if the labellers' model finds voteless texts good; repeated rows are each counted,
within the bound on training rows; rows without an id are counted and scored but not trained
on; an empty table gives an empty result; texts of any length are read whole; further columns
pass through whatever their names, but for the three results, which replace columns of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm.textkern import IS_SPACE, blocks, mix, segments, word_hashes
from pixelmill.session import free_names, from_row, row_of

BITS = 16
SAMPLE_ROWS = 8_000
EPOCHS = 6
KEEP = 0.5
#: Labellers in the order of their bits in a pattern; the last two vote good, the others poor.
LABELLERS = ["upper_case", "exclamation", "symbol_share", "symbol_words", "pipes", "word_repeats", "few_distinct", "pair_repeats", "sentences", "plain_words"]
_POOR = 8

_UPPER, _LETTER, _SYMBOL = (np.zeros(256, np.bool_) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_SYMBOL[[ord(c) for c in "#$%&*@^~=+<>|{}_\\"]] = True
_KIND = np.zeros(256, np.uint8)  # of a word's bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 stop, 5 symbol, 6 exclamation, 7 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[44, 46, 58, 59, 63]], _KIND[33], _KIND[0x80:] = 1, 2, 3, 4, 6, 7
_KIND[_SYMBOL] = 5


def _per_doc(flags: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return (total[edge[1:]] - total[edge[:-1]]).astype(np.float64)


def votes_and_features(texts: list[bytes], bits: int = BITS, features: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Vote patterns of the texts, and per text the cells of its words and word shapes, with repeats."""
    raw = b" ".join(texts) + b" "
    buf = np.frombuffer(raw, np.uint8)
    edge = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    at, h = word_hashes(buf)
    ends = np.concatenate([np.flatnonzero(~IS_SPACE[buf[a:b]][:-1] & IS_SPACE[buf[a + 1 : b]]) + a + 1 for a, b in segments(buf)]) if len(at) else at
    bounds = np.searchsorted(at, edge)
    n = np.diff(bounds).astype(np.float64)
    some = np.maximum(n, 1.0)
    letters = np.maximum(_per_doc(_LETTER[buf], edge), 1.0)
    chars = np.maximum(_per_doc(~IS_SPACE[buf], edge), 1.0)
    last = buf[ends - 1] if len(at) else buf[:0]
    first_of = np.zeros(len(h), np.bool_)
    first_of[bounds[:-1][bounds[:-1] < len(h)]] = True
    again = np.zeros(len(h), np.bool_)
    again[1:] = (h[1:] == h[:-1]) & ~first_of[1:]
    pair = mix(h[1:] * np.uint64(3) + h[:-1]) if len(h) > 1 else h[:0]
    distinct = np.array([len(set(h[a:b].tolist())) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], np.float64)
    pairs = np.array([len(set(pair[a : max(a, b - 1)].tolist())) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], np.float64)
    upper = _per_doc(_UPPER[buf], edge) / letters
    symbols = _per_doc(_SYMBOL[buf], edge) / chars
    by_word = lambda flags: _per_doc(flags, bounds) / some
    repeats = by_word(again)
    stops = by_word(_KIND[last] == 4)
    vote = [
        upper > 0.4,
        by_word(last == 33) > 0.15,
        symbols > 0.05,
        by_word(_SYMBOL[last]) > 0.2,
        by_word(last == ord("|")) > 0.1,
        repeats > 0.2,
        (distinct / some < 0.4 * np.minimum(1.0, np.sqrt(400.0 / some))) & (n >= 8),
        (pairs / np.maximum(n - 1, 1.0) < 0.5) & (n >= 8),
        (stops > 0.02) & (stops < 0.5) & (upper < 0.3),
        (letters / some > 2.5) & (letters / some < 14) & (symbols < 0.03) & (repeats < 0.05) & (n > 0),
    ]
    pattern = sum(v.astype(np.int64) << i for i, v in enumerate(vote))
    if not features or not len(h):
        return pattern, [np.empty(0, np.int32)] * len(texts)
    size = np.minimum((ends - at) >> 1, 7).astype(np.uint64)
    second = _KIND[buf[np.minimum(at + 1, len(buf) - 1)]].astype(np.uint64)
    shape = ((((_KIND[buf[at]].astype(np.uint64) * np.uint64(8) + second) * np.uint64(8) + _KIND[last]) * np.uint64(8) + size) * np.uint64(2) + again) + np.uint64(1)
    two = shape.copy()
    two[1:] += shape[:-1] << np.uint64(20)
    shift = np.uint64(64 - bits)
    cells = np.stack([mix(shape) >> shift, mix(two) >> shift, h >> shift], 1).astype(np.int32)
    return pattern, [cells[a:b].ravel() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def fit_label_model(counts: dict[int, int], rounds: int = 60) -> np.ndarray:
    """P(good) for every pattern, by expectation maximisation from firing rates that favour the labellers."""
    m = len(LABELLERS)
    patterns = np.arange(1 << m)
    fired = (patterns[:, None] >> np.arange(m)) & 1
    seen = np.zeros(1 << m)
    for k, c in counts.items():
        seen[k] = c
    poor = np.where(np.arange(m) < _POOR, 0.4, 0.2)
    good = np.where(np.arange(m) < _POOR, 0.02, 0.9)
    share = 0.85
    posterior = np.zeros(1 << m)
    for _ in range(rounds):
        log_good = np.log(share) + fired @ np.log(good) + (1 - fired) @ np.log1p(-good)
        log_poor = np.log1p(-share) + fired @ np.log(poor) + (1 - fired) @ np.log1p(-poor)
        posterior = 1.0 / (1.0 + np.exp(np.clip(log_poor - log_good, -500, 500)))
        if not seen.sum():
            break
        a, b = seen * posterior, seen * (1 - posterior)
        good = np.clip((a @ fired + 1) / (a.sum() + 2), 1e-4, 1 - 1e-4)
        poor = np.clip((b @ fired + 1) / (b.sum() + 2), 1e-4, 1 - 1e-4)
        share = float(np.clip((a.sum() + 1) / (seen.sum() + 2), 0.02, 0.98))
    return posterior


def _fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, epochs: int) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic model on cell frequencies, by AdaGrad; rows: cells, counts, label."""
    w, g2 = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-6)
    rng = np.random.default_rng(3)
    data = []
    for found, n, y in rows:
        data.append((np.append(found, 1 << bits).astype(np.int32), np.append(np.sqrt(3.0 * n / max(1, int(n.sum()))), 1.0), y))
    for _ in range(epochs):
        for i in rng.permutation(len(data)).tolist():
            cells, x, y = data[i]
            p = 1.0 / (1.0 + np.exp(-np.clip(w[cells] @ x, -50, 50)))
            g = (p - y) * x + 1e-5 * w[cells]
            g2[cells] += g * g
            w[cells] -= 0.2 * g / np.sqrt(g2[cells])
    return w.astype(np.float32)


def _score(cells: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    out = np.empty(len(cells))
    for i, c in enumerate(cells):
        s = float(w[-1])
        if len(c):
            n = np.bincount(c)
            found = np.flatnonzero(n)
            s += float(w[found] @ np.sqrt(3.0 * n[found] / len(c)))
        out[i] = s
    return 1.0 / (1.0 + np.exp(-np.clip(out, -700, 700)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """The label model's posteriors by pattern and the scorer's weights."""
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << len(LABELLERS), np.int64)
        for batch in it:
            for _, texts in blocks(batch):
                seen += np.bincount(votes_and_features(texts, bits, False)[0], minlength=len(seen))
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[k])], ["pattern", "n"])

    counted = source.select("text").mapInArrow(count, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    posterior = fit_label_model({r["pattern"]: r["n"] for r in counted})

    chosen = source.select("_id").where("_id is not null").distinct().withColumn("rank", F.xxhash64("_id")).orderBy("rank").limit(rows)
    picked = source.join(F.broadcast(chosen), "_id").select("rank", "text")

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, texts in blocks(batch):
                pattern, found = votes_and_features(texts, bits)
                held = [np.unique(c, return_counts=True) for c in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(posterior[pattern]), pa.array([c.astype("<u4").tobytes() for c, _ in held], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in held], pa.binary())],
                    ["rank", "y", "cells", "counts"],
                )

    def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sorted(row for b in it for row in zip(*(b.column(i).to_pylist() for i in range(4))))
        w = _fit_scorer([(np.frombuffer(c, "<u4"), np.frombuffer(n, "<u4"), y) for _, y, c, n in data], bits, epochs) if data else np.zeros((1 << bits) + 1, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    # rows of repeated ids count towards the bound
    sample = picked.mapInArrow(cells, "rank bigint, y double, cells binary, counts binary").orderBy("rank", "y", "cells", "counts").limit(rows)
    model = sample.mapInArrow(fit, "w binary").collect()
    return posterior, np.frombuffer(model[0]["w"], np.float32) if model else np.zeros((1 << bits) + 1, np.float32)


def classify(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, names: tuple[str, ...] = ("votes", "posterior", "score")) -> DataFrame:
    """``docs`` with votes (a pattern), posterior, score (both P(good)); columns of these ``names`` are replaced."""
    columns = [c for c in docs.columns if c not in names]
    source = docs.select(row_of(docs, *names).alias("row"))
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs, id_col, text_col, bits=bits))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, w = sent.value
        for batch in it:
            for at, texts in blocks(pa.RecordBatch.from_struct_array(batch.column(0)), text_col):
                pattern, cells = votes_and_features(texts, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(pattern), pa.array(posterior[pattern]), pa.array(_score(cells, w))], ["row", "votes", "posterior", "score"])

    added = [T.StructField("votes", T.LongType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())]
    scored = source.mapInArrow(run, T.StructType([*source.schema.fields, *added]))
    return scored.select(*from_row("row", columns), *[F.col(c).alias(name) for c, name in zip(("votes", "posterior", "score"), names)])


def keep_good(docs: DataFrame, threshold: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with their columns."""
    names = free_names(docs, "votes", "posterior", "score")
    return classify(docs, names=names).where(F.col(names[2]) >= threshold).drop(*names)
