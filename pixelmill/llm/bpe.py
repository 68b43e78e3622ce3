"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The merge ranks of a ``.tiktoken`` file become a byte-level BPE model: each byte stands as
one printable character, a token of two or more bytes yields a merge for every way to split
it into two known tokens, and merges are ordered by the rank of what they make.  Ids equal
those of a rank-driven encoder that treats each match of the pattern by itself.

Cases: a null text counts as empty and gives no ids and an empty decoding; an id outside
the vocabulary raises on decoding; texts of any length are encoded whole; repeated rows and
rows without an id are encoded each by itself; an empty table gives an empty result; further
columns pass through unchanged whatever their names, but for those of the results, which are
replaced.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelmill.llm.textkern import blocks
from pixelmill.llm.tokenmemo import ChunkMemo
from pixelmill.session import from_row, row_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def byte_characters() -> list[str]:
    """The printable character for each byte: Latin-1's own where it has one, else U+0100 onwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """A tokenizers.Tokenizer that follows the ranks at ``path``."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, char = read_ranks(path), byte_characters()
    show = lambda b: "".join(char[x] for x in b)
    merges = [
        (show(token[:k]), show(token[k:]))
        for token, _ in sorted(ranks.items(), key=lambda kv: kv[1])
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    model = models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    t = Tokenizer(model)
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return t


@lru_cache(maxsize=2)
def _memo(path: str, pattern: str) -> ChunkMemo:
    t = tokenizer(path, pattern)
    return ChunkMemo(lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)], fold=False)


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Every token's bytes in one array, in order of id, and their bounds; the reverse of the byte table."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    bounds = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=bounds[1:])
    return np.frombuffer(b"".join(tokens), np.uint8), bounds


def decode_ids(ids: np.ndarray, path: str) -> np.ndarray:
    """The bytes of ``ids`` in a row."""
    flat, bounds = byte_table(path)
    if not len(ids):
        return np.empty(0, np.uint8)
    if int(ids.max()) >= len(bounds) - 1:
        raise ValueError(f"id {int(ids.max())} is not in the vocabulary")
    start = bounds[ids]
    n = bounds[ids.astype(np.int64) + 1] - start
    to = np.cumsum(n)
    return flat[np.repeat(start - (to - n), n) + np.arange(int(to[-1]))]


def offsets(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of ids; a token that holds part of a character covers the whole of it."""
    _, bounds = byte_table(path)
    raw = decode_ids(ids, path)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    end = np.cumsum(bounds[ids.astype(np.int64) + 1] - bounds[ids])
    start = np.append(0, end[:-1])[: len(end)]
    return char[start].astype(np.int32), (char[end - 1] + 1).astype(np.int32)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit, one binary) and ``n_tokens``.

    ``spans`` adds ``char_start`` and ``char_end``, the tokens' places in the text.  Columns
    of the input that have these names are replaced.
    """
    names = ["ids", "n_tokens", *(["char_start", "char_end"] if spans else [])]
    columns = [c for c in docs.columns if c not in names]
    source = docs.select(row_of(docs, *names).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path, pattern)
        for batch in batches:
            for at, texts in blocks(pa.RecordBatch.from_struct_array(batch.column(0)), text_col):
                ids, bounds = memo(texts)
                parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                out = [pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()), pa.array(np.diff(bounds), pa.int64())]
                if spans:
                    found = [offsets(p, path) if len(p) else (p, p) for p in parts]
                    out += [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *out], ["row", *names])

    added = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    added += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in names[2:]]
    encoded = source.mapInArrow(run, T.StructType([*source.schema.fields, *added]))
    return encoded.select(*from_row("row", columns), *names)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", size: int = 1 << 22) -> DataFrame:
    """``tokens`` with ``decoded`` (the exact bytes) and ``decoded_text`` (UTF-8, U+FFFD where characters are cut)."""
    names = ["decoded", "decoded_text"]
    columns = [c for c in tokens.columns if c not in names]
    source = tokens.select(row_of(tokens, *names).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.RecordBatch.from_struct_array(batch.column(0)).column(columns.index(ids_col))
            length = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
            edge, at = np.cumsum(length), 0
            while at < len(length):
                done = int(edge[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(edge, done + size, "right")))
                raw = [decode_ids(np.frombuffer(x or b"", "<u4"), path).tobytes() for x in column.slice(at, to - at).to_pylist()]
                text = pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(raw, pa.binary()), text], ["row", *names])
                at = to

    added = [T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())]
    return source.mapInArrow(run, T.StructType([*source.schema.fields, *added])).select(*from_row("row", columns), *names)
