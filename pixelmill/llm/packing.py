"""Packing by power-of-two decomposition.

A document's ids (with an end id) are cut into pieces whose lengths are powers of two: as
many of ``max_len`` as fit, then the binary digits of the rest, longest first.  Every piece is
a sequence by itself, so no sequence crosses documents and none is padded; sequences of
equal length share a bucket and are batched together.

Cases: a null or empty text has the end id alone, one piece of length 1; a text longer than
``max_len`` gives several full pieces; repeated rows and rows without an id are packed each by
itself; an empty table gives no pieces; further columns are ignored whatever their names.
sequence_id is unique per row of the result, not consecutive.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.textkern import blocks
from pixelmill.llm.tokenmemo import ChunkMemo

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
MAX_LEN = 2048
END_ID = 1


@lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Ids of texts in a row and the bounds of each text in them, as the library's call without special tokens around gives them."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    library = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    memo = ChunkMemo(library, fold=True)
    added = [x.content.encode() for x in t.get_added_tokens_decoder().values()]

    def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, text in enumerate(texts) if any(x in text for x in added)]  # an added token is one id, which chunks would cut
        if not whole:
            return memo(texts)
        held = set(whole)
        flat, bounds = memo([b"" if i in held else text for i, text in enumerate(texts)])
        parts = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i, ids in zip(whole, library([texts[i].decode("utf-8", "replace") for i in whole])):
            parts[i] = np.array(ids, np.uint32)
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))

    return encode


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of ``n`` ids; ``max_len`` is a power of two."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


_OUT = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, bucket int, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, bucket (log2 of the length), ids (little-endian u32), sequence_id, offset."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for at, texts in blocks(batch):
                flat, bounds = encode(texts)
                raw = flat.astype("<u4").tobytes()
                doc, start, length, total, ids = [], [], [], [], []
                for i, a, b in zip(ids_of[at : at + len(texts)], bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = raw[4 * a : 4 * b] + end_id.to_bytes(4, "little")
                    n, done = b - a + 1, 0
                    for k in piece_lengths(n, max_len):
                        doc.append(i)
                        start.append(done)
                        length.append(k)
                        total.append(n)
                        ids.append(own[4 * done : 4 * (done + k)])
                        done += k
                size = np.array(length, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size), pa.array(total, pa.int64()), pa.array(np.log2(size).astype(np.int32)), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "bucket", "ids"],
                )

    return source.mapInArrow(run, _OUT).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def equal_length_batches(pieces: DataFrame, batch_tokens: int = 1 << 16) -> DataFrame:
    """Batches of sequences of one length: bucket, sequence_ids, ids (rows of the batch one after another).

    Batches are filled inside each partition, so nothing is shuffled; the last batch of a
    bucket in a partition may be smaller.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}

        def row(bucket: int, part: tuple[list[int], list[bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([part[0]], pa.list_(pa.int64())), pa.array([b"".join(part[1])], pa.binary())], ["bucket", "sequence_ids", "ids"]
            )

        for batch in it:
            for bucket, seq, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = held.setdefault(bucket, ([], []))
                part[0].append(seq)
                part[1].append(ids)
                if len(part[0]) << bucket >= batch_tokens:
                    yield row(bucket, held.pop(bucket))
        for bucket, part in held.items():
            yield row(bucket, part)

    return pieces.select("bucket", "sequence_id", "ids").mapInArrow(run, "bucket int, sequence_ids array<bigint>, ids binary")
