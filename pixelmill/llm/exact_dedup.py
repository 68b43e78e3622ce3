"""Exact deduplication by Grace hashing.

Two texts are equal when they are identical after lower-casing A-Z only; null counts as
empty.  Records meet in an open-addressing table that compares complete content.  When
a table's distinct texts outgrow the memory budget, records it does not already hold go to
spill files chosen by further hash bits, and each file is treated in the same way with the
next bits, so memory is bounded however large a bucket is.

A first table per input partition folds copies before the shuffle: of a text only one row
per partition moves, whatever its number of copies.  The rows of a text's members stay in
chunks under the key of their partition's class and meet the result by that key, which no
hot text can make large.

Cases: null and empty texts are one class; of rows with the largest doc_id of a class one
is kept (the first in its partition); a null doc_id ranks below all others; an empty table
gives an empty result; further columns of the input are ignored.  ``kept_documents`` returns
rows with all their columns; of rows whose id others have too, those equal in text fold first.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.textkern import blocks
from pixelmill.session import from_row, read_together, row_of, stage_table

BUDGET = 64 << 20  # bytes of distinct texts and their members in one table
SPLIT = 16 << 20  # bytes of small splits that one task reads
FANOUT = 16
CHUNK = 4096  # members a row carries
_LOW = -(1 << 63)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class ContentTable:
    """Open addressing with linear probing over 64-bit hashes; equality is that of the bytes."""

    def __init__(self, budget: int = BUDGET):
        self.budget, self.bytes = budget, 0
        self.slots = np.full(1024, -1, np.int64)
        self.keys: list[int] = []
        self.texts: list[bytes] = []

    def find(self, h: int, text: bytes) -> int:
        """The entry that holds ``text``, or -1 - slot where it would go."""
        mask, slots = len(self.slots) - 1, self.slots
        at = h & mask
        while (e := slots.item(at)) >= 0:
            if self.keys[e] == h and self.texts[e] == text:
                return e
            at = (at + 1) & mask
        return -1 - at

    def full(self, text: bytes) -> bool:
        return bool(self.texts) and self.bytes + len(text) > self.budget

    def add(self, h: int, text: bytes, slot: int) -> int:
        self.slots[slot] = e = len(self.texts)
        self.keys.append(h)
        self.texts.append(text)
        self.bytes += len(text) + 120
        if 3 * len(self.texts) > 2 * len(self.slots):
            mask = 2 * len(self.slots) - 1
            self.slots = np.full(mask + 1, -1, np.int64)
            for i, k in enumerate(self.keys):
                at = k & mask
                while self.slots.item(at) >= 0:
                    at = (at + 1) & mask
                self.slots[at] = i
        return e


def grace(records: Iterator[tuple[int, bytes, object]], budget: int = BUDGET, level: int = 0, group: Callable[[], Any] = list) -> Iterator[tuple[int, bytes, Any]]:
    """``(hash, text, payloads)`` for each distinct text among ``(hash, text, payload)`` records; ``group`` makes what holds payloads."""
    table, groups = ContentTable(budget), []
    spill: list = [None] * FANOUT
    try:
        for h, text, load in records:
            e = table.find(h, text)
            if e < 0 and not table.full(text):
                e = table.add(h, text, -1 - e)
                groups.append(group())
            if e >= 0:
                groups[e].append(load)
                table.bytes += 16
                continue
            k = (h >> (60 - 4 * (level % 16))) & (FANOUT - 1)
            if spill[k] is None:
                spill[k] = tempfile.TemporaryFile()  # scratch of this task, without a name; gone when closed
            pickle.dump((h, text, load), spill[k], 5)
        for e, members in enumerate(groups):
            yield table.keys[e], table.texts[e], members
        del table, groups
        for f in spill:
            if f is not None:
                f.seek(0)
                yield from grace(_replay(f), budget, level + 1, group)
                f.close()
    finally:
        for f in spill:
            if f is not None:
                f.close()


def _replay(f) -> Iterator[tuple[int, bytes, object]]:
    load = pickle.Unpickler(f)
    while True:
        try:
            yield load.load()
        except EOFError:
            return
        load.memo.clear()


_LOCAL = pa.schema([("h", pa.int64()), ("class_id", pa.int64()), ("text", pa.binary()), ("best", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64())), ("best_at", pa.int32()), ("sha", pa.string())])
_LOCAL_DDL = "h bigint, class_id bigint, text binary, best bigint, n bigint, members array<bigint>, best_at int, sha string"


def _fold(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """One row per distinct text of the partition, with its members; long member lists go on in further rows."""

    def records():
        for b in batches:
            ids = b.column(0).fill_null(_LOW).to_pylist()
            for at, texts in blocks(b):
                for i, t in zip(ids[at : at + len(texts)], texts):
                    t = t.lower()
                    yield xxhash.xxh3_64_intdigest(t), t, i

    base = TaskContext.get().partitionId() << 40
    rows, size = [], 0
    for seq, (h, text, ids) in enumerate(grace(records(), budget, group=lambda: array("q"))):
        best = max(ids)
        at = ids.index(best)
        for k in range(0, len(ids), CHUNK):
            members = ids[k : k + CHUNK]
            rows.append({
                "h": h - (1 << 64) if h >> 63 else h, "class_id": base + seq, "text": None if k else text, "best": best, "n": len(ids),
                "members": members.tolist(), "best_at": at - k if k <= at < k + CHUNK else -1, "sha": None if k else hashlib.sha256(text).hexdigest(),
            })
            size += (0 if k else len(text)) + 40 * len(members) + 400
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, _LOCAL)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _LOCAL)


_MERGED = pa.schema([("class_id", pa.int64()), ("keep_id", pa.int64()), ("keep_class", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def _merge(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """What each partition's classes of one text have in common."""

    def records():
        for b in batches:
            h, text, rest = b.column(0).to_pylist(), b.column(1).to_pylist(), zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)))
            for x in zip(h, text, rest):
                yield x[0] & (1 << 64) - 1, x[1], x[2]

    rows = []
    for _, _, found in grace(records(), budget):
        best, keep = max((b, -c) for c, b, _, _ in found)
        total = sum(n for _, _, n, _ in found)
        rows += [{"class_id": c, "keep_id": None if best == _LOW else best, "keep_class": -keep, "group_size": total, "text_sha256": sha} for c, _, _, sha in found]
        if len(rows) > 20_000:
            yield pa.RecordBatch.from_pylist(rows, _MERGED)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _MERGED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (see the module's text)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = read_together(source, SPLIT)  # more copies fold before the shuffle
    local = stage_table(source.mapInArrow(lambda it: _fold(it, budget), _LOCAL_DDL), "grace-local")
    classes = (
        local.where("text is not null")
        .select("h", "text", "class_id", "best", "n", "sha")
        .repartition("h")
        .mapInArrow(lambda it: _merge(it, budget), "class_id bigint, keep_id bigint, keep_class bigint, group_size bigint, text_sha256 string")
    )
    members = local.select("class_id", F.posexplode("members").alias("at", "doc_id"), "best_at").withColumn("doc_id", F.nullif("doc_id", F.lit(_LOW)))
    return members.join(classes, "class_id").select(
        "doc_id", "keep_id", "group_size", ((F.col("class_id") == F.col("keep_class")) & (F.col("at") == F.col("best_at"))).alias("kept"), "text_sha256"
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    A row is found again by its id and its text's SHA-256; of rows that share both one stays.
    """
    keep = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("found"), "text_sha256")
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    held = docs.select(row_of(docs).alias("row"), F.col(id_col).cast("long").alias("key"), F.sha2(text, 256).alias("sha"))
    same = held.join(keep, F.col("key").eqNullSafe(F.col("found")) & (F.col("sha") == F.col("text_sha256")))
    return same.groupBy("sha").agg(F.first("row").alias("row")).select(*from_row("row", docs.columns))
