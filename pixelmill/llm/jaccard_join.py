"""Exact n-gram Jaccard self join by signature trees.

A document's set is that of its distinct five-word shingles (64-bit hashes); two documents
link when 100 * intersection >= 75 * union.  The trees (see sigtree) need documents that may
be alike in one task, and no task may grow with a hot group, so the join goes in steps:

1. Shingles are dealt by hash in packed blocks, copies of one set counting once, and those that
   two sets share come back to their documents with their frequency.
2. A set can only have a partner if at least 75 % of its shingles are shared; most documents end
   here.  A partner must share one of the set's ``n - ceil(0.75 n) + 1`` rarest shingles, so sets
   that meet in such a shingle, and transitively so, form a family.  No link leaves a family.
3. A family of up to ``CHUNK`` sets and ``CELL`` bytes is one tree, joined with itself by dual traversal.  A larger
   one is dealt into chunks: each chunk's tree is joined with itself, then with a few sets of
   the first chunk's largest component, which connects what is alike almost everywhere, and at
   last the sets outside the family's largest component are joined with the tree of each other
   chunk with which they share one of their rarest shingles.  Of two sets in different
   chunks that aren't connected by then, one is outside, so no link is lost.
4. Components of the links give each document the smallest doc_id it can reach.

Intersections need only shared shingles, so nothing but those is moved for comparing.  A task
sorts ``HELD`` bytes of shingles at once, whatever the number of partitions: beyond that they go
to scratch files by further bits first.  The steps run jobs while the query is being built.

Cases: with fewer than five words the whole sequence is the one shingle; a null or empty text,
or one without words, has none, links with nothing and is its own component; rows of one
doc_id each appear in the result; a null doc_id stays null and is no component's id unless
alone; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm.sigtree import Forest, Tree, bits_for, join
from pixelmill.llm.textkern import blocks, shingle_sets
from pixelmill.operators.graph import connected_components
from pixelmill.session import from_row, row_of, slot_keys, slots, stage_table

CHUNK = 2048
LEADERS = 16
FLUSH = 1 << 20  # shingles a map task holds before it deals them out
SEEN = 1 << 20  # digests by which a map task knows sets that it has dealt
HELD = 16 << 20  # bytes of shingles a task sorts at once
CELL = 16 << 20  # bytes of shared shingles in a chunk's sets, and in the guests joined with it at once
FANOUT = 16
_NO_ID = -(1 << 63)
_PACKED = pa.schema([("slot", pa.int32()), ("ids", pa.binary()), ("digests", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
_PACKED_DDL = "slot int, ids binary, digests binary, sizes binary, counts binary, tokens binary"
_SHARED = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.int64()), ("slot", pa.int32()), ("digests", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("dfs", pa.binary())])
_SHARED_DDL = "doc_id bigint, n int, digest bigint, slot int, digests binary, sizes binary, counts binary, tokens binary, dfs binary"


def _slot_of(x: np.ndarray, n: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


#: Columns of a run of sets, one value per set (first three) or per shingle.
Run = list[np.ndarray]


def _split(run: Run, part: np.ndarray, parts: int) -> Iterator[tuple[int, Run]]:
    """``run`` dealt by the part of each shingle: (part, what falls there), a set keeping its digest and size in each."""
    digest, size, count, *each = run
    order = np.argsort(part, kind="stable")
    owner = np.repeat(np.arange(len(count), dtype=np.int32), count)[order]
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        a, b = int(cut[p]), int(cut[p + 1])
        edge = _runs(owner[a:b])
        who = owner[a:b][edge[:-1]]
        yield p, [digest[who], size[who], np.diff(edge).astype(np.uint32), *(x[order[a:b]] for x in each)]


def _bounded(runs: Iterator[Run], by_set: bool, level: int = 0) -> Iterator[Run]:
    """``runs`` as blocks of about ``HELD`` bytes; what has the same digest (``by_set``) or the same shingle is in one block.

    Beyond ``HELD`` the runs go to scratch files of this task by further bits of the digest or
    shingle, and each file is treated in the same way.  A block grows larger only if one digest
    or shingle does.
    """
    held: list[Run] = []
    files: list = []
    size = 0
    try:
        for run in runs:
            held.append(run)
            size += sum(x.nbytes for x in run)
            if size > HELD and (files or level < 8):
                files = files or [tempfile.TemporaryFile() for _ in range(FANOUT)]
                for one in held:
                    bits = one[0] if by_set else one[3]
                    part = ((bits >> np.uint64(4 * level)) & np.uint64(FANOUT - 1)).astype(np.uint8)
                    for p, own in _split(one, np.repeat(part, one[2]) if by_set else part, FANOUT):
                        pickle.dump(own, files[p], 5)
                held, size = [], HELD
        if not files:
            if held:
                yield [np.concatenate(x) for x in zip(*held)]
            return
        held = []
        for f in files:
            f.seek(0)
            yield from _bounded(_replay(f), by_set, level + 1)
            f.close()
    finally:
        for f in files:
            f.close()


def _replay(f) -> Iterator[Run]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _deal(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.RecordBatch]:
    """Packed blocks of shingles by slot, and one row per text block with every document's id, size and digest."""
    parts, here, seen = len(keys), TaskContext.get().partitionId(), set()
    sets: list[np.ndarray] = []
    held, turn = 0, here

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal sets, held
        if not sets:
            return
        length = np.array([len(s) for s in sets], np.uint32)
        token = np.concatenate(sets)
        digest = np.array([xxhash.xxh3_64_intdigest(s) for s in sets], np.uint64)
        sets = []
        rows: dict[str, list] = {n: [] for n in _PACKED.names}
        for p, run in _split([digest, length, length, token], _slot_of(token, parts).astype(np.uint16 if parts <= 1 << 16 else np.int64), parts):
            for name, value in zip(_PACKED.names, (keys[p], None, *(x.tobytes() for x in run))):
                rows[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _PACKED], schema=_PACKED)
        sets, held = [], 0

    for batch in batches:
        ids = np.asarray(batch.column(0).fill_null(_NO_ID), np.int64)
        for at, texts in blocks(batch):
            found = shingle_sets(texts)
            digest = [xxhash.xxh3_64_intdigest(s) for s in found]
            turn += 1
            row = [keys[turn % parts], ids[at : at + len(texts)].tobytes(), np.array(digest, np.uint64).tobytes(), np.array([len(s) for s in found], np.uint32).tobytes(), None, None]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PACKED)], schema=_PACKED)
            for d, s in zip(digest, found):
                if len(s) and d not in seen:
                    if len(seen) >= SEEN:  # a set may then be dealt again, which the receiver undoes
                        seen.clear()
                    seen.add(d)
                    sets.append(s)
                    held += len(s)
            if held >= FLUSH:
                yield from flush()
    yield from flush()


def _packed_runs(batches: Iterator[pa.RecordBatch], names: list[str], rest: list[pa.RecordBatch]) -> Iterator[Run]:
    """The rows that hold shingles; rows of ids are added to ``rest``, twenty bytes a document."""
    kinds = {"digests": "<u8", "sizes": "<u4", "counts": "<u4", "tokens": "<u8", "dfs": "<u4"}
    for b in batches:
        columns = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
        for i in range(b.num_rows):
            row = {n: columns[n][i].as_py() for n in names}
            if row["tokens"] is None:
                ids = np.frombuffer(columns["ids"][i].as_py(), "<i8")
                own = [pa.array(ids), pa.array(np.frombuffer(row["sizes"], "<u4").astype(np.int32)), pa.array(np.frombuffer(row["digests"], "<i8"))]
                rest.append(pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(ids), f.type) for f in list(_SHARED)[3:])], schema=_SHARED))
            else:
                yield [np.frombuffer(row[n], kinds[n]) for n in names]


def _segments(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions of the segments that begin at ``start`` and are ``count`` long, one after another."""
    to = np.cumsum(count)
    return np.repeat(start - (to - count), count) + np.arange(int(to[-1]) if len(to) else 0)


def _share(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.RecordBatch]:
    """Of some ranges of shingles those that two sets have, by document; id rows go through."""
    rest: list[pa.RecordBatch] = []
    for run in _bounded(_packed_runs(batches, ["digests", "sizes", "counts", "tokens"], rest), False):
        yield from rest
        rest.clear()
        found = _shared_of(run, len(keys))
        del run
        if found:
            empty = {f.name: None for f in _SHARED}
            slot = (found[0] % np.uint64(len(keys))).astype(np.int64)
            rows = [empty | dict(zip(("slot", "digests", "sizes", "counts", "tokens", "dfs"), (keys[p], *(x.tobytes() for x in own)))) for p, own in _split(found, np.repeat(slot, found[2]), len(keys))]
            yield pa.RecordBatch.from_pylist(rows, _SHARED)
    yield from rest


def _shared_of(run: Run, parts: int) -> Run | None:
    """Of the block those shingles that two sets have, with their frequency; a set that several tasks saw counts once."""
    digest, size, count, token = run
    count = count.astype(np.int64)
    start = np.cumsum(count) - count
    slot = _slot_of(token[start], parts)  # a block may hold several slots, each with a segment of the set
    order = np.lexsort((slot, digest))
    again = (digest[order][1:] == digest[order][:-1]) & (slot[order][1:] == slot[order][:-1])
    if again.any():
        first = order[np.append(True, ~again)]
        token = token[_segments(start[first], count[first])]
        digest, size, count = digest[first], size[first], count[first]
    order = np.argsort(token)
    edge = _runs(token[order])
    times = np.diff(edge).astype(np.uint32)
    df = np.empty(len(token), np.uint32)
    df[order] = np.repeat(times, times)
    del order
    keep = df > 1
    left = np.add.reduceat(keep, np.cumsum(count) - count, dtype=np.int64)
    some = left > 0
    return [digest[some], size[some], left[some].astype(np.uint32), token[keep], df[keep]] if some.any() else None


_SURVIVOR = pa.schema([("digest", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that can have a partner: their shared shingles, and those of their rarest ones that are shared."""
    for digest, size, count, token, df in _bounded(_packed_runs(batches, ["digests", "sizes", "counts", "tokens", "dfs"], []), True):
        count = count.astype(np.int64)
        start = np.cumsum(count) - count
        order = np.argsort(digest, kind="stable")
        run = _runs(digest[order])
        shared = np.add.reduceat(count[order], run[:-1])
        n = size[order][run[:-1]].astype(np.int64)
        able = np.flatnonzero(4 * shared >= 3 * n)
        rows, held = [], 0
        for k in able.tolist():
            blocks_of = order[run[k] : run[k + 1]]
            at = _segments(start[blocks_of], count[blocks_of])
            own, often, whole = token[at], df[at], int(n[k])
            prefix = whole - (3 * whole + 3) // 4 + 1 - (whole - len(own))
            rare = own[np.lexsort((own, often))[:prefix]]
            rows.append({"digest": int(digest[order[run[k]]].view(np.int64)), "n": whole, "tokens": np.sort(own).tobytes(), "prefix": rare.view(np.int64)})
            held += 16 * len(own)
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, _SURVIVOR)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SURVIVOR)


def _cells(batches: Iterator[pa.RecordBatch], names: list[str], guests: int = CELL) -> Iterator[dict[str, list]]:
    """Rows sorted by (family, chunk[, role]) cell by cell; a cell's guests (role 1) come ``guests`` bytes at a time, each time with its own sets."""
    here, own, more, size = None, {}, {}, 0
    for b in batches:
        columns = [b.column(b.schema.get_field_index(n)) for n in ("family", "chunk", *names)]
        for i in range(b.num_rows):
            family, chunk, *row = (c[i].as_py() for c in columns)
            if (family, chunk) != here:
                if here is not None:
                    yield {n: own[n] + more[n] for n in names}
                here, own, more, size = (family, chunk), {n: [] for n in names}, {n: [] for n in names}, 0
            guest = "role" in names and row[names.index("role")] == 1
            for n, v in zip(names, row):
                (more if guest else own)[n].append(v)
            if guest and (size := size + len(row[names.index("tokens")])) > guests:
                yield {n: own[n] + more[n] for n in names}
                more, size = {n: [] for n in names}, 0
    if here is not None:
        yield {n: own[n] + more[n] for n in names}


def _tree_self(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each cell's tree joined with itself: (digest, component), the component's smallest digest."""
    for c in _cells(batches, ["digest", "n", "tokens"]):
        sets, sizes, digest = [np.frombuffer(t, "<u8") for t in c["tokens"]], np.array(c["n"], np.int64), np.array(c["digest"], np.int64)
        forest = Forest(np.arange(len(sets)))
        if len(sets) > 1:
            tree = Tree(np.arange(len(sets)), sets, sizes, bits_for(sets))
            for _ in join(tree, tree, sets, sizes, forest):
                pass
        roots = forest.roots()
        low = np.full(len(sets), np.iinfo(np.int64).max)
        np.minimum.at(low, roots, digest)
        yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(low[roots])], ["digest", "component"])


def _tree_cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each cell's own sets (role 0) joined with its guests (role 1): links between components."""
    for c in _cells(batches, ["role", "n", "tokens", "component"]):
        sets, sizes = [np.frombuffer(t, "<u8") for t in c["tokens"]], np.array(c["n"], np.int64)
        role, component = np.array(c["role"]), np.array(c["component"], np.int64)
        if not len(role) or role.min() == role.max():
            continue
        _, first, back = np.unique(component, return_index=True, return_inverse=True)
        low = np.full(len(first), len(sets), np.int64)
        np.minimum.at(low, back, np.arange(len(sets)))
        forest = Forest(low[back])
        bits = bits_for(sets)
        own, guests = (Tree(np.flatnonzero(role == r), sets, sizes, bits) for r in (0, 1))
        found = list(join(own, guests, sets, sizes, forest))
        if found:
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(component[a]), pa.array(component[b])], ["src", "dst"])


def _relabel(local: DataFrame, links: DataFrame) -> DataFrame:
    """``local`` with its components merged along ``links``."""
    merged = connected_components(links).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return local.join(merged, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")


def _largest(local: DataFrame) -> DataFrame:
    """Of each family its component with most sets."""
    sized = local.groupBy("family", "component").agg(F.count("*").alias("k"))
    return sized.groupBy("family").agg(F.max_by("component", F.struct("k", "component")).alias("largest"))


def _across_chunks(local: DataFrame, survivors: DataFrame, parts: int) -> DataFrame:
    """``local`` with the links between chunks of the families that have several."""
    big = local.where("n_chunks > 1")
    first = big.where("chunk = 0")
    rank = Window.partitionBy("family").orderBy("digest")  # one chunk's sets at most
    leaders = first.join(_largest(first), "family").where("component = largest").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= LEADERS)
    cell = ["family", "chunk", "role", "digest", "component"]
    guests = leaders.select("family", "digest", "component").join(big.where("chunk > 0").select("family", "chunk").distinct(), "family").withColumn("role", F.lit(1))
    rows = big.where("chunk > 0").withColumn("role", F.lit(0)).select(cell).union(guests.select(cell))

    def links(rows: DataFrame) -> DataFrame:
        held = rows.join(survivors.select("digest", "n", "tokens"), "digest").repartition(parts, "family", "chunk").sortWithinPartitions("family", "chunk", "role")
        return stage_table(held.mapInArrow(_tree_cross, "src bigint, dst bigint"), "jaccard-links")

    local = stage_table(_relabel(local, links(rows)), "jaccard-leaders")
    big = local.where("n_chunks > 1")
    outside = big.join(_largest(big), "family").where("component <> largest")
    rare = survivors.select("digest", F.explode("prefix").alias("token"))
    there = big.join(rare, "digest").select("token", "family", F.col("chunk").alias("to")).distinct()
    visits = outside.join(rare, "digest").join(there, ["token", "family"]).where("to <> chunk")
    guests = visits.select("family", F.col("to").alias("chunk"), F.lit(1).alias("role"), "digest", "component").distinct()
    hosts = big.join(guests.select("family", "chunk").distinct(), ["family", "chunk"]).withColumn("role", F.lit(0))
    return _relabel(local, links(hosts.select(cell).union(guests.select(cell))))


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id (``_NO_ID`` for null), n, digest, group for every row of ``docs``; rows of one group are connected."""
    spark = docs.sparkSession
    parts = slots(docs, 10 << 20)
    keys = slot_keys(spark, parts)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = source.mapInArrow(lambda it: _deal(it, keys), _PACKED_DDL).repartition(parts, "slot")
    shared = stage_table(dealt.mapInArrow(lambda it: _share(it, keys), _SHARED_DDL), "jaccard-shared")
    survivors = shared.where("slot is not null").select("slot", "digests", "sizes", "counts", "tokens", "dfs").repartition(parts, "slot")
    survivors = stage_table(survivors.mapInArrow(_survive, "digest bigint, n int, tokens binary, prefix array<bigint>"), "jaccard-survivors")

    rare = survivors.select("digest", F.explode("prefix").alias("token"))
    meet = rare.groupBy("token").agg(F.min("digest").alias("low"), F.count("*").alias("k")).where("k > 1").select("token", "low").repartition("low")
    families = connected_components(rare.join(meet, "token").select("digest", "low").where("digest <> low").distinct(), "digest", "low")
    members = families.select(F.col("id").alias("digest"), F.col("component").alias("family")).join(survivors.select("digest", F.octet_length("tokens").alias("bytes")), "digest")
    members = stage_table(members, "jaccard-families")
    chunks = F.ceil(F.greatest(F.count("*") / chunk, F.sum("bytes") / CELL)).cast("int")
    size = members.groupBy("family").agg(chunks.alias("n_chunks")).repartition("n_chunks", "family")
    placed = members.join(size, "family").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("n_chunks")).cast("int"))
    placed = stage_table(placed.select("digest", "family", "chunk", "n_chunks"), "jaccard-cells")
    cells = placed.join(survivors.select("digest", "n", "tokens"), "digest").select("family", "chunk", "digest", "n", "tokens")
    cells = cells.repartition(parts, "family", "chunk").sortWithinPartitions("family", "chunk")
    found = cells.mapInArrow(_tree_self, "digest bigint, component bigint")
    local = stage_table(placed.join(found, "digest"), "jaccard-local")
    if local.where("n_chunks > 1").limit(1).count():
        local = _across_chunks(local, survivors, parts)

    rows = shared.where("slot is null").select("doc_id", "n", "digest").join(local.select("digest", "component"), "digest", "left")
    return rows.select("doc_id", "n", "digest", F.coalesce("component", "digest").alias("group"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    rows = _grouped(docs, id_col, text_col, chunk).drop("digest")
    lowest = rows.where("n > 0").groupBy("group").agg(F.min(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id"))).alias("low")).repartition("low")
    some = rows.where("n > 0").join(lowest, "group").select("doc_id", "n", "low")
    none = rows.where("n = 0").select("doc_id", "n", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("low"))
    return some.unionByName(none).select(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("low").alias("component_id"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id) with the digest of the row's shingle set."""
    for batch in batches:
        for at, texts in blocks(pa.RecordBatch.from_struct_array(batch.column(0))):
            digest = [xxhash.xxh3_64_intdigest(s) for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns), pa.array(np.array(digest, np.uint64).view(np.int64))], ["row", "id", "digest"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns kept; rows without words stay.

    The row is one of the smallest doc_id, a null one counting as the largest, then of the
    smallest set digest.  Rows whose id no other row has are told apart by it; the others, and
    those without an id, by id and digest, and of equals among them one stays.
    """
    rows = stage_table(_grouped(docs), "jaccard-rows")
    order = F.struct((F.col("doc_id") == _NO_ID).alias("none"), "doc_id", "digest")
    first = rows.where("n > 0").groupBy("group").agg(F.min(order).alias("f")).select("group", F.col("f.doc_id").alias("kept"), F.col("f.digest").alias("as")).repartition("kept")
    told = rows.where("n > 0").join(first, "group")
    lost = told.where("doc_id <> kept").select(F.col("doc_id").alias("id")).distinct()
    many = rows.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("k")).where((F.col("k") > 1) | (F.col("id") == _NO_ID)).select("id")
    many = stage_table(many, "jaccard-repeated")
    held = docs.select(row_of(docs).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"))
    out = from_row("row", docs.columns)
    if not many.limit(1).count():
        return held.join(lost, "id", "left_anti").select(out)
    clear = held.join(lost.union(many), "id", "left_anti").select("row")
    again = held.join(many, "id", "left_semi").select("row", "id")
    again = again.mapInArrow(_digests, T.StructType([*again.schema.fields, T.StructField("digest", T.LongType())]))
    kept = told.where("doc_id = kept and digest = as").select(F.col("doc_id").alias("id"), "digest", F.lit(True).alias("one")).union(rows.where("n = 0").select("doc_id", "digest", F.lit(False))).distinct()
    again = again.join(kept, ["id", "digest"])
    one = again.where("one").groupBy("id", "digest").agg(F.min_by("row", F.struct(F.xxhash64("row.text"), "row.text")).alias("row")).select("row")
    return clear.union(one).union(again.where("not one").select("row")).select(out)
