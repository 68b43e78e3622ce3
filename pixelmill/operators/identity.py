"""Vectors: centroids, nearest identities, neighbour graphs and clusterers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions import vector
from pixelmill.operators.graph import connected_components
from pixelmill.session import stage_table


def dominant_length(faces: DataFrame, vec: str = "vector") -> DataFrame:
    """The faces whose vectors have the most common length, the larger among equals."""
    lengths = faces.groupBy(F.size(vec).alias("_n")).agg(F.count("*").alias("_k")).agg(F.max_by("_n", F.struct("_k", "_n")).alias("_best"))
    return faces.join(F.broadcast(lengths), F.size(vec) == F.col("_best")).drop("_best")


def centroids(faces: DataFrame, key: str, vec: str = "vector", unit: bool = False) -> DataFrame:
    """(key, n, centroid): the mean vector per key, ragged ones padded with zeros; ``unit`` normalises it.

    Positions are summed map side first, so a key with very many vectors makes no large task.
    """
    sums = faces.select(key, F.posexplode(vec).alias("_i", "_v")).groupBy(key, "_i").agg(F.sum(F.col("_v").cast("double")).alias("_s"))
    counts = faces.groupBy(key).agg(F.count("*").alias("n"))
    packed = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_p"))
    out = counts.join(packed, key).select(key, "n", F.transform("_p", lambda p: p["_s"] / F.col("n")).alias("centroid"))
    return out.withColumn("centroid", vector.normalized(F.col("centroid"))) if unit else out


def cohesion(faces: DataFrame, key: str, vec: str = "vector") -> DataFrame:
    """Mean cosine of a key's vectors to their centroid."""
    return faces.join(centroids(faces, key, vec, unit=True), key).groupBy(key).agg(F.avg(vector.cosine(F.col(vec), F.col("centroid"))).alias("cohesion"))


def pairwise_similarity(faces: DataFrame, key: str, vec: str = "vector") -> DataFrame:
    """Mean cosine over all pairs of a key's vectors, from sums alone.

    The pairs' cosines add up to (|sum of unit vectors|^2 - n) / 2, so no pair is formed.
    """
    unit = faces.select(key, vector.normalized(F.col(vec)).alias("_u"), (vector.norm(F.col(vec)) > 0).cast("int").alias("_ok"))
    sums = unit.select(key, F.posexplode("_u").alias("_i", "_v")).groupBy(key, "_i").agg(F.sum("_v").alias("_s")).groupBy(key).agg(F.sum(F.col("_s") * F.col("_s")).alias("_sq"))
    n = unit.groupBy(key).agg(F.count("*").alias("n"), F.sum("_ok").alias("_self"))
    return n.join(sums, key).select(key, "n", F.when(F.col("n") > 1, (F.col("_sq") - F.col("_self")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("mean_similarity"))


def candidates(faces: DataFrame, centroid: DataFrame, floor: float = 0.60, k: int = 32, vec: str = "vector", face_id: str = "id") -> DataFrame:
    """The ``k`` faces most like one identity's centroid (a single row), at ``floor`` or above."""
    scored = faces.join(F.broadcast(centroid.select("centroid").limit(1))).withColumn("score", vector.cosine(F.col(vec), F.col("centroid")))
    return scored.where(F.col("score") >= floor).drop("centroid").orderBy(F.desc("score"), face_id).limit(k)


def related(cents: DataFrame, key: str, of, threshold: float = 0.72, k: int = 12) -> DataFrame:
    """Identities whose centroid is like that of ``of``."""
    ref = cents.where(F.col(key) == of).select(F.col("centroid").alias("_ref")).limit(1)
    scored = cents.where(F.col(key) != of).join(F.broadcast(ref)).select(key, vector.cosine(F.col("centroid"), F.col("_ref")).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(k)


def match(faces: DataFrame, identities: DataFrame, clarification: float = 0.72, vec: str = "vector", face_id: str = "id", key: str = "identity_id", block: int = 4096) -> DataFrame:
    """(face, identity, score, decision): each face's best identity; assigned at the identity's bar, a suggestion at ``clarification``.

    Identities are dealt into blocks of ``block`` and meet the faces block by block through an
    equi-join, so neither side is broadcast; the best of a face is a partial maximum.
    """
    blocks = identities.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(8)))
    spread = faces.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    scored = spread.join(blocks, "_b").select(face_id, key, "n", vector.cosine(F.col(vec), F.col("centroid")).alias("score"))
    best = scored.groupBy(face_id).agg(F.max_by(F.struct(key, "n", "score"), F.struct("score", F.col(key).cast("string"))).alias("b")).select(face_id, "b.*")
    bar = vector.cluster_threshold(F.col("n"))
    return best.withColumn("decision", F.when(F.col("score") >= bar, "assign").when(F.col("score") >= clarification, "clarify").otherwise("skip")).where("decision <> 'skip'").drop("n")


def nearest(faces: DataFrame, k: int, floor: float = -1.0, vec: str = "vector", face_id: str = "id", asset: str | None = None) -> DataFrame:
    """(src, dst, sim, rank): each face's ``k`` nearest at ``floor`` or above, exactly.

    Vectors travel in packed blocks: each of B blocks meets each other one once, as matrices.
    """
    spark = faces.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cols = [F.col(face_id).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"), (F.col(asset) if asset else F.col(face_id)).cast("string").alias("a")]
    base = faces.select(*cols).withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    pairs = base.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    left = pairs.withColumn("side", F.lit(0)).withColumnsRenamed({"blk": "x", "other": "y"})
    right = pairs.withColumn("side", F.lit(1)).withColumnsRenamed({"blk": "y", "other": "x"})

    def top(pdf):
        one, two = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(one) or not len(two):
            return type(pdf)({"src": [], "dst": [], "sim": []})
        m, q = (np.stack(d.v.to_list()) for d in (one, two))
        m, q = (d / np.where((n := np.linalg.norm(d, axis=1, keepdims=True)) == 0, 1, n) for d in (m, q))
        sim = m @ q.T
        sim[(one.id.to_numpy()[:, None] == two.id.to_numpy()) | ((one.a.to_numpy()[:, None] == two.a.to_numpy()) if asset else False)] = -2
        out, ids = [], two.id.to_numpy()
        for i, src in enumerate(one.id.to_numpy()):
            best = np.lexsort((ids, -sim[i]))[:k]
            out += [(int(src), int(ids[j]), float(sim[i, j])) for j in best if sim[i, j] >= max(floor, -1.5)]
        return type(pdf)(out, columns=["src", "dst", "sim"])

    near = left.unionByName(right).groupBy("x", "y").applyInPandas(top, "src long, dst long, sim double")
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _met(one: DataFrame, two: DataFrame, body, schema: str, once: bool = False, vec: str = "vector", face_id: str = "id", asset: str | None = None) -> DataFrame:
    """``body(ids of one, ids of two, cosines)`` of every block of ``one`` with every block of ``two``, as rows of ``schema``.

    Vectors travel in packed blocks as in ``nearest``.  A face and itself, and with
    ``asset`` faces of one asset, have -2 for their cosine.  ``once``: both sides are the same
    faces and each pair of blocks meets in one order only.
    """
    parts = max(1, int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = [F.col(face_id).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"), (F.col(asset) if asset else F.col(face_id)).cast("string").alias("a")]

    def spread(faces: DataFrame, side: int) -> DataFrame:
        own, other = ("x", "y") if side == 0 else ("y", "x")
        base = faces.select(*cols).withColumn(own, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("side", F.lit(side))
        low, high = (F.col("x"), F.lit(parts - 1)) if once and side == 0 else (F.lit(0), F.col("y") if once else F.lit(parts - 1))
        return base.withColumn(other, F.explode(F.sequence(low, high))).select("id", "v", "a", "side", "x", "y")

    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf):
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(left) or not len(right):
            return type(pdf)({c: [] for c in names})
        m, q = (np.stack(d.v.to_list()) for d in (left, right))
        m, q = (d / np.where((n := np.linalg.norm(d, axis=1, keepdims=True)) == 0, 1, n) for d in (m, q))
        sim = m @ q.T
        sim[(left.id.to_numpy()[:, None] == right.id.to_numpy()) | ((left.a.to_numpy()[:, None] == right.a.to_numpy()) if asset else False)] = -2
        return type(pdf)(body(left.id.to_numpy(), right.id.to_numpy(), sim), columns=names)

    return spread(one, 0).unionByName(spread(two, 1)).groupBy("x", "y").applyInPandas(run, schema)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) of a boolean matrix that keep connected what all its links connect, fewer than rows and columns together."""
    out, row_left, col_left = [], np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)
    for start in range(linked.shape[0]):
        if not row_left[start]:
            continue
        row_left[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            cols = np.flatnonzero(linked[i] & col_left)
            col_left[cols] = False
            out += [(i, int(j)) for j in cols]
            for j in cols:
                rows = np.flatnonzero(linked[:, j] & row_left)
                row_left[rows] = False
                out += [(int(r), int(j)) for r in rows]
                todo += rows.tolist()
    return out


def links(faces: DataFrame, floor: float, **names) -> DataFrame:
    """(src, dst): faces at ``floor`` or above, cut to a spanning forest of each pair of blocks, so that no component changes."""

    def spanning(one: np.ndarray, two: np.ndarray, sim: np.ndarray) -> list[tuple]:
        return [(int(one[i]), int(two[j])) for i, j in _forest(sim >= max(floor, -1.5))]

    return _met(faces, faces, spanning, "src long, dst long", once=True, **names)


def threshold_components(faces: DataFrame, floor: float = 0.82, **names) -> DataFrame:
    """Components of the graph that links all faces at ``floor`` or above."""
    return connected_components(links(faces, floor, **names))


def nearest_neighbor_components(faces: DataFrame, floor: float = 0.75, **names) -> DataFrame:
    """Components of the graph that links each face with its nearest; shared neighbours follow from it."""
    return connected_components(nearest(faces, 1, floor, **names))


def density_components(faces: DataFrame, k: int = 12, floor: float = 0.74, density: float = 0.77, **names) -> DataFrame:
    """kNN graph among faces whose mean similarity to their neighbours reaches ``density``."""
    near = stage_table(nearest(faces, k, floor, **names), "identity-knn")
    dense = near.groupBy("src").agg(F.avg("sim").alias("d")).where(F.col("d") >= density).select(F.col("src").alias("id"))
    kept = near.join(dense.withColumnRenamed("id", "src"), "src", "left_semi").join(dense.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return connected_components(kept)


def dbscan(faces: DataFrame, eps: float = 0.22, min_points: int = 3, **names) -> DataFrame:
    """(id, component): core faces within ``eps`` (cosine distance) connect; border faces join their nearest core."""
    floor, face_id = max(1 - eps, -1.5), names.get("face_id", "id")

    def count(one: np.ndarray, two: np.ndarray, sim: np.ndarray) -> list[tuple]:
        n = (sim >= floor).sum(1)
        return [(int(i), int(k)) for i, k in zip(one, n) if k]

    def best(one: np.ndarray, two: np.ndarray, sim: np.ndarray) -> list[tuple]:
        out = []
        for i, src in enumerate(one):
            j = np.lexsort((two, sim[i]))[-1]
            if sim[i, j] >= floor:
                out.append((int(src), int(two[j]), float(sim[i, j])))
        return out

    near = _met(faces, faces, count, "id long, n long", **names).groupBy("id").agg((F.sum("n") + 1).alias("n"))
    near = stage_table(near.select("id", (F.col("n") >= min_points).alias("core")), "identity-dbscan")
    of = lambda core: faces.join(near.where(F.col("core") == core).select(F.col("id").alias("_id")), F.col(face_id) == F.col("_id"), "left_semi")
    own = near.where("core").select(F.col("id").alias("src"), F.col("id").alias("dst"))
    inner = connected_components(links(of(True), 1 - eps, **names).union(own))
    border = _met(of(False), of(True), best, "src long, dst long, sim double", **names).join(inner.withColumnRenamed("id", "dst"), "dst")
    near_core = border.groupBy(F.col("src").alias("id")).agg(F.max_by("component", F.struct("sim", "dst")).alias("component"))
    return inner.unionByName(near_core)


def label_propagation(faces: DataFrame, k: int = 10, floor: float = 0.76, rounds: int = 20, **names) -> DataFrame:
    """(id, component) by propagation of the label with most weight over the kNN graph, all at once per round."""
    near = stage_table(nearest(faces, k, floor, **names).select("src", "dst", "sim"), "identity-cw")
    edges = near.union(near.select("dst", "src", "sim")).groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    edges = stage_table(edges, "identity-cw-edges")
    labels = edges.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    for _ in range(rounds):
        votes = edges.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "component").agg(F.sum("sim").alias("w"))
        own = labels.select(F.col("id").alias("src"), "component", F.lit(0.5).alias("w"))
        new = votes.unionByName(own).groupBy("src", "component").agg(F.sum("w").alias("w")).groupBy(F.col("src").alias("id")).agg(F.max_by("component", F.struct("w", -F.col("component"))).alias("component"))
        new = stage_table(new, "identity-cw-labels")
        moved = new.join(labels.withColumnRenamed("component", "before"), "id").where("component <> before").limit(1).count()
        labels = new
        if not moved:
            break
    return labels


def complete_linkage(vectors: np.ndarray, limit: float = 0.24) -> np.ndarray:
    """Agglomerative labels of one block of vectors: clusters merge while their farthest pair is within ``limit``."""
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(n == 0, 1, n)
    far = 1 - unit @ unit.T
    np.fill_diagonal(far, np.inf)
    label = np.arange(len(vectors))
    while len(far) and far.min() <= limit:
        i, j = sorted(divmod(int(far.argmin()), len(far)))
        label[label == label[j]] = label[i]
        far[i] = far[:, i] = np.maximum(far[i], far[j])
        far[i, i] = np.inf
        far[j] = far[:, j] = np.inf
    return label


def qualified(clusters: DataFrame, faces: DataFrame, min_assets: int = 10, min_similarity: float = 0.67, asset: str = "asset_id", face_id: str = "id", vec: str = "vector") -> DataFrame:
    """Clusters (id, component) that cover enough assets and hold together."""
    joined = faces.select(F.col(face_id).alias("id"), F.col(asset).alias("_a"), F.col(vec).alias("_v")).join(clusters, "id")
    wide = joined.groupBy("component").agg(F.countDistinct("_a").alias("assets")).where(F.col("assets") >= min_assets)
    tight = pairwise_similarity(joined, "component", "_v").where(F.col("mean_similarity") >= min_similarity)
    return wide.join(tight.select("component", "n", "mean_similarity"), "component")


#: Floors of the evidence that two clusters are one person.
MERGE = {
    "least": 0.58, "centroid": 0.78, "slack": 0.03, "cross": 0.76, "direction": 0.72, "support": 0.72, "pair": 0.84, "cohesion": 0.70, "drop": 0.16,
    "sure_centroid": 0.80, "sure_pair": 0.88, "sure_top": 0.79,
}


def merge_evidence(left: np.ndarray, right: np.ndarray, left_assets: set, right_assets: set, threshold: float = 0.88) -> dict[str, float] | None:
    """Why two clusters may merge, or None: apart in assets, alike in centre, pairs and both directions, and still one afterwards."""
    if min(len(left), len(right)) < 2 or left_assets & right_assets:
        return None
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=-1, keepdims=True)) == 0, 1, n)
    a, b = unit(left), unit(right)
    center = lambda x: unit(x.mean(0))
    centroid, cross = float(center(a) @ center(b)), a @ b.T
    if centroid < MERGE["least"]:
        return None
    few = min(len(a), len(b))
    top = float(np.sort(cross.ravel())[-max(1, min(12, int(np.ceil(0.35 * few)))) :].mean())
    rows, cols = cross.max(1), cross.max(0)
    direction = float(min(rows.mean(), cols.mean()))
    sure = centroid >= MERGE["sure_centroid"] and cross.max() >= MERGE["sure_pair"] and top >= MERGE["sure_top"] and direction >= MERGE["direction"] - 0.02
    needed = max(2, min(6, int(np.ceil(0.2 * few))))
    if not sure and min((rows >= MERGE["support"]).sum(), (cols >= MERGE["support"]).sum()) < needed or direction < MERGE["direction"]:
        return None
    held = lambda x: float((x @ center(x)).mean())
    both = held(np.concatenate([a, b]))
    floor = max(MERGE["centroid"], threshold)
    if both < MERGE["cohesion"] - (0.03 if sure else 0.0) or (min(held(a), held(b)) - both > MERGE["drop"] and both < floor):
        return None
    near = centroid >= floor - MERGE["slack"] and top >= MERGE["cross"]
    bridge = centroid >= max(MERGE["least"], floor - 0.12) and cross.max() >= MERGE["pair"] and top >= MERGE["cross"]
    return {"score": 0.45 * centroid + 0.35 * top + 0.20 * direction, "centroid": centroid, "top_mean": top, "directional_mean": direction, "cohesion": both} if near or bridge else None


#: Centroids less alike than this can never come to the least floor of evidence by merging: a merged
#: cluster's cohesion is at least 0.67, so its centroid's cosine with another is at most the largest
#: of its parts' over 0.67, and the same holds for the other one.
APART = MERGE["least"] * (MERGE["cohesion"] - 0.03) ** 2


def merge_plan(profiles: dict[str, tuple[np.ndarray, set]], threshold: float) -> list[tuple[str, str]]:
    """(source, target) of the merges of a few clusters, best evidence first, each followed by new evidence for what it made."""
    profiles, plan = {k: v for k, v in profiles.items() if len(v[0]) > 1}, []
    ids = sorted(profiles)
    found = {(a, b): merge_evidence(profiles[a][0], profiles[b][0], profiles[a][1], profiles[b][1], threshold) for i, a in enumerate(ids) for b in ids[i + 1 :]}
    rank = lambda pair: (found[pair]["score"], found[pair]["centroid"], found[pair]["cohesion"])
    while live := sorted(pair for pair, e in found.items() if e):
        a, b = max(live, key=rank)  # the first pair among equals
        target, source = sorted((a, b), key=lambda k: (-len(profiles[k][0]), k))
        plan.append((source, target))
        (x, seen), (y, more) = profiles[target], profiles.pop(source)
        profiles[target] = np.concatenate([x, y]), seen | more
        found = {pair: e for pair, e in found.items() if source not in pair and target not in pair}
        for k in profiles:
            if k != target:
                one, two = sorted((k, target))
                found[(one, two)] = merge_evidence(profiles[one][0], profiles[two][0], profiles[one][1], profiles[two][1], threshold)
    return plan


def merge_clusters(faces: DataFrame, threshold: float = 0.88, key: str = "identity_id", vec: str = "vector", asset: str = "asset_id") -> DataFrame:
    """(source, target): identities that are one person by ``merge_evidence``, each with the one it ends in.

    Identities meet only in a component of the graph that links centroids at ``APART``, so the
    search for the best pair runs block by block and gives what it would over all.  A
    block's vectors are one task's memory.
    """
    known = faces.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.transform(vec, lambda x: x.cast("double")).alias("v"), F.col(asset).cast("string").alias("a"))
    known = stage_table(known, "identity-profiles")
    cents = stage_table(centroids(known, "h", "v", unit=True).where("n > 1"), "identity-centroids")
    own = cents.select(F.col("h").alias("src"), F.col("h").alias("dst"))
    blocks = connected_components(links(cents, APART, vec="centroid", face_id="h").union(own)).select(F.col("id").alias("h"), F.col("component").alias("block"))

    def run(pdf):
        profiles = {k: (np.stack(g.v.to_list()), set(g.a.dropna())) for k, g in pdf.groupby("k")}
        to: dict[str, str] = {}
        for source, target in merge_plan(profiles, threshold):
            to = {s: (target if t == source else t) for s, t in to.items()} | {source: target}
        return type(pdf)({"source": list(to), "target": list(to.values())}, dtype="object")

    return known.join(blocks, "h").groupBy("block").applyInPandas(run, "source string, target string")


#: Bars of the clusterer.
CLUSTER = {"neighbor": 0.72, "below": 0.20, "component": 0.995, "pairwise": 0.67, "assets": 10, "snowball": 6, "merges": 8}


def cluster(faces: DataFrame, identities: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(faces, identities) after clustering; faces: id (long), asset_id, identity_id (text), status, vector; identities: id (text), label, status.

    Faces without an identity go to the best one if they reach its bar.  The rest link with
    their nearest of another asset, components with almost equal centroids become one, and
    those that cover enough assets and hold together become identities; then faces left over
    are matched again until none moves, and identities merge while there is evidence.
    All faces of a pass are matched against the same centroids.  Each pass is staged.
    """
    columns = faces.columns
    faces = stage_table(dominant_length(faces), "cluster-faces")

    def matched(now: DataFrame, people: DataFrame) -> tuple[DataFrame, int]:
        free = now.where("identity_id is null and status <> 'REJECTED'")
        cents = centroids(now.where("identity_id is not null and status <> 'REJECTED'"), "identity_id")
        hits = match(free.drop("identity_id"), cents, clarification=2.0).where("decision = 'assign'").select("id", F.col("identity_id").alias("_to"))
        hits = hits.join(people.select(F.col("id").alias("_to"), (F.col("status") == "CONFIRMED").alias("_sure")), "_to", "left")
        out = now.join(hits, "id", "left").withColumns({"identity_id": F.coalesce("identity_id", "_to"), "status": F.when(F.col("_to").isNull(), F.col("status")).when(F.col("_sure"), "LABELED").otherwise("CLUSTERED")})
        out = stage_table(out.select(columns), "cluster-matched")
        return out, out.where("identity_id is not null").count() - now.where("identity_id is not null").count()

    faces, _ = matched(faces, identities)
    rest = faces.where("identity_id is null and status <> 'REJECTED'")
    found = stage_table(connected_components(nearest(rest, 1, max(CLUSTER["neighbor"], threshold - CLUSTER["below"]), asset="asset_id")), "cluster-components")
    cents = stage_table(centroids(rest.join(found, "id"), "component", unit=True), "cluster-centroids")
    alike = connected_components(links(cents, CLUSTER["component"], vec="centroid", face_id="component")).select(F.col("id").alias("component"), F.col("component").alias("_one"))
    found = found.join(alike, "component", "left").select("id", F.coalesce("_one", "component").alias("component"))
    good = qualified(found, rest, CLUSTER["assets"], CLUSTER["pairwise"]).where("n > 1").select("component")
    made = stage_table(found.join(good, "component").select("id", F.concat(F.lit("cluster-"), F.col("component").cast("string")).alias("_to")), "cluster-made")
    new = made.select(F.col("_to").alias("id")).distinct().select("id", F.concat(F.lit("Cluster "), F.substring("id", 9, 20)).alias("label"), F.lit("CLUSTERED").alias("status"))
    identities = stage_table(identities.select("id", "label", "status").unionByName(new), "cluster-identities")
    faces = faces.join(made, "id", "left").withColumns({"identity_id": F.coalesce("identity_id", "_to"), "status": F.when(F.col("_to").isNotNull(), "CLUSTERED").otherwise(F.col("status"))})
    faces = stage_table(faces.select(columns), "cluster-first")
    for _ in range(CLUSTER["snowball"]):
        faces, moved = matched(faces, identities)
        if not moved:
            break
    for _ in range(CLUSTER["merges"]):
        open_ones = faces.where("status <> 'REJECTED'").join(identities.where("status = 'CLUSTERED'").select(F.col("id").alias("identity_id")), "identity_id", "left_semi")
        mapping = stage_table(merge_clusters(open_ones, max(MERGE["least"], threshold - CLUSTER["below"])), "cluster-merges")
        if not mapping.limit(1).count():
            break
        identities = stage_table(identities.join(mapping.select(F.col("source").alias("id")), "id", "left_anti"), "cluster-identities")
        faces, _ = matched(remap(faces, mapping), identities)
    return faces, identities


def remap(faces: DataFrame, mapping: DataFrame, key: str = "identity_id") -> DataFrame:
    """Faces re-pointed along (source, target) merges of identities."""
    return faces.join(mapping.select(F.col("source").alias(key), "target"), key, "left").withColumn(key, F.coalesce("target", key)).drop("target").select(faces.columns)


def reset_machine_made(faces: DataFrame, identities: DataFrame) -> DataFrame:
    """Faces as before clustering, but for those of confirmed identities and rejected ones."""
    kept = identities.where("status = 'CONFIRMED'").select(F.col("id").alias("identity_id")).withColumn("_c", F.lit(1))
    out = faces.join(kept, "identity_id", "left")
    stays = F.col("_c").isNotNull() | (F.col("status") == "REJECTED")
    return out.withColumns({"identity_id": F.when(stays, F.col("identity_id")), "status": F.when(stays, F.col("status")).otherwise("DETECTED")}).select(faces.columns)


def seed_benchmark(scores: DataFrame, positives: int = 24, hard: int = 16, easy: int = 12) -> DataFrame:
    """Labelled pairs per identity: (identity_id, face_id, own, score) cut to top positives, hard and easy negatives, with weights."""
    kind = F.when(F.col("own"), "positive").when(F.col("score") >= 0.60, "hard_negative").when(F.col("score") <= 0.45, "easy_negative")
    order = F.when(F.col("seed_type") == "easy_negative", F.col("score")).otherwise(-F.col("score"))
    w = Window.partitionBy("identity_id", "seed_type").orderBy(order, "face_id")
    limit = F.when(F.col("seed_type") == "positive", positives).when(F.col("seed_type") == "hard_negative", hard).otherwise(easy)
    kept = scores.withColumn("seed_type", kind).where("seed_type is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    return kept.withColumns({"label": F.col("own").cast("int"), "weight": F.when(F.col("seed_type") == "hard_negative", 0.4).otherwise(1.0)}).drop("_r", "own")
