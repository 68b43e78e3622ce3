"""Connected components as an iterative DataFrame plan (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.session import stage_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every vertex links (part of) its neighbourhood to the smallest member."""
    if large:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
    joined = both.join(low, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(low.select("src", F.col("m").alias("dst")))
    return out.where("src <> dst").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every vertex that occurs in ``edges``; component is its smallest id.

    Nulls and self loops add no edge, but a self loop's vertex is reported.  Each round is
    written to the shared folder; the loop ends when the edge set no longer changes, which
    takes a number of rounds that grows with the logarithm of the largest component.
    """
    raw = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    raw = stage_table(raw.distinct(), "cc-edges")
    current = raw.where("src <> dst")
    before = None
    for _ in range(max_rounds):
        current = stage_table(_star(_star(current, True), False), "cc-round")
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("s")).first()
        state = (row["n"], row["s"])
        if state == before or not row["n"]:
            break
        before = state
    else:
        raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
    vertices = raw.select(F.col("src").alias("id")).union(raw.select(F.col("dst").alias("id"))).distinct()
    label = current.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
    return vertices.join(label, "id", "left").select("id", F.coalesce("m", "id").alias("component"))
