"""Structured Streaming forms of the catalog's incremental operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequences(events: DataFrame, key: str, ts: str, gap: str = "180 seconds", late: str = "1 hour") -> DataFrame:
    """Runs of events of one key with pauses of at most ``gap``, closed when the watermark passes them."""
    source = events.withColumn(ts, F.col(ts).cast("timestamp"))
    source = source.withWatermark(ts, late) if events.isStreaming else source
    return source.groupBy(F.session_window(F.col(ts), gap).alias("w"), F.col(key)).agg(F.count("*").alias("members"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at")).drop("w")


def daily(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts per calendar day and keys."""
    source = events.withColumn(ts, F.col(ts).cast("timestamp"))
    source = source.withWatermark(ts, late) if events.isStreaming else source
    return source.groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), *keys, "n")


def deduplicated(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Events once per key, as re-imports repeat them."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert_sink(merge: Callable[[DataFrame, DataFrame | None], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into the newest version below ``path``.

    A version is written whole under its batch's number before it counts, so a batch that is
    run again after a failure starts from the version before it and gives the same result.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        current = spark.read.parquet(f"{path}/v={number - 1}") if number > 0 else None
        merge(batch, current).write.mode("overwrite").parquet(f"{path}/v={number}")

    return run


def progress(query) -> dict[str, float]:
    """Batches and input rows of a running query."""
    seen = query.recentProgress
    return {"batches": len(seen), "rows": sum(p["numInputRows"] for p in seen)}
