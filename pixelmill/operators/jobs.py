"""Jobs as an event log, and the pipeline's outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a message after which a retry is no use.
PERMANENT = ["no such file", "not found", "unsupported"]


def current(events: DataFrame) -> DataFrame:
    """One row per job: last status and error, first and last times, metrics merged with the later value winning."""
    entries = events.select("id", "seq", F.explode(F.coalesce("metrics", F.create_map().cast("map<string,string>"))).alias("k", "v"))
    merged = entries.groupBy("id", "k").agg(F.max_by("v", "seq").alias("v")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metrics"))
    base = events.groupBy("id").agg(
        F.first("job_type", ignorenulls=True).alias("job_type"), F.max_by("status", "seq").alias("status"), F.max_by("error_msg", "seq").alias("error_msg"), F.min("at").alias("created_at"),
        F.min(F.when(F.col("status") == "RUNNING", F.col("at"))).alias("started_at"), F.max(F.when(F.col("status").isin("COMPLETED", "FAILED", "RETRYABLE"), F.col("at"))).alias("finished_at"),
    )
    return base.join(merged, "id", "left")


def failure_status(message: Column) -> Column:
    lowered = F.lower(F.coalesce(message, F.lit("")))
    hopeless = F.lit(False)
    for part in PERMANENT:
        hopeless = hopeless | F.contains(lowered, F.lit(part))
    return F.when(hopeless, "FAILED").otherwise("RETRYABLE")


def cleared(jobs: DataFrame, job_type: str | None = None, statuses: list[str] | None = None) -> DataFrame:
    """``jobs`` without those of a type and of given states; without either all go."""
    gone = F.lit(True)
    if job_type:
        gone = gone & (F.col("job_type") == job_type)
    if statuses:
        gone = gone & F.col("status").isin(statuses)
    return jobs.where(~F.coalesce(gone, F.lit(False)))


def newest(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc_nulls_last(), F.desc("id")).limit(limit)


def run_stages(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], log: Callable[[str, str, str | None], None]) -> DataFrame:
    """Run named stages in order and report each one's state; the first failure is reported and raised."""
    for name, stage in stages:
        log(name, "RUNNING", None)
        try:
            df = stage(df)
        except Exception as error:
            log(name, "FAILED" if any(p in str(error).lower() for p in PERMANENT) else "RETRYABLE", str(error))
            raise
        log(name, "COMPLETED", None)
    return df
