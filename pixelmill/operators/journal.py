"""Journal of edits as an append-only event log; undo, redo and restore are folds over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record(journal: DataFrame, entry: DataFrame) -> DataFrame:
    """Append an entry with the next seq; what was undone can no longer be redone."""
    top = journal.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
    numbered = entry.join(F.broadcast(top)).withColumn("seq", F.col("_top") + 1).drop("_top")
    return journal.where("undone_at is null").unionByName(numbered, allowMissingColumns=True)


def status(journal: DataFrame) -> DataFrame:
    """(undo_seq, redo_seq): the entries that undo and redo would take; redo takes the lowest undone one."""
    return journal.agg(F.max(F.when(F.col("undone_at").isNull(), F.col("seq"))).alias("undo_seq"), F.min(F.when(F.col("undone_at").isNotNull(), F.col("seq"))).alias("redo_seq"))


def undo(journal: DataFrame, at: str) -> DataFrame:
    head = F.broadcast(status(journal))
    hit = F.col("seq") == F.col("undo_seq")
    return journal.join(head).withColumns({"undone_at": F.when(hit, F.lit(at)).otherwise(F.col("undone_at"))}).select(journal.columns)


def redo(journal: DataFrame, at: str) -> DataFrame:
    head = F.broadcast(status(journal))
    hit = F.col("seq") == F.col("redo_seq")
    return journal.join(head).withColumns({"redone_at": F.when(hit, F.lit(at)).otherwise(F.col("redone_at")), "undone_at": F.when(hit, None).otherwise(F.col("undone_at"))}).select(journal.columns)


def restore_to(journal: DataFrame, seq: int, at: str) -> DataFrame:
    """Undo all active entries later than ``seq``."""
    later = (F.col("seq") > seq) & F.col("undone_at").isNull()
    return journal.withColumn("undone_at", F.when(later, F.lit(at)).otherwise(F.col("undone_at")))


def state(journal: DataFrame) -> DataFrame:
    """(target_id, snapshot): each target after its last active entry, or before its first if all are undone."""
    active = F.when(F.col("undone_at").isNull(), F.col("seq"))
    found = journal.groupBy("target_id").agg(F.max_by("after_json", active).alias("_after"), F.max(active).alias("_seq"), F.min_by("before_json", "seq").alias("_before"))
    return found.select("target_id", F.when(F.col("_seq").isNotNull(), F.col("_after")).otherwise(F.col("_before")).alias("snapshot"))


def history(journal: DataFrame, limit: int = 8) -> DataFrame:
    return journal.orderBy(F.desc("seq")).limit(limit)


def snapshot(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(key, json) of chosen columns, as journal entries keep it."""
    return df.select(key, F.to_json(F.struct(*columns)).alias("json"))
