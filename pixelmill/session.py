"""Session factory and the shared work folder.

Intermediate tables and checkpoints go to the folder that the cluster names in
``spark.checkpoint.dir``; a folder of this process is used only where that
setting is absent, which is the case in local tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pixelmill")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a new one if that is unset and the master local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pixelmill-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/pixelmill-{name}-{uuid.uuid4().hex}"


#: Bytes of a row group of a staged table; a writer holds one in memory.
ROW_GROUP = 16 << 20


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage so that a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have an intermediate table removed when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """For each of ``names`` one that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_of(df: DataFrame, *without: str) -> Column:
    """All columns of ``df`` in one struct, so that working columns beside it can't clash with their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without])


def from_row(row: str, columns: list[str]) -> list[Column]:
    """The columns that ``row_of`` has put into ``row``."""
    return [F.col(f"{row}.`{c}`").alias(c) for c in columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int | None:
    """Bytes that ``df`` reads, as the optimizer reckons them; None where it doesn't know."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else None


def slots(df: DataFrame, size: int, most: int = 8192) -> int:
    """Tasks to deal ``df`` to, about ``size`` bytes of its input each: the shuffle partitions, more for a large input."""
    return max(shuffle_partitions(df.sparkSession), min(most, (input_bytes(df) or 0) // size))


def read_together(df: DataFrame, size: int) -> DataFrame:
    """``df`` with tiny splits read by one task, about ``size`` bytes each where there are more than cores."""
    known = input_bytes(df)
    return df if known is None else df.coalesce(min(1 << 30, max(df.sparkSession.sparkContext.defaultParallelism, known // size)))


def slot_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions an integer that Spark's hash partitioning sends there.

    ``repartition(n, key)`` over these keys deals exactly one key to each task, where
    plain consecutive integers would leave some tasks empty and give others several.
    """
    span, keys = max(64, int(n * (6 + 2 * len(str(n))))), {}
    while len(keys) < n:
        rows = (
            spark.range(span, numPartitions=1)
            .select(F.col("id").cast("int").alias("k"))
            .groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("slot"))
            .agg(F.min("k").alias("k"))
            .collect()
        )
        keys, span = {r["slot"]: r["k"] for r in rows}, 2 * span
    return [keys[i] for i in range(n)]
