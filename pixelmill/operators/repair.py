"""Metadata repair: ranked sources, then propagation among variants of one shot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill import schema
from pixelmill.operators.metadata import paired


def repaired(assets: DataFrame, sources: list[tuple[str, DataFrame]], columns: list[str], pair: bool = True, name_col: str = "orig_filename") -> DataFrame:
    """``assets`` (id, name) with each column from the first source that has it, and the source's name and confidence.

    ``sources`` are (name, frame keyed by id) in order of precedence; columns that none has come,
    with the lower confidence of paired data, from another variant of the same shot.
    """
    out = assets.select("id", name_col)
    for name, df in sources:
        renamed = df.select("id", *[(F.col(c) if c in df.columns else F.lit(None)).alias(f"{name}.{c}") for c in columns])
        out = out.join(renamed, "id", "left")
    for c in columns:
        parts = [F.col(f"`{name}.{c}`") for name, _ in sources]
        out = out.withColumn(c, F.coalesce(*parts))
        out = out.withColumn(f"{c}_from", F.coalesce(*[F.when(p.isNotNull(), F.lit(name)) for p, (name, _) in zip(parts, sources)]))
    out = out.drop(*[f"{name}.{c}" for name, _ in sources for c in columns])
    if pair:
        out = paired(out, name_col, columns, [F.col("id")])
        for c in columns:
            out = out.withColumn(f"{c}_from", F.when(F.col(f"{c}_from").isNull() & F.col(c).isNotNull(), "paired_metadata").otherwise(F.col(f"{c}_from")))
    for c in columns:
        out = out.withColumn(f"{c}_confidence", F.when(F.col(f"{c}_from").isNotNull(), schema.confidence(F.col(f"{c}_from"), F.lit(c))))
    return out
