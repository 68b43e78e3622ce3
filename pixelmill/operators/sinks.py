"""Exports: statuses, manifests, summaries and metadata sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import geo


def export_status(source_exists: Column, target_exists: Column, same: Column, overwrite: bool = False) -> Column:
    """missing, skipped (an equal copy is there), failed (another file is) or exported."""
    blocked = F.lit("failed") if not overwrite else F.lit("exported")
    return F.when(~source_exists, "missing").when(target_exists & same, "skipped").when(target_exists, blocked).otherwise("exported")


def manifest(built: DataFrame) -> DataFrame:
    """The export's lines: one JSON text per asset."""
    names = ["asset_id", "orig_filename", "media_type", "dt_original", "sha256", "managed_path", "exported_path", "status"]
    return built.select(F.to_json(F.struct(*[c for c in names if c in built.columns])).alias("value"))


def summary(built: DataFrame) -> DataFrame:
    return built.groupBy("status").agg(F.count("*").alias("n"))


def write_export(built: DataFrame, path: str) -> None:
    """``path/manifest`` as JSON lines and ``path/summary`` as JSON."""
    manifest(built).write.mode("overwrite").text(f"{path}/manifest")
    summary(built).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def sidecars(assets: DataFrame, fields: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(asset_id, payload): canonical values by field, all values with provenance, and artifacts."""
    prov = fields.groupBy("asset_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("is_canonical"), F.struct("field_name", "value_json"))))).alias("normalized"),
        F.array_sort(F.collect_list(F.struct("field_name", "source_name", F.coalesce("source_field", F.lit("")).alias("source_field"), "value_json", "confidence", "is_canonical"))).alias("provenance"),
    )
    made = artifacts.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("artifact_type", "path", "status"))).alias("artifacts"))
    out = assets.select(F.col("id").alias("asset_id"), "source", "source_locator").join(prov, "asset_id", "left").join(made, "asset_id", "left")
    return out.select("asset_id", F.to_json(F.struct("normalized", "provenance", "artifacts", F.struct("source", "source_locator").alias("source"))).alias("payload"))


def build_status(planned: DataFrame, listing: DataFrame) -> DataFrame:
    """Planned assets against the files that exist: BUILT, or MISSING; a path that is listed more than once counts once."""
    files = listing.select(F.col("path").alias("managed_path")).distinct().withColumn("_f", F.lit(1))
    return planned.join(files, "managed_path", "left").withColumn("status", F.when(F.col("_f") == 1, "BUILT").otherwise("MISSING")).drop("_f")


def tag_arguments(dt: Column, lat: Column, lon: Column, alt: Column, title: Column, keywords: Column, people: Column) -> Column:
    """Tag assignments for a metadata writer: times, place as ISO 6709, title and sorted distinct subjects."""
    when = lambda c, name: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"-{name}="), c))
    stamp = F.replace(F.replace(F.substring(dt, 1, 19), F.lit("-"), F.lit(":")), F.lit("T"), F.lit(" "))
    none = F.array().cast("array<string>")
    subjects = F.array_sort(F.array_distinct(F.concat(F.coalesce(keywords, none), F.coalesce(people, none))))
    place = F.when(lat.isNotNull() & lon.isNotNull(), geo.to_iso6709(lat, lon, alt))
    return F.concat(F.array_compact(F.array(when(stamp, "DateTimeOriginal"), when(stamp, "CreateDate"), when(place, "GPSCoordinates"), when(title, "Title"))), F.transform(subjects, lambda s: F.concat(F.lit("-Subject="), s)))
