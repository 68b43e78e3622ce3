"""Scans of folders, files and ZIP archives into one record shape, with sidecars joined in by name.

Files are listed by Spark's ``binaryFile`` reader (which can list without reading); archives are
opened in Arrow batches, each giving the members' names, sizes and times and the content of the
small JSON and CSV members that describe others.  Sidecars, CSV times and histories are joins.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelmill.functions import geo, text, timex
from pixelmill.sources import nested

SIDE_TEXT = 4 << 20  # bytes of a describing member that are read
MEMBERS = "archive string, member string, size bigint, mtime string, content string"


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, mtime) of all files below ``paths``, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(F.col("path"), F.col("length").alias("size"), timex.iso(F.col("modificationTime")).alias("mtime"))


def archive_members(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per member of the ZIP archives at ``paths``; a damaged archive gives one row without a member."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(paths)

    def members(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf.path, pdf.content):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                side = m.filename.lower().endswith((".json", ".csv")) and m.file_size <= SIDE_TEXT
                                rows.append((path, m.filename, m.file_size, "%04d-%02d-%02dT%02d:%02d:%02d" % m.date_time, z.read(m).decode("utf-8", "replace") if side else None))
                except zipfile.BadZipFile:
                    rows = [(path, None, None, None, None)]
                yield pd.DataFrame(rows, columns=["archive", "member", "size", "mtime", "content"])

    return files.select("path", "content").mapInPandas(members, MEMBERS)


def joined_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``media`` (path) with the parsed fields of its first existing sidecar (name, content) as ``side``."""
    places = media.select("path", F.posexplode(text.sidecar_names(F.col("path"))).alias("rank", "name"))
    hit = places.join(sidecars, "name").groupBy("path").agg(F.min_by("content", "rank").alias("_json"))
    return media.join(hit, "path", "left").withColumn("side", nested.sidecar(F.col("_json"))).drop("_json")


def csv_times(spark: SparkSession, sheets: DataFrame, last_wins: bool = True) -> DataFrame:
    """(name, dt) from CSV texts (sheet, content) with image names and creation dates; of equal names the last (or first) row counts."""
    lines = sheets.select("sheet", F.posexplode(F.split("content", r"\r?\n")).alias("line", "raw")).where("line > 0 and trim(raw) <> ''")
    cells = lines.withColumn("c", F.from_csv("raw", "imgName string, fileChecksum string, favorite string, hidden string, deleted string, originalCreationDate string"))
    parsed = cells.select(F.lower("c.imgName").alias("name"), timex.from_local_text(F.col("c.originalCreationDate")).alias("dt"), F.struct("sheet", "line").alias("at")).where("dt is not null")
    pick = F.max_by if last_wins else F.min_by
    return parsed.groupBy("name").agg(pick("dt", "at").alias("dt"))


def history_rows(histories: DataFrame) -> DataFrame:
    """Rows of history JSON texts (export, content): captured_at, captured_date, media_type, location, raw."""
    schema = 'array<struct<`Date`: string, `Media Type`: string, `Location`: string>>'
    rows = histories.select("export", F.explode(F.from_json(F.get_json_object("content", "$['Saved Media']"), schema)).alias("r"))
    ts = timex.from_history_text(F.col("r.Date"))
    return rows.select("export", timex.iso(ts).alias("captured_at"), F.date_format(ts, "yyyy-MM-dd").alias("captured_date"), F.lower("r.`Media Type`").alias("media_type"), geo.parse_location(F.col("r.Location")).alias("location"), F.to_json("r").alias("raw"))


def history_joined(members: DataFrame, history: DataFrame) -> DataFrame:
    """Main media of an export with the history row of the same rank: n-th file of a day and type, n-th row by descending time."""
    main = members.where(text.history_main(F.col("member")))
    ext = F.lower(F.regexp_extract("member", r"\.([^.]+)$", 1))
    main = main.withColumns({"captured_date": F.regexp_extract("member", r"^memories/(\d{4}-\d{2}-\d{2})_", 1), "media_type": F.when(ext.isin("mp4", "mov"), "video").otherwise("image")})
    keys = ["export", "captured_date", "media_type"]
    files = main.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("member")))
    rows = history.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("captured_at"), F.desc("raw"))))
    return files.join(rows.select(*keys, "rank", "captured_at", "location"), [*keys, "rank"], "left")


def row_at(history: DataFrame, stamp: str) -> DataFrame:
    return history.where(F.substring("captured_at", 1, 19) == stamp.replace("+00:00", "Z")[:19]).orderBy("captured_at", "raw").limit(1)


def longest_prefix(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` (path) with the context (dt) of the longest root that is a folder above them, looked up by relative path.

    Every folder above a file is one candidate key, so this is an equi-join, not a scan of all roots.
    """
    parts = F.split(F.lower("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    keyed = files.select("path", F.explode(above).alias("root")).withColumn("relpath", text.relative_path(F.expr("substr(path, length(root) + 1)")))
    owner = keyed.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by(F.struct("root", "relpath"), F.length("root")).alias("o"))
    found = owner.select("path", "o.root", "o.relpath").join(roots, ["root", "relpath"])
    return files.join(found.select("path", "dt"), "path", "left")


def records(files: DataFrame, source: str | None = None) -> DataFrame:
    """Scan records of listed files or members (locator, path, size, mtime, optional side and csv_dt)."""
    side = (lambda c: F.col(f"side.{c}")) if "side" in files.columns else (lambda c: F.lit(None).cast("string" if c in ("title", "description") else "array<string>" if c == "people" else "double"))
    local = F.col("csv_dt") if "csv_dt" in files.columns else F.lit(None).cast("timestamp_ntz")
    name = text.file_name(F.col("path"))
    ext = text.extension(F.col("path"))
    provider = F.lit(source) if source else text.provider(F.col("path"))
    by_name = timex.from_filename(text.stem(F.col("path")))
    zone = F.col("zone") if "zone" in files.columns else F.lit(None).cast("string")
    chosen = timex.canonical_time(by_name, local, F.lit(None).cast("timestamp_ntz"), side("epoch").cast("long"), zone)
    how = F.when(by_name.isNotNull() & zone.isNull(), "filename").when(local.isNotNull(), "apple_csv").when(side("epoch").isNotNull(), "google_epoch").when(by_name.isNotNull(), "filename").otherwise("file_mtime")
    return files.select(
        text.row_id(provider, F.col("locator"), F.col("path")).alias("id"), provider.alias("source"), F.col("locator").alias("source_locator"), F.col("path").alias("source_path"), text.media_type(ext).alias("media_type"),
        name.alias("orig_filename"), ext.alias("orig_ext"), F.col("size").alias("orig_size"), F.coalesce(chosen, F.col("mtime")).alias("dt_original"), side("lat").alias("gps_lat"), side("lon").alias("gps_lon"), side("alt").alias("gps_alt"),
        side("title").alias("title"), side("description").alias("description"), side("people").alias("people"), F.col("mtime").alias("src_mtime"), how.alias("source_dt"), F.when(side("lat").isNotNull(), "sidecar").alias("source_gps"),
    ).where("media_type <> 'other'")


def recent_sample(scanned: DataFrame, k: int) -> DataFrame:
    """The ``k`` images and videos modified last."""
    return scanned.where("media_type in ('image', 'video')").orderBy(F.col("src_mtime").desc_nulls_last(), F.desc("source_locator")).limit(k)


def repeats(names: DataFrame, column: str) -> DataFrame:
    """Lower-cased base names that occur more than once, and how often."""
    return names.groupBy(F.lower(text.file_name(F.col(column))).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def repeat_totals(names: DataFrame, column: str) -> DataFrame:
    return repeats(names, column).agg(F.count("*").alias("repeat_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeat_extras"))


def relocated(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Assets whose locator is gone, with the first listed file of the same base name instead."""
    there = files.select(F.col("path").alias("source_locator"), F.lit(1).alias("_f"))
    by_name = files.groupBy(F.lower(text.file_name(F.col("path"))).alias("_name")).agg(F.min("path").alias("_path"))
    out = assets.join(there, "source_locator", "left").withColumn("_name", F.lower(text.file_name(F.col("source_locator")))).join(by_name, "_name", "left")
    return out.withColumn("source_locator", F.when(F.col("_f") == 1, F.col("source_locator")).otherwise(F.coalesce("_path", "source_locator"))).select(assets.columns)
