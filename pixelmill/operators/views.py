"""Read views of the catalog: records with what belongs to them, work queues and overviews.

Views over many assets are joins that Spark plans; those of one asset are filters that reach
the scan.  Where an asset has several previews the one of the best kind stands, then the first path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import text, timex

#: Kinds of previews, best first, and the one that a media type needs.
PREVIEWS = ["primary", "video_preview"]
NEEDED = {"image": "primary", "raw": "primary", "video": "video_preview"}


def _rank(kind: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PREVIEWS)), kind), F.lit(0)), F.lit(len(PREVIEWS) + 1))


def previews(thumbnails: DataFrame, ready: bool = False) -> DataFrame:
    """(asset_id, thumbnail_path): one preview an asset; ``ready``: of any kind, but only such as are READY."""
    shown = thumbnails.where("status = 'READY'") if ready else thumbnails.where(F.col("kind").isin(PREVIEWS))
    return shown.groupBy("asset_id").agg(F.min_by("path", F.struct(_rank(F.col("kind")), F.col("path"))).alias("thumbnail_path"))


def _with(df: DataFrame, other: DataFrame, on: str = "id", key: str = "asset_id", how: str = "left") -> DataFrame:
    return df.join(other.withColumnRenamed(key, on), on, how)


def asset_records(assets: DataFrame, managed: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Each asset with its managed state, managed path and preview."""
    m = managed.select("asset_id", F.col("status").alias("managed_status"), "managed_path")
    return _with(_with(assets, m), previews(thumbnails))


def geotagged(assets: DataFrame, limit: int = 32) -> DataFrame:
    return assets.where("gps_lat is not null and gps_lon is not null").orderBy(F.col("dt_original").desc_nulls_last(), F.desc("id")).limit(limit)


def fields_of(fields: DataFrame, asset_id) -> DataFrame:
    """An asset's metadata rows in their fixed order, with the decoded value as text."""
    plain = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value_json"), F.lit("}")), "$.v")
    shown = fields.where(F.col("asset_id") == asset_id).withColumn("value", F.coalesce(plain, "value_text", F.col("value_real").cast("string")))
    return shown.orderBy("field_name", F.desc("is_canonical"), F.desc("updated_at"), "source_name", "source_field")


def belonging(rows: DataFrame, asset_id, order: list[str], **equal) -> DataFrame:
    """Rows of one asset (artifacts, embeddings, extraction results), cut to given values where they are given."""
    out = rows.where(F.col("asset_id") == asset_id)
    for column, value in equal.items():
        out = out if value is None else out.where(F.col(column) == value)
    return out.orderBy(*order)


def face_embeddings(faces: DataFrame, embeddings: DataFrame, model_name: str | None = None) -> DataFrame:
    """Faces that aren't rejected with their vectors' rows, of one model if that is given."""
    e = embeddings.where("embedding_type = 'face'")
    e = e if model_name is None else e.where(F.col("model_name") == model_name)
    return faces.where("status <> 'REJECTED'").join(e.select(F.col("id").alias("embedding_ref"), "model_name", "vector"), "embedding_ref")


def face_records(faces: DataFrame, identities: DataFrame, assets: DataFrame, managed: DataFrame, thumbnails: DataFrame, clarifications: DataFrame) -> DataFrame:
    """Each face with its identity's label, its asset and the suggestion made for it."""
    out = faces.join(identities.select(F.col("id").alias("identity_id"), F.col("label").alias("identity_label")), "identity_id", "left")
    out = out.join(assets.select(F.col("id").alias("asset_id"), "orig_filename", "media_type"), "asset_id", "left")
    out = out.join(managed.select("asset_id", "managed_path"), "asset_id", "left").join(previews(thumbnails), "asset_id", "left")
    c = clarifications.select(F.col("face_id").alias("id"), "suggested_identity_id", "suggested_label", F.col("score").alias("clarification_score"), F.col("status").alias("clarification_status"))
    return out.join(c, "id", "left")


def face_listing(records: DataFrame, limit: int = 50, include_rejected: bool = False) -> DataFrame:
    """Faces without an identity first, then the newest, then the largest id."""
    shown = records if include_rejected else records.where("status <> 'REJECTED'")
    return shown.orderBy(F.col("identity_id").isNotNull(), F.desc("created_at"), F.desc("id")).limit(limit)


def suggestions(clarifications: DataFrame, faces: DataFrame, identities: DataFrame, assets: DataFrame, *, status: str = "OPEN", identity_id=None, limit: int = 200) -> DataFrame:
    """Suggestions of a state with face, asset and suggested label, the best first.

    Face ids may repeat: rows of one score, time and face follow by their other columns, larger
    values first, so that the cut at ``limit`` doesn't hang on the order in which rows arrive.
    """
    c = clarifications.where(F.col("status") == status)
    c = c if identity_id is None else c.where(F.col("suggested_identity_id") == identity_id)
    f = faces.select(F.col("id").alias("face_id"), "asset_id", "identity_id", F.col("status").alias("face_status"))
    i = identities.select(F.col("id").alias("suggested_identity_id"), F.col("label").alias("suggested_identity_label"))
    a = assets.select(F.col("id").alias("asset_id"), "orig_filename", "media_type")
    out = c.join(f, "face_id").join(i, "suggested_identity_id", "left").join(a, "asset_id", "left")
    rest = ["identity_id", "suggested_identity_id", *sorted(set(out.columns) - {"score", "created_at", "face_id", "identity_id", "suggested_identity_id"})]
    return out.orderBy(F.desc("score"), F.desc("created_at"), "face_id", *[F.desc_nulls_last(c) for c in rest]).limit(limit)


def group_items(items: DataFrame, group_id, assets: DataFrame, managed: DataFrame, thumbnails: DataFrame, include_hidden: bool = False) -> DataFrame:
    """A duplicate group's members with their assets, the largest first."""
    own = items.where(F.col("group_id") == group_id)
    own = own if include_hidden else own.where("coalesce(keep_decision, '') <> 'HIDE'")
    a = asset_records(assets, managed, thumbnails).withColumnRenamed("id", "asset_id").select("asset_id", "orig_filename", "media_type", "dt_original", "orig_size", "managed_path", "thumbnail_path")
    return own.join(a, "asset_id").orderBy(F.desc("orig_size"), "dt_original", "asset_id")


def tagged(assets: DataFrame, label: str, limit: int = 48, exact: bool = False) -> DataFrame:
    """Assets whose people hold a label: as a part of the list's text without regard to case, or ``exact``: as a whole name."""
    held = F.array_contains(F.transform("people", F.lower), label.lower()) if exact else F.contains(F.lower(F.to_json("people")), F.lit(label.lower()))
    return assets.where(held).orderBy(F.col("dt_original").desc_nulls_last(), F.desc("id")).limit(limit)


# --- work queues ----------------------------------------------------------------------------

_DONE = "status in ('EMBEDDED', 'COPIED')"


def _built(assets: DataFrame, managed: DataFrame, status: str = "status = 'BUILT'") -> DataFrame:
    return _with(assets, managed.where(status).select("asset_id", "managed_path", F.col("status").alias("managed_status")), how="inner")


def built(assets: DataFrame, managed: DataFrame) -> DataFrame:
    return _built(assets, managed).orderBy("dt_original", "id")


def to_build(assets: DataFrame, managed: DataFrame) -> DataFrame:
    """Assets with a target whose copy is planned or failed, or that are new."""
    every = _built(assets, managed, "true").where("target_relpath is not null and target_filename is not null")
    return every.where("managed_status in ('PLANNED', 'FAILED') or status = 'NEW'").orderBy("dt_original", "id")


def count_to_build(assets: DataFrame, managed: DataFrame, limit: int | None = None) -> DataFrame:
    n = to_build(assets, managed).agg(F.count("*").alias("n"))
    return n if limit is None else n.select(F.least("n", F.lit(limit)).alias("n"))


def to_preview(assets: DataFrame, managed: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Finished assets without a ready preview of the kind their media type needs."""
    needs = reduce(lambda a, kv: a.when(F.col("media_type") == kv[0], kv[1]), NEEDED.items(), F.when(F.lit(False), ""))
    ready = thumbnails.where("status = 'READY'").select(F.col("asset_id").alias("id"), F.col("kind").alias("_kind")).distinct()
    return _built(assets.where(_DONE), managed).withColumn("_kind", needs).join(ready, ["id", "_kind"], "left_anti").drop("_kind").orderBy("dt_original", "id")


def to_repair(assets: DataFrame, managed: DataFrame) -> DataFrame:
    return _built(assets.where(_DONE), managed).orderBy("last_updated", "id")


def to_detect(assets: DataFrame, managed: DataFrame, thumbnails: DataFrame, fields: DataFrame, faces: DataFrame, include_existing: bool = False) -> DataFrame:
    """Finished assets without faces, with their preview and canonical duration."""
    out = _with(_built(assets.where(_DONE).where(F.col("media_type").isin(list(NEEDED))), managed), previews(thumbnails))
    duration = fields.where("field_name = 'duration_seconds' and is_canonical").groupBy("asset_id").agg(F.max(text.number_of(F.col("value_real"), F.col("value_text"))).alias("duration_seconds"))
    out = _with(out, duration)
    if not include_existing:
        out = _with(out, faces.select("asset_id").distinct(), how="left_anti")
    return out.orderBy("dt_original", "id")


def saved_searches(searches: DataFrame, limit: int = 20) -> DataFrame:
    return searches.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


# --- overviews ------------------------------------------------------------------------------


def overview(assets: DataFrame, managed: DataFrame, thumbnails: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of counts; each table is counted once."""
    n = lambda c, name: F.count_if(c).alias(name)
    s = F.col("status")
    parts = [
        assets.agg(F.count("*").alias("assets_total"), n(s == "EMBEDDED", "embedded_assets"), n(s == "COPIED", "copied_assets"), n(s == "ERROR", "errored_assets")),
        managed.agg(F.count("*").alias("managed_assets")), thumbnails.agg(n(s == "READY", "ready_thumbnails")), jobs.agg(F.count("*").alias("jobs")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def face_overview(faces: DataFrame, identities: DataFrame, clarifications: DataFrame, strong: int = 3) -> DataFrame:
    """One row of counts of faces, identities and open suggestions."""
    n = lambda c, name: F.count_if(c).alias(name)
    s, known = F.col("status"), F.col("identity_id").isNotNull()
    per_identity = faces.where("status <> 'REJECTED'").groupBy(F.col("identity_id").alias("id")).agg(F.count("*").alias("_n"))
    parts = [
        faces.agg(
            F.count("*").alias("total_faces"), n(~known & (s != "REJECTED"), "unlabeled_faces"), n(known & (s == "CLUSTERED"), "clustered_faces"), n(known & (s == "LABELED"), "labeled_faces"),
            n(s == "REVIEW", "review_faces"), n(s == "REJECTED", "rejected_faces"), F.countDistinct(F.when(s != "REJECTED", F.col("asset_id"))).alias("assets_with_faces"),
        ),
        identities.join(per_identity, "id", "left").agg(
            F.count("*").alias("identities"), n(s == "CONFIRMED", "confirmed_identities"), n(s == "CLUSTERED", "clustered_identities"), n((s == "CLUSTERED") & (F.col("_n") >= strong), "strong_clustered_identities"),
        ),
        clarifications.agg(n(s == "OPEN", "clarifications_open")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def identity_listing(identities: DataFrame, faces: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
    """Identities with their number of faces, most first, then by label."""
    shown = identities if status is None else identities.where(F.col("status") == status)
    n = faces.groupBy(F.col("identity_id").alias("id")).agg(F.count("*").alias("face_count"))
    return shown.join(n, "id", "left").withColumn("face_count", F.coalesce("face_count", F.lit(0))).orderBy(F.desc("face_count"), "label", "id").limit(limit)


def identity_records(identities: DataFrame, faces: DataFrame) -> DataFrame:
    """Identities with distinct faces and assets and the latest face, without rejected ones."""
    stats = faces.where("status <> 'REJECTED'").groupBy(F.col("identity_id").alias("id")).agg(F.countDistinct("id").alias("face_count"), F.countDistinct("asset_id").alias("asset_count"), F.max("created_at").alias("last_seen_at"))
    return identities.join(stats, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("face_count", "asset_count")})


def assets_of(faces: DataFrame, identities: DataFrame, assets: DataFrame, managed: DataFrame, *, label: str | None = None, identity_id=None, limit: int = 48) -> DataFrame:
    """Assets that show a person, by label without regard to case or by identity, the last seen first."""
    who = identities.where(F.lower("label") == label.lower()) if label is not None else identities.where(F.col("id") == identity_id)
    seen = faces.where("status <> 'REJECTED'").join(who.select(F.col("id").alias("identity_id")), "identity_id", "left_semi")
    per_asset = seen.groupBy("asset_id").agg(F.max("created_at").alias("last_seen_at"), F.count("*").alias("face_count"))
    out = _with(_with(assets, per_asset, how="inner"), managed.select("asset_id", "managed_path"))
    return out.orderBy(F.desc("last_seen_at"), F.col("dt_original").desc_nulls_last(), F.desc("id")).limit(limit)


def identity_model(faces: DataFrame, embeddings: DataFrame, identity_id, preferred: str | None) -> DataFrame:
    """The model of an identity's vectors: the preferred one if it has any of that, else the most used, then the first by name."""
    own = face_embeddings(faces.where(F.col("identity_id") == identity_id), embeddings).where("coalesce(model_name, '') <> ''")
    counted = own.groupBy("model_name").agg(F.count("*").alias("n"))
    return counted.orderBy((F.col("model_name") == preferred).desc() if preferred else F.lit(0), F.desc("n"), "model_name").select("model_name").limit(1)


def sequence_score(a: str, b: str) -> Column:
    """How likely rows aliased ``a`` and ``b`` are of one sequence: nothing beyond 180 s, else by gap, origin, day and size."""
    col = lambda t, c: F.col(f"{t}.{c}")
    one, two = (timex.parse_iso(col(t, "dt_original")) for t in (a, b))
    gap = timex.seconds_between(one, two)
    same = lambda c, w: F.when((F.coalesce(col(a, c), F.lit("")) != "") & (col(a, c) == col(b, c)), w).otherwise(0.0)
    sizes = [F.coalesce(col(t, "orig_size"), F.lit(0)).cast("double") for t in (a, b)]
    ratio = F.when((sizes[0] > 0) & (sizes[1] > 0), F.least(*sizes) / F.greatest(*sizes))
    parts = [
        F.lit(0.55), same("source_locator", 0.12), same("source_root", 0.05), F.when(F.to_date(one) == F.to_date(two), 0.05).otherwise(0.0),
        F.when(gap <= 10, 0.15).when(gap <= 30, 0.10).when(gap <= 60, 0.06).otherwise(0.03), F.when(ratio >= 0.95, 0.05).when(ratio >= 0.80, 0.03).otherwise(0.0),
    ]
    return F.when(gap <= 180, F.bround(F.least(reduce(lambda x, y: x + y, parts), F.lit(0.95)), 3)).otherwise(0.0)
