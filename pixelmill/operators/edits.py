"""Edits of the catalog as whole-table plans: each takes tables and sets of changes and returns the tables after them.

A set of changes is a DataFrame with one row per key, so many edits cost one join.  What a
change does not name stays; applying the same changes again changes nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators import metadata


def _set(df: DataFrame, where: Column, **values) -> DataFrame:
    """``df`` with columns set where a condition holds."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def _set_by_key(df: DataFrame, key: str, changes: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns set in rows whose ``key`` is in ``changes``; values may name the change's columns as ``c.x``."""
    joined = df.alias("t").join(changes.alias("c"), F.col(f"t.{key}") == F.col("c.asset_id"), "left")
    hit = F.col("c.asset_id").isNotNull()
    return joined.select(*[F.when(hit, values[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in values else F.col(f"t.{c}") for c in df.columns])


def replaced(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of all rows that have one of their keys (hashes, thumbnails, artifacts, embeddings)."""
    return table.join(rows.select(keys).distinct(), keys, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


# --- states of assets -----------------------------------------------------------------------


def mark_done(assets: DataFrame, managed: DataFrame, hashes: DataFrame, done: DataFrame, status: str, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assets embedded or copied: (assets, managed, hashes) with status, hash and build time; ``done``: asset_id, sha256, embed_hash, tool_version, warning."""
    own = {"sha256": F.col("c.sha256"), "exiftool_version": F.col("c.tool_version"), "status": F.lit(status), "last_updated": F.lit(at), "error_msg": F.col("c.warning")}
    if status == "EMBEDDED":
        own |= {"last_embed_hash": F.col("c.embed_hash"), "error_msg": F.lit(None).cast("string")}
    note = own["error_msg"]
    new = done.select("asset_id", F.lit("sha256").alias("algorithm"), F.lit("managed").alias("scope"), F.col("sha256").alias("value"), F.lit(at).alias("created_at"))
    return _set_by_key(assets, "id", done, **own), _set_by_key(managed, "asset_id", done, status=F.lit("BUILT"), built_at=F.lit(at), error_msg=note), replaced(hashes, new, ["asset_id", "algorithm", "scope"])


def update_status(assets: DataFrame, managed: DataFrame, changes: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Status and error of assets (asset_id, status, error); an ERROR fails the managed copy too."""
    bad = changes.where("status = 'ERROR'")
    return (
        _set_by_key(assets, "id", changes, status=F.col("c.status"), error_msg=F.col("c.error"), last_updated=F.lit(at)),
        _set_by_key(managed, "asset_id", bad, status=F.lit("FAILED"), error_msg=F.col("c.error")),
    )


def update_locators(assets: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    return _set_by_key(assets, "id", changes, source_locator=F.col("c.source_locator"), last_updated=F.lit(at))


# --- identities and faces -------------------------------------------------------------------


def create_identities(identities: DataFrame, labels: DataFrame, at: str, status: str = "CONFIRMED") -> DataFrame:
    """``identities`` with one for each label (id, label) that none has yet, without regard to case."""
    known = identities.select(F.lower("label").alias("_fold")).distinct()
    new = labels.groupBy(F.lower("label").alias("_fold")).agg(F.min_by(F.struct("id", "label"), "id").alias("r")).join(known, "_fold", "left_anti")
    return identities.unionByName(new.select("r.id", "r.label", F.lit(status).alias("status"), F.lit(at).alias("created_at")))


def rename_identity(identities: DataFrame, identity_id, label: str, status: str = "CONFIRMED") -> DataFrame:
    return _set(identities, F.col("id") == identity_id, label=label, status=status)


def merge_identities(identities: DataFrame, faces: DataFrame, clarifications: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Identities merged along (source, target): faces and suggestions point to the target, sources go; unknown ids and loops are left out."""
    ids = identities.select(F.col("id"))
    real = mapping.where("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")

    def pointed(df: DataFrame, key: str) -> DataFrame:
        to = real.select(F.col("source").alias(key), F.col("target").alias("_to"))
        return df.join(to, key, "left").withColumn(key, F.coalesce("_to", key)).select(df.columns)

    return identities.join(real.select(F.col("source").alias("id")), "id", "left_anti").select(identities.columns), pointed(faces, "identity_id"), pointed(clarifications, "suggested_identity_id")


def assign(identities: DataFrame, faces: DataFrame, clarifications: DataFrame, face_id, identity_id, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A face named: its whole former cluster, if it has one, goes to the identity; all are LABELED and the suggestion is RESOLVED."""
    was = faces.where((F.col("id") == face_id) & F.col("identity_id").isNotNull() & (F.col("identity_id") != identity_id)).select(F.col("identity_id").alias("source"), F.lit(identity_id).alias("target"))
    identities, faces, _ = merge_identities(identities, faces, clarifications, was)
    faces = _set(faces, F.col("id") == face_id, identity_id=identity_id)
    return identities, apply_identity(faces, identity_id), resolve(clarifications, face_id, "RESOLVED", at)


def apply_identity(faces: DataFrame, identity_id) -> DataFrame:
    return _set(faces, (F.col("identity_id") == identity_id) & (F.col("status") != "REJECTED"), status="LABELED")


def cluster_faces(faces: DataFrame, clusters: DataFrame, labeled: bool = False) -> DataFrame:
    """Faces put into identities along (asset_id: the face's id, identity_id)."""
    return _set_by_key(faces, "id", clusters, identity_id=F.col("c.identity_id"), status=F.lit("LABELED" if labeled else "CLUSTERED"))


def resolve(clarifications: DataFrame, face_id, status: str, at: str) -> DataFrame:
    return _set(clarifications, F.col("face_id") == face_id, status=status, resolved_at=at)


def reject(faces: DataFrame, clarifications: DataFrame, face_id, at: str) -> tuple[DataFrame, DataFrame]:
    return _set(faces, F.col("id") == face_id, status="REJECTED", identity_id=F.lit(None)), resolve(clarifications, face_id, "DISMISSED", at)


def dismiss(faces: DataFrame, clarifications: DataFrame, face_id, at: str) -> tuple[DataFrame, DataFrame]:
    """A suggestion turned down; a face without an identity is only DETECTED again."""
    return _set(faces, (F.col("id") == face_id) & F.col("identity_id").isNull(), status="DETECTED"), resolve(clarifications, face_id, "DISMISSED", at)


def suggest(faces: DataFrame, clarifications: DataFrame, new: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Suggestions (face_id, suggested_identity_id, suggested_label, score, rationale) opened, in place of older ones; their faces go to REVIEW."""
    rows = new.withColumns({"status": F.lit("OPEN"), "created_at": F.lit(at), "resolved_at": F.lit(None).cast("string")})
    return _set_by_key(faces, "id", new.select(F.col("face_id").alias("asset_id")), status=F.lit("REVIEW")), replaced(clarifications, rows, ["face_id"])


def people_fields(faces: DataFrame, identities: DataFrame) -> DataFrame:
    """Metadata rows that faces give: one people value per asset and identity, from faces that aren't rejected."""
    seen = faces.where("status <> 'REJECTED'").select("asset_id", "identity_id").distinct()
    named = seen.join(identities.select(F.col("id").alias("identity_id"), "label"), "identity_id")
    return named.select("asset_id", F.lit("people").alias("field_name"), F.lit("face_label").alias("source_name"), F.col("identity_id").cast("string").alias("source_field"), F.to_json(F.array("label")).alias("value_json"))


def synced_people(fields: DataFrame, faces: DataFrame, identities: DataFrame) -> DataFrame:
    """(asset_id, people): every people value of an asset, those of its faces as they are now."""
    kept = fields.where("field_name = 'people' and source_name <> 'face_label'").select("asset_id", "value_json", F.lit(0).alias("ord"))
    rows = kept.unionByName(people_fields(faces, identities).select("asset_id", "value_json", F.lit(1).alias("ord")))
    return metadata.synced_labels(rows.select("asset_id", "ord", F.from_json("value_json", "array<string>").alias("labels")))


def replace_faces(faces: DataFrame, fields: DataFrame, detected: DataFrame, assets_done: DataFrame, at: str, source_name: str = "insightface") -> tuple[DataFrame, DataFrame]:
    """(faces, fields) after new detections of some assets: old faces go, and with them the people values of their identities."""
    gone = faces.join(assets_done, "asset_id", "left_semi")
    old = gone.where("identity_id is not null").select("asset_id", F.lit("people").alias("field_name"), F.lit("face_label").alias("source_name"), F.col("identity_id").cast("string").alias("source_field")).distinct()
    left = fields.join(old, ["asset_id", "field_name", "source_name", "source_field"], "left_anti").select(fields.columns)
    values = {"identity_id": F.lit(None), "status": F.lit("DETECTED"), "created_at": F.lit(at), "embedding_ref": F.coalesce("embedding_ref", F.lit(source_name)) if "embedding_ref" in detected.columns else F.lit(source_name)}
    new = detected.select(*[(values[c] if c in values else F.col(c) if c in detected.columns else F.lit(None)).cast(faces.schema[c].dataType).alias(c) for c in faces.columns])
    return faces.join(assets_done, "asset_id", "left_anti").select(faces.columns).unionByName(new), left


def replace_groups(groups: DataFrame, items: DataFrame, group_type: str, new_groups: DataFrame, new_items: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(groups, items) with all groups of a type replaced by open ones; ``new_groups``: id, canonical_asset_id; ``new_items``: group_id, asset_id, score, rationale."""
    old = groups.where(F.col("group_type") == group_type).select(F.col("id").alias("group_id"))
    rows = new_groups.select("id", F.lit(group_type).alias("group_type"), F.lit("OPEN").alias("status"), "canonical_asset_id", F.lit(at).alias("created_at"), F.lit(None).cast("string").alias("resolved_at"))
    marked = new_items.join(new_groups.select(F.col("id").alias("group_id"), "canonical_asset_id"), "group_id").withColumn("keep_decision", F.when(F.col("asset_id") == F.col("canonical_asset_id"), "CANONICAL"))
    return groups.where(F.col("group_type") != group_type).unionByName(rows.select(groups.columns)), items.join(old, "group_id", "left_anti").select(items.columns).unionByName(marked.select(items.columns))


def save_searches(searches: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """Saved searches (id, label, params_json) added or updated; the first time of saving stays."""
    old = searches.select("id", F.col("created_at").alias("_first"))
    rows = new.join(old, "id", "left").withColumns({"created_at": F.coalesce("_first", F.lit(at)), "updated_at": F.lit(at)})
    return replaced(searches, rows, ["id"])


def restored(table: DataFrame, snapshots: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``table`` with chosen columns as journal snapshots (target_id, snapshot) have them; rows without one stay as they are."""
    kinds = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in columns)
    s = snapshots.where("snapshot is not null").select(F.col("target_id").alias("asset_id"), F.from_json("snapshot", kinds).alias("s"))
    return _set_by_key(table, key, s, **{c: F.col(f"c.s.`{c}`") for c in columns})
