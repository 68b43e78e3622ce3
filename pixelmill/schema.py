"""Tables of the catalog and the metadata standard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column lists of the catalog's tables.
TABLES = {
    "assets": "id STRING, source STRING, abs_zip STRING, zip_path STRING, source_kind STRING, source_root STRING, source_locator STRING, source_path STRING, media_type STRING, orig_filename STRING, orig_ext STRING, orig_size BIGINT, dt_original STRING, gps_lat DOUBLE, gps_lon DOUBLE, gps_alt DOUBLE, title STRING, description STRING, user_rating INT, review_score DOUBLE, review_state STRING, favorite INT, ranked_at STRING, keywords ARRAY<STRING>, people ARRAY<STRING>, live_group_id STRING, burst_id STRING, status STRING, target_relpath STRING, target_filename STRING, managed_asset_id STRING, sha256 STRING, last_embed_hash STRING, exiftool_version STRING, last_updated STRING, error_msg STRING, src_mtime STRING, source_dt STRING, source_gps STRING",
    "jobs": "id STRING, job_type STRING, status STRING, config_json STRING, metrics MAP<STRING,STRING>, error_msg STRING, started_at STRING, finished_at STRING, created_at STRING",
    "managed_assets": "id STRING, asset_id STRING, relpath STRING, filename STRING, managed_path STRING, status STRING, built_at STRING, validated_at STRING, error_msg STRING",
    "hashes": "asset_id STRING, algorithm STRING, scope STRING, value STRING, created_at STRING",
    "thumbnails": "asset_id STRING, kind STRING, path STRING, width INT, height INT, status STRING, created_at STRING, error_msg STRING",
    "duplicate_groups": "id STRING, group_type STRING, status STRING, canonical_asset_id STRING, created_at STRING, resolved_at STRING",
    "duplicate_items": "group_id STRING, asset_id STRING, score DOUBLE, rationale STRING, keep_decision STRING",
    "face_identities": "id STRING, label STRING, status STRING, created_at STRING",
    "faces": "id STRING, asset_id STRING, identity_id STRING, embedding_ref STRING, bbox STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>, frame_time_ms INT, status STRING, created_at STRING",
    "embeddings": "id STRING, asset_id STRING, embedding_type STRING, model_name STRING, vector_ref STRING, vector ARRAY<DOUBLE>, payload STRING, created_at STRING",
    "extraction_results": "id STRING, asset_id STRING, result_type STRING, segment_start_ms INT, segment_end_ms INT, text_content STRING, payload STRING, status STRING, created_at STRING",
    "face_clarifications": "face_id STRING, suggested_identity_id STRING, suggested_label STRING, score DOUBLE, rationale STRING, status STRING, created_at STRING, resolved_at STRING",
    "metadata_fields": "asset_id STRING, field_name STRING, source_name STRING, source_field STRING, value_json STRING, value_text STRING, value_real DOUBLE, is_canonical BOOLEAN, confidence DOUBLE, created_at STRING, updated_at STRING",
    "artifacts": "asset_id STRING, artifact_type STRING, path STRING, status STRING, created_at STRING, error_msg STRING",
    "review_decisions": "id STRING, asset_id STRING, decision_type STRING, value_json STRING, created_at STRING",
    "mutation_history": "seq BIGINT, action_type STRING, target_id STRING, summary STRING, before_json STRING, after_json STRING, created_at STRING, undone_at STRING, redone_at STRING",
    "saved_searches": "id STRING, label STRING, params_json STRING, created_at STRING, updated_at STRING",
}
#: States a row may be in.
STATES = {
    "jobs": ["QUEUED", "RUNNING", "COMPLETED", "FAILED", "RETRYABLE"],
    "managed_assets": ["PLANNED", "BUILT", "MISSING", "FAILED"],
    "assets": ["NEW", "EMBEDDED", "COPIED", "ERROR"],
    "duplicate_groups": ["OPEN", "RESOLVED", "KEPT_ALL", "SKIPPED"],
    "faces": ["DETECTED", "CLUSTERED", "LABELED", "REVIEW", "REJECTED"],
    "face_identities": ["UNCONFIRMED", "CLUSTERED", "CONFIRMED"],
    "face_clarifications": ["OPEN", "RESOLVED", "DISMISSED"],
}
_ALL, _VIDEO, _STILL = ["image", "raw", "video"], ["video"], ["image", "raw"]
#: The metadata standard as (field, label, weight, media types it applies to).
STANDARD = [
    ("captured_at", "Captured Time", 24, _ALL),
    ("captured_at_utc", "Captured Time (UTC)", 8, _ALL),
    ("timezone_name", "Timezone", 6, _ALL),
    ("location", "Location", 18, _ALL),
    ("title", "Title", 6, _ALL),
    ("description", "Description", 6, _ALL),
    ("keywords", "Keywords", 6, _ALL),
    ("people", "People", 12, _ALL),
    ("camera_make", "Camera Make", 5, _ALL),
    ("camera_model", "Camera Model", 5, _ALL),
    ("software", "Software", 3, _ALL),
    ("pixel_width", "Width", 3, _ALL),
    ("pixel_height", "Height", 3, _ALL),
    ("format", "Format", 3, _ALL),
    ("duration_seconds", "Duration", 7, _VIDEO),
    ("frame_rate", "Frame Rate", 4, _VIDEO),
    ("bitrate", "Bitrate", 3, _VIDEO),
    ("video_codec", "Video Codec", 4, _VIDEO),
    ("audio_codec", "Audio Codec", 3, _VIDEO),
    ("audio_channels", "Audio Channels", 2, _VIDEO),
    ("container_format", "Container", 2, _VIDEO),
    ("encoder", "Encoder", 2, _VIDEO),
    ("mime_type", "MIME Type", 2, _ALL),
    ("lens_model", "Lens Model", 4, _STILL),
]
#: How far each metadata source is trusted.
CONFIDENCE = {
    "embedded_metadata": 0.97, "image_exif": 0.96, "source_read": 0.95, "apple_csv": 0.92, "sidecar_metadata": 0.9,
    "metadata_repair": 0.88, "paired_metadata": 0.72, "screenshot_detector": 0.8, "face_label": 0.98,
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the table's columns; those it lacks are null."""
    schema = T._parse_datatype_string(TABLES[table])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def valid_state(table: str, status: Column) -> Column:
    return status.isin(STATES[table])


def standard(spark: SparkSession, media_type: str | None = None) -> DataFrame:
    """The standard's 24 rows, or those that apply to one media type."""
    df = spark.createDataFrame(STANDARD, "field_name string, label string, weight int, media_types array<string>")
    return df if media_type is None else df.where(F.array_contains("media_types", media_type))


def confidence(source: Column, field: Column, paired: Column | bool = False) -> Column:
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), source), F.lit(0.7))
    base = F.when((source == "sidecar_metadata") & field.isin("title", "description", "keywords"), 0.94).otherwise(base)
    base = F.when((source == "apple_csv") & field.isin("captured_at", "captured_at_utc", "timezone_name"), 0.95).otherwise(base)
    return F.when(F.lit(paired) if isinstance(paired, bool) else paired, F.least(base, F.lit(0.72))).otherwise(base)
