"""Keyed upsert, metadata events and their canonical value, target paths and label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions import text, timex

#: Columns that a re-import always overwrites, even with null.
OVERWRITTEN = ["media_type", "orig_filename", "orig_ext", "orig_size", "src_mtime", "last_updated"]
LISTS = ["keywords", "people"]


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", overwritten: list[str] = OVERWRITTEN, kept: tuple[str, ...] = ("status",)) -> DataFrame:
    """Merge ``incoming`` into ``existing``: new values win where they are given, some columns always.

    ``kept`` columns stay as they are once set; empty lists count as not given.  ``incoming``
    must hold one row per key; merging the same rows again changes nothing.
    """
    e, i = existing.alias("e"), incoming.alias("i")

    def merged(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"e.{c}").alias(c)
        old, new = F.col(f"e.{c}"), F.col(f"i.{c}")
        if c in kept:
            return F.coalesce(old, new).alias(c)
        if c in overwritten:
            return F.when(F.col(f"i.{key}").isNotNull(), new).otherwise(old).alias(c)
        if c in LISTS:
            return F.coalesce(F.when(F.size(new) > 0, new), old).alias(c)
        return F.coalesce(new, old).alias(c)

    return e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full_outer").select(*[F.coalesce(F.col(f"i.{key}"), F.col(f"e.{key}")).alias(key) if c == key else merged(c) for c in existing.columns])


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed replacement of an append log: the last row of each key stands."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")


def ingest_fields(assets: DataFrame) -> DataFrame:
    """Each asset's record as metadata rows; values that hold nothing give none."""
    provider = F.coalesce("source", F.lit("unknown"))
    loc = F.when(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull(), F.to_json(F.struct(F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"), F.col("gps_alt").alias("alt"))))
    js = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    lists = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.to_json(c))
    rows = [
        ("provider", js(provider), "ingest", F.lit("source"), False), ("media_type", js(F.col("media_type")), "ingest", F.lit("media_type"), False),
        ("original_filename", js(F.col("orig_filename")), "ingest", F.lit("orig_filename"), False), ("original_extension", js(F.col("orig_ext")), "ingest", F.lit("orig_ext"), False),
        ("original_size_bytes", F.col("orig_size").cast("string"), "ingest", F.lit("orig_size"), False), ("captured_at", js(F.col("dt_original")), "canonical", F.coalesce("source_dt", F.lit("unknown")), True),
        ("source_modified_at", js(F.col("src_mtime")), "ingest", F.lit("src_mtime"), False), ("location", loc, "canonical", F.coalesce("source_gps", F.lit("unknown")), True),
        ("title", js(F.col("title")), "canonical", provider, True), ("description", js(F.col("description")), "canonical", provider, True),
        ("keywords", lists(F.col("keywords")), "canonical", provider, True), ("people", lists(F.col("people")), "canonical", provider, True),
    ]
    entries = F.array(*[F.struct(F.lit(n).alias("field_name"), v.alias("value_json"), F.lit(s).alias("source_name"), f.alias("source_field"), F.lit(c).alias("is_canonical")) for n, v, s, f, c in rows])
    return assets.select(F.col("id").alias("asset_id"), F.explode(entries).alias("m")).select("asset_id", "m.*").where(text.value_present(F.col("value_json")) & (F.col("value_json") != "null"))


def backfill(assets: DataFrame, fields: DataFrame) -> DataFrame:
    """Metadata rows for assets that have none."""
    return ingest_fields(assets.join(fields.select(F.col("asset_id").alias("id")).distinct(), "id", "left_anti"))


def canonical(events: DataFrame, keys: tuple[str, ...] = ("asset_id", "field_name")) -> DataFrame:
    """The canonical value per key after all canonical events (value, confidence, seq), in closed form.

    A newcomer loses only if both confidences are known and the standing one is higher.  So what
    precedes the last event without confidence never matters: it stands itself if it is the
    last event, else the best confidence after it wins, the later among equals.
    """
    cut = F.max(F.when(F.col("confidence").isNull(), F.col("seq")))
    last_null = events.groupBy(*keys).agg(cut.alias("_cut"), F.max("seq").alias("_last"))
    joined = events.join(last_null, list(keys))
    live = joined.where(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut")) | ((F.col("_cut") == F.col("_last")) & (F.col("seq") == F.col("_cut"))))
    best = F.max_by(F.struct("value", "confidence", "seq"), F.struct(F.coalesce("confidence", F.lit(-1.0)), F.col("seq")))
    return live.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def exact_fold(events: DataFrame) -> DataFrame:
    """Replays all events of each (asset, field) in order, non-canonical ones too, in one task per key group.

    ``events``: asset_id, field_name, source_name, source_field, value, is_canonical, confidence,
    seq.  A canonical newcomer demotes the standing value unless that is more confident; an
    event of the same source and field replaces that row, and with it its canonical mark.
    """

    def fold(pdf):
        out = {}
        for r in pdf.sort_values("seq").to_dict("records"):
            key = (r["source_name"] or "", r["source_field"] or "")
            conf = None if r["confidence"] != r["confidence"] else r["confidence"]
            mark = bool(r["is_canonical"])
            standing = next((k for k, v in out.items() if v["is_canonical"]), None)
            if mark and standing is not None:
                old = out[standing]["confidence"]
                if old is not None and conf is not None and old > conf:
                    mark = False
                else:
                    out[standing]["is_canonical"] = False
            out[key] = {"value": r["value"], "confidence": conf, "is_canonical": mark, "seq": r["seq"]}
        rows = [(pdf.asset_id.iloc[0], pdf.field_name.iloc[0], *k, v["value"], v["is_canonical"], v["confidence"], v["seq"]) for k, v in out.items()]
        return type(pdf)(rows, columns=["asset_id", "field_name", "source_name", "source_field", "value", "is_canonical", "confidence", "seq"])

    return events.groupBy("asset_id", "field_name").applyInPandas(fold, "asset_id string, field_name string, source_name string, source_field string, value string, is_canonical boolean, confidence double, seq long")


def set_field(fields: DataFrame, change: DataFrame) -> DataFrame:
    return fields.unionByName(change, allowMissingColumns=True)


def delete_field(fields: DataFrame, asset_id: str, field_name: str, source_name: str | None = None, source_field: str | None = None) -> DataFrame:
    """``fields`` without the rows that match all given key parts."""
    gone = (F.col("asset_id") == asset_id) & (F.col("field_name") == field_name)
    for column, value in (("source_name", source_name), ("source_field", source_field)):
        if value is not None:
            gone = gone & F.col(column).eqNullSafe(value)
    return fields.where(~gone)


def promote(assets: DataFrame, updates: DataFrame) -> DataFrame:
    """Fill dt_original, location, title, description and lists of assets from updates that give them."""
    columns = [c for c in ("dt_original", "gps_lat", "gps_lon", "gps_alt", "title", "description", "keywords", "people") if c in updates.columns]
    u = updates.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    out = assets.join(u, "id", "left")
    for c in columns:
        new = F.when(F.size(f"_{c}") > 0, F.col(f"_{c}")) if c in LISTS else F.col(f"_{c}")
        out = out.withColumn(c, F.coalesce(new, F.col(c)))
    return out.select(assets.columns)


def target_paths(assets: DataFrame) -> DataFrame:
    """(id, target_relpath, target_filename, managed_asset_id) by capture time, file name, modification time or zeros."""
    ts = F.coalesce(timex.parse_iso(F.col("dt_original")), timex.from_filename(text.stem(F.coalesce("orig_filename", F.lit("")))), timex.parse_iso(F.col("src_mtime")))
    shape = lambda p, none: F.coalesce(F.date_format(ts, p), F.lit(none))
    ext = F.lower(F.coalesce(text.present(F.col("orig_ext")), text.extension(F.col("orig_filename")), F.lit("")))
    name = F.concat(shape("yyyyMMdd", "00000000"), F.lit("_"), shape("HHmmss", "000000"), F.lit("_"), F.substring("id", 1, 8), ext)
    return assets.select("id", F.concat(shape("yyyy", "0000"), F.lit("/"), shape("yyyy-MM", "0000-00")).alias("target_relpath"), name.alias("target_filename"), text.managed_id(F.col("id")).alias("managed_asset_id"))


def plan(assets: DataFrame, managed: DataFrame) -> DataFrame:
    """Managed rows after planning: new paths for all; what is built stays built."""
    t = target_paths(assets)
    old = managed.select(F.col("asset_id").alias("id"), F.col("status").alias("_old"))
    return t.join(old, "id", "left").select(
        F.col("managed_asset_id").alias("id"), F.col("id").alias("asset_id"), F.col("target_relpath").alias("relpath"), F.col("target_filename").alias("filename"),
        F.concat_ws("/", "target_relpath", "target_filename").alias("managed_path"), F.when(F.col("_old") == "BUILT", "BUILT").otherwise("PLANNED").alias("status"),
    )


def add_label(labels: Column, label: Column) -> Column:
    """A set with one label more, compared without regard to case."""
    known = F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.lower(x) == F.lower(label))
    return F.when(known, labels).otherwise(F.array_sort(F.array_append(F.coalesce(labels, F.array().cast("array<string>")), label)))


def remove_label(labels: Column, label: Column) -> Column:
    return F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.lower(x) != F.lower(label))


def synced_labels(rows: DataFrame) -> DataFrame:
    """(asset_id, people) from (asset_id, ord, labels): first spelling of each label, sorted without case."""
    each = rows.select("asset_id", "ord", F.posexplode("labels").alias("pos", "label")).where(F.trim("label") != "")
    one = each.groupBy("asset_id", F.lower("label").alias("fold")).agg(F.min_by("label", F.struct("ord", "pos")).alias("label"))
    return one.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "label"))), lambda x: x["label"]).alias("people"))


def reviewed(assets: DataFrame, changes: DataFrame) -> DataFrame:
    """Reviews applied: rating within 0 to 5, state upper-cased, favourite 0 or 1; what is not given stays."""
    c = changes.select("id", F.greatest(F.lit(0), F.least(F.lit(5), F.col("user_rating"))).alias("_r"), F.upper("review_state").alias("_s"), F.col("review_score").alias("_c"), F.col("favorite").cast("int").alias("_f"))
    out = assets.join(c, "id", "left")
    for column, new in (("user_rating", "_r"), ("review_state", "_s"), ("review_score", "_c"), ("favorite", "_f")):
        out = out.withColumn(column, F.coalesce(new, column))
    return out.select(assets.columns)


def paired(rows: DataFrame, name_col: str, value_cols: list[str], order: list[Column]) -> DataFrame:
    """Fill missing values from the first row with the same pair key (same shot under another name) that has them."""
    keyed = rows.withColumn("_key", text.pair_key(F.col(name_col)))
    w = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in value_cols:
        keyed = keyed.withColumn(c, F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(w)))
    return keyed.drop("_key")
