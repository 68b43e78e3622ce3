"""Catalog reads: listings, facets, coverage, health, albums and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill import schema
from pixelmill.functions import text, timex



def decision_rank(decision: Column) -> Column:
    """HIDE before CANONICAL before KEEP before anything else."""
    return F.when(decision == "HIDE", 0).when(decision == "CANONICAL", 1).when(decision == "KEEP", 2).otherwise(3)


def dominant_decision(items: DataFrame) -> DataFrame:
    """(asset_id, duplicate_decision): one decision per asset, the strongest."""
    return items.groupBy("asset_id").agg(F.min_by("keep_decision", F.struct(decision_rank(F.col("keep_decision")), F.coalesce("keep_decision", F.lit("")))).alias("duplicate_decision"))


def hidden(items: DataFrame) -> DataFrame:
    return items.where("keep_decision = 'HIDE'").select("asset_id").distinct()


def filtered(assets: DataFrame, items: DataFrame | None = None, *, query: str | None = None, include_hidden: bool = False, media_type: str | None = None, source: str | None = None, review_state: str | None = None, favorite_only: bool = False) -> DataFrame:
    """The listing's predicate: hidden duplicates out, a text in name, title or description, and equalities."""
    out = assets
    if items is not None and not include_hidden:
        gone = hidden(items)
        out = out.join(gone, out["id"] == gone["asset_id"], "left_anti")
    if query:
        like = f"%{query}%"
        out = out.where(F.col("orig_filename").ilike(like) | F.coalesce("title", F.lit("")).ilike(like) | F.coalesce("description", F.lit("")).ilike(like))
    for column, value in (("media_type", media_type), ("source", source)):
        if value:
            out = out.where(F.col(column) == value)
    if review_state:
        out = out.where(F.coalesce("review_state", F.lit("NEW")) == review_state)
    return out.where(F.coalesce("favorite", F.lit(0)) == 1) if favorite_only else out


def ordering(sort: str) -> list[Column]:
    """Sort keys of a listing; nulls come last in descending order."""
    down = lambda c: F.col(c).desc_nulls_last()
    zero = lambda c: F.coalesce(c, F.lit(0))
    tail = [down("dt_original"), down("id")]
    return {
        "recent": [F.when(F.coalesce("managed_status", F.lit("")) == "BUILT", 0).otherwise(1), *tail],
        "rated": [zero("user_rating").desc(), zero("review_score").desc(), *tail],
        "favorites": [zero("favorite").desc(), zero("user_rating").desc(), zero("review_score").desc(), *tail],
        "review": [zero("user_rating").asc(), zero("review_score").desc(), *tail],
    }.get(sort, tail)


def listing(assets: DataFrame, managed: DataFrame, items: DataFrame, *, limit: int = 100, offset: int = 0, sort: str = "recent", **where) -> DataFrame:
    """A page of assets with their managed state and dominant duplicate decision."""
    found = filtered(assets, items, **where).join(managed.select(F.col("asset_id").alias("id"), F.col("status").alias("managed_status"), "managed_path"), "id", "left")
    found = found.join(dominant_decision(items).withColumnRenamed("asset_id", "id"), "id", "left").withColumn("duplicate_decision", F.coalesce("duplicate_decision", F.lit("")))
    return found.orderBy(*ordering(sort)).offset(max(0, offset)).limit(limit)


def review_queue(assets: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return assets.where("coalesce(review_state, '') in ('NEW', 'REVIEW', '') or user_rating is null").orderBy(*ordering("review")).offset(max(0, offset)).limit(limit)


def neighbors(assets: DataFrame, asset_id, keys: list[tuple[str, bool]], id_col: str = "id") -> DataFrame:
    """(id, previous_id, next_id) of one asset in the order of ``keys`` (column, ascending; nulls last), which end with the id.

    Two top-1 searches on either side of the asset's own row, so nothing is sorted as a whole.
    """
    columns = [c for c, _ in keys]
    own = F.broadcast(assets.where(F.col(id_col) == asset_id).select(F.struct(*columns).alias("_own")).limit(1))
    beside = assets.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(columns)]).crossJoin(own)  # with one row

    def cond(after: bool) -> Column:
        out = F.lit(False)
        for k, (c, up) in reversed(list(enumerate(keys))):
            x, mine = F.col(f"_{k}"), F.col(f"_own.{c}")
            beyond = F.coalesce(x > mine if up == after else x < mine, F.lit(False))
            beyond = beyond | ((x.isNull() & mine.isNotNull()) if after else (x.isNotNull() & mine.isNull()))
            out = beyond | (x.eqNullSafe(mine) & out)
        return out

    def nearest(after: bool, name: str) -> DataFrame:
        order = [(F.col(f"_{k}").asc_nulls_last() if up else F.col(f"_{k}").desc_nulls_last()) if after else (F.col(f"_{k}").desc_nulls_first() if up else F.col(f"_{k}").asc_nulls_first()) for k, (_, up) in enumerate(keys)]
        return beside.where(cond(after)).orderBy(*order).limit(1).select(F.col("_id").alias(name))

    row = assets.where(F.col(id_col) == asset_id).select(id_col).limit(1)
    return row.join(nearest(False, "previous_id"), F.lit(True), "left").join(nearest(True, "next_id"), F.lit(True), "left")


def on_this_day(assets: DataFrame, month_day: str, limit: int = 12) -> DataFrame:
    return assets.where(timex.month_day(F.col("dt_original")) == month_day).orderBy(F.col("dt_original").desc_nulls_last(), F.col("id").desc()).limit(limit)


def on_this_day_groups(assets: DataFrame, pivot: str, limit: int = 12) -> DataFrame:
    """Month-days with their counts and latest time, nearest before the pivot day first."""
    groups = assets.where("dt_original is not null").groupBy(timex.month_day(F.col("dt_original")).alias("month_day")).agg(F.count("*").alias("asset_count"), F.max("dt_original").alias("latest"))
    return groups.withColumn("days_back", timex.days_back(F.col("month_day"), F.lit(pivot))).orderBy("days_back", "month_day").limit(limit)


def sources(assets: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown"))
    return assets.groupBy(name.alias("source")).agg(F.count("*").alias("asset_count"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("None"))
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def canonical_fields(fields: DataFrame) -> DataFrame:
    """Canonical field values that hold something, one row per (asset, field)."""
    return fields.where(F.col("is_canonical") & text.value_present(F.col("value_json"))).select("asset_id", "field_name").distinct()


def missing_field(assets: DataFrame, fields: DataFrame, field_name: str) -> DataFrame:
    """Assets to which a field applies that have no canonical value of it."""
    applies = {f: m for f, _, _, m in schema.STANDARD}.get(field_name, ["image", "raw", "video"])
    have = canonical_fields(fields.where(F.col("field_name") == field_name)).select(F.col("asset_id").alias("id"))
    return assets.where(F.col("media_type").isin(applies)).join(have, "id", "left_anti")


def with_flag(assets: DataFrame, fields: DataFrame, field_name: str) -> DataFrame:
    have = fields.where((F.col("field_name") == field_name) & (F.col("value_json") == "true")).select(F.col("asset_id").alias("id")).distinct()
    return assets.join(have, "id", "left_semi")


def completeness(assets: DataFrame, fields: DataFrame) -> DataFrame:
    """(id, filled, total, score): weighted share of the applicable standard that an asset fills.

    The standard has a fixed number of rows, so it rides along as one literal array and the
    assets are joined with their fields once.
    """
    have = canonical_fields(fields).groupBy(F.col("asset_id").alias("id")).agg(F.collect_set("field_name").alias("have"))
    standard = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(w).alias("w"), F.array(*map(F.lit, m)).alias("m")) for f, _, w, m in schema.STANDARD])
    applies = F.filter(standard, lambda s: F.col("media_type").isNull() | F.array_contains(s["m"], F.col("media_type")))
    weigh = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s["w"])
    joined = assets.join(have, "id", "left").withColumn("_applies", applies).withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    out = joined.select("id", "media_type", weigh(F.filter("_applies", lambda s: F.array_contains(F.col("have"), s["f"]))).alias("filled"), F.greatest(weigh(F.col("_applies")), F.lit(1)).alias("total"))
    return out.withColumn("score", F.bround(F.col("filled") * 100.0 / F.col("total"), 0).cast("int"))


def field_coverage(assets: DataFrame, fields: DataFrame) -> DataFrame:
    """Per field of the standard: applicable, present and missing assets, and completeness in percent."""
    per_type = assets.groupBy("media_type").agg(F.count("*").alias("n"))
    standard = schema.standard(assets.sparkSession).select("field_name", "weight", F.explode("media_types").alias("media_type"))
    applicable = per_type.join(F.broadcast(standard), "media_type").groupBy("field_name", "weight").agg(F.sum("n").alias("applicable"))
    have = canonical_fields(fields).join(assets.select(F.col("id").alias("asset_id"), "media_type"), "asset_id").join(F.broadcast(standard.drop("weight")), ["field_name", "media_type"])
    counted = applicable.join(have.groupBy("field_name").agg(F.count("*").alias("present")), "field_name", "left").withColumn("present", F.coalesce("present", F.lit(0)))
    return counted.select("field_name", "weight", "applicable", "present", (F.col("applicable") - F.col("present")).alias("missing"), F.bround(F.col("present") * 100.0 / F.col("applicable"), 1).alias("completeness"))


def overview(assets: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return assets.agg(
        F.count("*").alias("assets"), n(has("dt_original"), "with_time"), n(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull(), "with_location"),
        n(has("title"), "with_title"), n(has("description"), "with_description"), n(F.size(F.coalesce("people", F.array().cast("array<string>"))) > 0, "with_people"),
        n(has("dt_original") & ~F.coalesce("source_dt", F.lit("unknown")).isin("unknown", "filename", "file_mtime", "zip_mtime"), "strong_time"),
        n(F.coalesce("favorite", F.lit(0)) == 1, "favorites"), n(F.col("user_rating").isNotNull(), "rated"),
    )


def pipeline_health(jobs: DataFrame) -> DataFrame:
    """Per job type: runs, failures, the share that failed and the latest error."""
    bad = F.col("status").isin("FAILED", "RETRYABLE")
    return jobs.groupBy("job_type").agg(F.count("*").alias("runs"), F.count_if(bad).alias("failures"), F.max_by(F.when(bad, F.col("error_msg")), F.when(bad, F.struct("created_at", "id"))).alias("latest_error"))


def library_gaps(assets: DataFrame, managed: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """(missing_managed, missing_previews): assets not built, and assets without a ready preview."""
    built = managed.where("status = 'BUILT'").select(F.col("asset_id").alias("id")).distinct()
    ready = thumbnails.where("status = 'READY'").select(F.col("asset_id").alias("id")).distinct()
    flags = assets.select("id").join(built.withColumn("b", F.lit(1)), "id", "left").join(ready.withColumn("t", F.lit(1)), "id", "left")
    return flags.agg(F.count_if(F.col("b").isNull()).alias("missing_managed"), F.count_if(F.col("t").isNull()).alias("missing_previews"))


def import_progress(assets: DataFrame, managed: DataFrame) -> DataFrame:
    built = managed.where("status = 'BUILT'").select(F.col("asset_id").alias("id")).distinct().withColumn("ready", F.lit(1))
    counted = assets.join(built, "id", "left").agg(F.countDistinct("id").alias("total"), F.countDistinct(F.when(F.col("ready") == 1, F.col("id"))).alias("ready"))
    return counted.withColumn("completion", F.when(F.col("total") > 0, F.bround(F.col("ready") * 100.0 / F.col("total"), 1)).otherwise(0.0))


def duplicate_groups(groups: DataFrame, items: DataFrame, *, min_score: float | None = None) -> DataFrame:
    """Groups with visible items and their scores; an open group needs two visible ones."""
    shown = F.coalesce("keep_decision", F.lit("")) != "HIDE"
    stats = items.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("items"), F.count_if(shown).alias("visible"), F.avg(F.when(shown, F.col("score"))).alias("avg_score"), F.max(F.when(shown, F.col("score"))).alias("max_score"))
    out = groups.join(stats, "id", "left").where((F.col("status") != "OPEN") | (F.col("visible") > 1))
    return out if min_score is None else out.where(F.col("avg_score") >= min_score)


def albums(identities: DataFrame, faces: DataFrame) -> DataFrame:
    """Identities with face and asset counts and the cover asset, that of the latest face."""
    live = faces.where("status <> 'REJECTED'").groupBy(F.col("identity_id").alias("id"))
    stats = live.agg(F.countDistinct("id").alias("faces"), F.countDistinct("asset_id").alias("assets"), F.max_by("asset_id", F.struct("created_at", "id")).alias("cover_asset_id"), F.max("created_at").alias("latest"))
    return identities.join(stats, "id", "left").withColumns({"faces": F.coalesce("faces", F.lit(0)), "assets": F.coalesce("assets", F.lit(0))})


def modal_model(embeddings: DataFrame) -> DataFrame:
    """The model used most, the later and then the first by name among equals."""
    return embeddings.groupBy("model_name").agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen")).orderBy(F.desc("n"), F.desc("last_seen"), "model_name").limit(1)


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, without a sort of each group."""
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return packed.select("_row.*")


def evenly_sampled(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """``k`` rows of each group at evenly spaced positions, half-even rounded and filled up from the front."""
    w, all_rows = Window.partitionBy(*group).orderBy(*order), Window.partitionBy(*group)
    ranked = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(all_rows)})
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(k - 1, 1)), 0).cast("int")))
    picks = at if k > 1 else F.array(F.floor(F.col("_n") / 2).cast("int"))
    taken = F.array_contains(picks, F.col("_i").cast("int"))
    before = F.size(F.filter(picks, lambda p: p < F.col("_i")))  # so many of the rows up to this one are picked
    spare = F.col("_i") - before + 1
    filled = taken | (spare <= F.lit(k) - F.size(picks)) & ~taken
    return ranked.where((F.col("_n") <= k) | filled).drop("_i", "_n")


#: Time sources that each provider is expected to have, and those that are weak.
EXPECTED_TIME = {
    "google": ["google_epoch", "google_formatted", "createdate", "datetimeoriginal", "exif_datetime", "filename", "zip_mtime", "file_mtime"],
    "apple": ["apple_csv", "createdate", "datetimeoriginal", "exif_datetime", "filename", "zip_mtime", "file_mtime"],
    "local": ["exif_datetime", "datetimeoriginal", "createdate", "apple_csv_gmt", "file_mtime", "filename"],
    "insta360": ["insta360_proto", "exif_datetime", "datetimeoriginal", "createdate", "file_mtime", "filename"],
    "snapchat": ["snapchat_history"],
}


def issues(weak: dict[str, list[str]]) -> Column:
    """What an audit finds wrong with an asset row, as an array of texts."""
    source, how = F.coalesce("source", F.lit("unknown")), F.col("source_dt")
    shown = F.concat(F.lit("("), F.coalesce(how, F.lit("missing")), F.lit(")"))
    found = [F.when(F.coalesce("dt_original", F.lit("")) == "", F.lit("missing timestamp"))]
    for name, kinds in weak.items():
        found.append(F.when((source == name) & (F.coalesce("dt_original", F.lit("")) != "") & F.coalesce(how, F.lit("")).isin(kinds), F.concat(F.lit("weak timestamp source "), shown)))
    for name, kinds in EXPECTED_TIME.items():
        label = name.title() if name != "local" else "local"
        found.append(F.when((source == name) & ~F.coalesce(how.isin(kinds), F.lit(False)), F.concat(F.lit(f"unexpected {label} timestamp source "), shown)))
    found.append(F.when((source == "snapchat") & (F.col("gps_lat").isNull() | F.col("gps_lon").isNull()), F.lit("missing Snapchat GPS")))
    return F.array_compact(F.array(*found))


def audit_by_source(assets: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    return assets.groupBy("source", "source_kind").agg(
        F.count("*").alias("assets"), n(F.coalesce("dt_original", F.lit("")) != "", "with_time"), n(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull(), "with_location"), n(F.coalesce("title", F.lit("")) != "", "with_title")
    )
