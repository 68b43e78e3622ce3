"""Text, key, list and value functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by kind; what is in none of them is "other".
RAW_EXTS = [".dng", ".raw", ".cr2", ".cr3", ".nef", ".arw", ".orf", ".rw2"]
IMAGE_EXTS = [".jpg", ".jpeg", ".heic", ".png", ".gif", ".tif", ".tiff", ".bmp", ".webp"]
VIDEO_EXTS = [".mov", ".mp4", ".m4v", ".avi", ".mts", ".m2ts", ".3gp", ".mkv", ".wmv", ".insv"]
#: Name endings that mark a variant of the same shot.
PAIR_SUFFIXES = ["_original", "-original", "-edited", "_edited", "-main", "_main", "-overlay", "_overlay"]


def present(c: Column) -> Column:
    """Null where the text is null or empty."""
    return F.nullif(c, F.lit(""))


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[present(c) for c in cols])


def clean_text(*cols: Column) -> Column:
    """The non-blank parts, trimmed, with single spaces between them."""
    return F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in cols])


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text that are longer than one character."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(F.coalesce(text, F.lit(""))))


def overlap(query: Column, other: Column) -> Column:
    """Share of the query's distinct tokens that the other set has."""
    return F.size(F.array_intersect(query, other)) / F.greatest(F.size(query), F.lit(1))


def row_id(*parts: Column) -> Column:
    """The first 20 hex digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])), 1, 20)


def managed_id(asset_id: Column) -> Column:
    return row_id(F.lit("managed"), asset_id)


def file_name(path: Column) -> Column:
    """The last part of a POSIX or Windows path."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def extension(path: Column) -> Column:
    """The lower-cased suffix with its dot, or an empty text; a leading dot alone is no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def media_type(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(VIDEO_EXTS), "video").when(e.isin(RAW_EXTS), "raw").when(e.isin(IMAGE_EXTS), "image").otherwise("other")


def media_kind(media: Column, mime: Column) -> Column:
    """image or video, from the media type or else the MIME type; other if neither says."""
    m, t = F.lower(F.coalesce(media, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return F.when(m.isin("image", "raw"), "image").when(m == "video", "video").when(t.startswith("image/"), "image").when(t.startswith("video/"), "video").otherwise("other")


def provider(path: Column, inner: Column | None = None) -> Column:
    """Which service a path comes from; ``inner`` are names inside an archive, of which 20 count."""
    name, whole = F.lower(file_name(path)), F.lower(path)
    names = F.lit("") if inner is None else F.lower(F.array_join(F.slice(F.coalesce(inner, F.array().cast("array<string>")), 1, 20), " "))
    has = lambda c, *words: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])
    insta = extension(path).isin(".insv", ".lrv") | has(whole, "insta360", "dcim/camera01") | name.startswith("vid_") | name.startswith("lrv_") | (name == "fileinfo_list.list")
    return (
        F.when(has(name, "snapchat") | name.startswith("mydata~"), "snapchat")
        .when(insta, "insta360")
        .when(has(name, "icloud", "apple"), "apple")
        .when(has(name, "takeout", "google"), "google")
        .when(has(names, "memories_history.json", "memories_history.html", "memories/"), "snapchat")
        .when(has(names, "insta360", "dcim/camera01"), "insta360")
        .when(has(names, "takeout", "metadata.json"), "google")
        .when(has(names, "icloud", "apple"), "apple")
        .otherwise("local")
    )


def history_export(path: Column, inner: Column) -> Column:
    return provider(path, inner) == "snapchat"


def history_main(inner_path: Column) -> Column:
    return inner_path.rlike(r"(?i)^memories/\d{4}-\d{2}-\d{2}_[^/]+-main\.(jpg|jpeg|mp4|mov)$")


def history_overlay(inner_path: Column) -> Column:
    return inner_path.rlike(r"(?i)^memories/\d{4}-\d{2}-\d{2}_[^/]+-overlay\.png$")


def sidecar_names(path: Column) -> Column:
    """The four places a media file's sidecar may be, best first."""
    sibling, exact = F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".json")), F.concat(path, F.lit(".json"))
    longer = lambda c: F.regexp_replace(c, r"\.json", ".supplemental-metadata.json")
    return F.array(sibling, exact, longer(sibling), longer(exact))


def pair_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(stem(name)), "(" + "|".join(PAIR_SUFFIXES) + ")$", "")


def relative_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^(\./)+", ""), r"^/+", ""))


def typed_scalar(text: Column) -> Column:
    """A struct (kind, text, number) of a text that may be quoted, hexadecimal, an integer or a decimal."""
    t = F.trim(text)
    kind = (
        F.when(t.rlike('^".*"$') & (F.length(t) > 1), "text").when(t.rlike("^0x[0-9a-fA-F]+$"), "hex").when(t.rlike(r"^-?\d+$"), "integer").when(t.rlike(r"^-?\d+\.\d+$"), "decimal").otherwise("text")
    )
    number = F.when(kind == "hex", F.conv(F.substr(t, F.lit(3)), 16, 10).try_cast("double")).when(kind.isin("integer", "decimal"), t.try_cast("double"))
    return F.struct(kind.alias("kind"), F.when(t.rlike('^".*"$'), F.regexp_replace(t, '^"|"$', "")).otherwise(t).alias("text"), number.alias("number"))


def text_list(value: Column) -> Column:
    """A JSON list, or else the text itself, as an array of non-blank texts."""
    parsed = F.from_json(value, "array<string>")
    listed = F.when(value.isNull() | (F.trim(value) == ""), F.array().cast("array<string>")).when(F.trim(value).startswith("["), F.coalesce(parsed, F.array(value))).otherwise(F.array(value))
    return F.filter(listed, lambda x: x.isNotNull() & (F.trim(x) != ""))


def value_present(value_json: Column) -> Column:
    """Whether a JSON text holds something."""
    return value_json.isNotNull() & ~F.trim(value_json).isin("", "null", '""', "[]", "{}")


def value_parts(value: Column, kind: str) -> Column:
    """(value_json, value_text, value_real) of a typed value; booleans are numbers too."""
    if kind == "string":
        return F.struct(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2).alias("value_json"), value.alias("value_text"), F.lit(None).cast("double").alias("value_real"))
    if kind in ("boolean", "number"):
        return F.struct(value.cast("string").alias("value_json"), F.lit(None).cast("string").alias("value_text"), value.cast("double").alias("value_real"))
    return F.struct(F.to_json(value).alias("value_json"), F.lit(None).cast("string").alias("value_text"), F.lit(None).cast("double").alias("value_real"))


def number_of(value_real: Column, value_text: Column) -> Column:
    """The number of a stored value; a text that is no number counts as 0."""
    return F.coalesce(value_real, F.when(value_text.isNotNull(), F.coalesce(F.trim(value_text).try_cast("double"), F.lit(0.0))))


def human_size(size: Column, largest: str = "TB") -> Column:
    """Bytes in steps of 1024 up to the ``largest`` unit, with one decimal from KB on, halves rounded to even."""
    units = ["KB", "MB", "GB", "TB"]
    out = F.when(size.isNull(), F.lit(None).cast("string")).when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units[: units.index(largest) + 1], 1):
        shown = F.format_string(f"%.1f {unit}", F.bround(size / float(1024**k), 1))
        out = out.when(size < 1024 ** (k + 1), shown) if unit != largest else out.otherwise(shown)
    return out


def version_key(text: Column) -> Column:
    """(major, minor, patch) for comparing versions; missing parts are 0."""
    part = lambda k: F.coalesce(F.regexp_extract(text, r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", k).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def screenshot(name: Column, ext: Column, width: Column, height: Column, has_camera: Column) -> Column:
    """A name that says so, or a PNG of screen shape without a camera."""
    long, short = F.greatest(width, height), F.least(width, height)
    return F.contains(F.lower(name), F.lit("screenshot")) | F.contains(F.lower(name), F.lit("screen shot")) | ((F.lower(ext) == ".png") & ~has_camera & (long >= 1000) & (long / short > 1.2))


def blurry(width: Column, height: Column, laplacian_variance: Column) -> Column:
    return (F.greatest(width, height) >= 800) & (laplacian_variance < 18.0)
