"""Hybrid search: hashed text vectors, token overlap, people, places and boosts in one plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import text, vector

#: Query words that ask for places.
PLACE_WORDS = ["photo", "map", "location", "where", "place", "places"]


def search_text(df: DataFrame) -> Column:
    """The text an asset is found by."""
    arr = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    plain = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    listed = lambda c: arr(F.col(c)) if c in df.columns else F.lit(None).cast("string")
    return text.clean_text(plain("orig_filename"), plain("title"), plain("description"), plain("location_text"), listed("keywords"), listed("people"), plain("face_labels"), plain("extracted_text"), plain("dt_original"), plain("source"), plain("source_kind"), plain("media_type"))


def scored(assets: DataFrame, query: str | None = None, reference: DataFrame | None = None) -> DataFrame:
    """``assets`` with ``score`` and ``reasons`` (at most four), positive scores only.

    ``reference``: at most one row with text_vector and visual_vector of the asset to resemble.
    """
    col = lambda c, t="string": F.col(c) if c in assets.columns else F.lit(None).cast(t)
    q = (query or "").strip().lower()
    df = assets.withColumn("_blob", search_text(assets)).withColumn("_words", text.tokens(F.col("_blob"))).withColumn("_tokens", F.array_distinct("_words"))
    stored = "text_vector" in assets.columns
    if reference is not None and not stored:
        df = df.withColumn("text_vector", vector.text_embedding(text.tokens(F.col("_blob"))))
    parts: list[Column] = []
    why: list[Column] = []
    if q:
        asked_words = list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", q) if len(w) > 1))
        words = F.array(*map(F.lit, asked_words)) if asked_words else F.array().cast("array<string>")
        asked = F.split(F.lit(",".join(map(repr, vector.query_embedding(q)))), ",").cast("array<double>")
        words_of = F.col("_words")
        short = vector.sparse_similarity(asked, words_of)
        stored_like = vector.cosine(asked, F.col("text_vector")) if stored else None
        df = df.withColumn("_similar", stored_like if stored else F.when(F.size(words_of) <= 64, short).otherwise(vector.folded_similarity(asked, words_of)))
        similar = F.col("_similar")
        share = text.overlap(words, F.col("_tokens"))
        people = text.overlap(words, text.token_set(F.concat_ws(" ", F.array_join(F.coalesce(col("people", "array<string>"), F.array().cast("array<string>")), " "), col("face_labels"))))
        place = text.overlap(words, text.token_set(col("location_text")))
        in_text = F.arrays_overlap(words, text.token_set(col("extracted_text")))
        dated = F.coalesce(F.contains(F.lit(q), F.nullif(F.substring("dt_original", 1, 10), F.lit(""))), F.lit(False))
        mapped = F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull() & F.arrays_overlap(words, F.array(*map(F.lit, PLACE_WORDS)))
        parts += [similar * 0.62 + share * 0.26, F.when(people > 0, 0.32 + people * 0.28), F.when(place > 0, 0.28 + place * 0.24), F.when(in_text, 0.14), F.when(dated, 0.05), F.when(mapped, 0.05)]
        why += [F.when(similar > 0.2, F.format_string("text=%.2f", similar)), F.when(share > 0, F.format_string("tokens=%.2f", share)), F.when(people > 0, F.lit("people match")), F.when(place > 0, F.lit("location match")), F.when(in_text, F.lit("text match"))]
    if reference is not None:
        df = df.join(F.broadcast(reference.select(F.col("text_vector").alias("_rt"), F.col("visual_vector").alias("_rv")).limit(1)))
        by_text, by_look = vector.cosine(F.col("_rt"), F.col("text_vector")), vector.cosine(F.col("_rv"), col("visual_vector", "array<double>"))
        parts += [by_text * 0.25, by_look * 0.22]
        why += [F.when(by_text > 0.2, F.format_string("ref-text=%.2f", by_text)), F.when(by_look > 0.2, F.format_string("visual=%.2f", by_look))]
    if q:
        why += [F.when(dated, F.lit("date match")), F.when(mapped, F.lit("location present"))]
    rating, review, state = col("user_rating", "int"), col("review_score", "double"), F.upper(F.coalesce(col("review_state"), F.lit("")))
    parts += [F.when(rating != 0, F.least(F.lit(0.12), rating * 0.02)), F.least(F.lit(0.08), F.greatest(F.lit(0.0), review) * 0.01), F.when(state.isin("REVIEWED", "RANKED", "KEPT"), 0.03)]
    why += [F.when(rating != 0, F.format_string("rating=%d", rating)), F.when(review.isNotNull(), F.format_string("review=%.2f", review)), F.when(state.isin("REVIEWED", "RANKED", "KEPT"), F.concat(F.lit("state="), col("review_state")))]
    if not q and reference is None:
        parts.append(F.lit(0.01))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    out = df.withColumn("score", total).where("score > 0").withColumns({"score": F.bround("score", 4), "reasons": F.slice(F.array_compact(F.array(*why)), 1, 4)})
    return out.drop("_blob", "_words", "_tokens", "_similar", "_rt", "_rv")


def search(assets: DataFrame, query: str | None = None, *, hidden: DataFrame | None = None, reference: DataFrame | None = None, similar_to=None, limit: int = 100, offset: int = 0, media_type: str | None = None, source: str | None = None) -> DataFrame:
    """A page of hits, best first, later captures first among equals, then by id."""
    found = assets
    if hidden is not None:
        found = found.join(hidden.select(F.col("asset_id").alias("id")), "id", "left_anti")
    for column, value in (("media_type", media_type), ("source", source)):
        if value:
            found = found.where(F.col(column) == value)
    if similar_to is not None:
        found = found.where(F.col("id") != similar_to)
    return scored(found, query, reference).orderBy(F.desc("score"), F.coalesce("dt_original", F.lit("")).desc(), F.desc("id")).offset(offset).limit(limit)


def text_profiles(assets: DataFrame, extraction: DataFrame, fields: DataFrame, faces: DataFrame) -> DataFrame:
    """``assets`` with extracted_text, location_text and face_labels, each aggregated once before its join."""
    texts = extraction.where("status = 'READY'").groupBy("asset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("segment_start_ms", F.lit(0)), "id", "text_content"))), lambda x: x["text_content"]), " ").alias("extracted_text"))
    places = fields.where("field_name = 'location' and value_text is not null").groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_set("value_text")), " ").alias("location_text"))
    labels = faces.where("label is not null").groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_set("label")), " ").alias("face_labels"))
    out = assets
    for part in (texts, places, labels):
        out = out.join(part.withColumnRenamed("asset_id", "id"), "id", "left")
    return out
