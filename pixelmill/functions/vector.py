"""Vector and bit-hash functions as Column expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_DIM = 96


def dot(a: Column, b: Column) -> Column:
    """Dot product over the common prefix."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common prefix; a norm of zero counts as one, an empty vector gives 0."""
    n = F.least(F.size(a), F.size(b))
    one = lambda c: F.when(norm(F.slice(c, 1, n)) == 0, 1.0).otherwise(norm(F.slice(c, 1, n)))
    return F.when(F.size(a).eqNullSafe(0) | F.size(b).eqNullSafe(0) | a.isNull() | b.isNull(), 0.0).otherwise(dot(a, b) / (one(a) * one(b)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, worked out once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalized(a: Column) -> Column:
    def scaled(v: Column) -> Column:
        return let(F.when(norm(v) == 0, 1.0).otherwise(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n))

    return let(a, scaled)


def text_embedding(words: Column, dim: int = TEXT_DIM) -> Column:
    """Signed feature hashing of words by their SHA-1, normalised; a null word list gives zeros."""
    index = lambda w: F.conv(F.substring(F.sha1(w), 1, 8), 16, 10).cast("long") % dim
    sign = lambda w: F.when(F.conv(F.substring(F.sha1(w), 9, 2), 16, 10).cast("int") % 2 == 1, -1.0).otherwise(1.0)
    placed = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.struct(index(w).alias("i"), sign(w).alias("s")))
    zero = F.array_repeat(F.lit(0.0), dim)
    summed = F.aggregate(placed, zero, lambda acc, p: F.transform(acc, lambda v, k: v + F.when(k == p["i"], p["s"]).otherwise(0.0)))
    return normalized(summed)


def simhash_bits(h: Column, bits: int = 64) -> list[Column]:
    """For each bit the votes of a group's 64-bit hashes: one up where it is set, one down where not."""
    return [F.sum(F.shiftright(h, k).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"_v{k}") for k in range(bits)]


def simhash(bits: int = 64) -> Column:
    """The hash of the bits with more votes up than down, from the columns of ``simhash_bits``."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.when(F.col(f"_v{k}") > 0, F.lit((1 << k) - (1 << 64 if k == 63 else 0))).otherwise(F.lit(0)).cast("long"))
    return out


def sparse_similarity(asked: Column, words: Column, dim: int = TEXT_DIM) -> Column:
    """Cosine of a unit vector and the hashed vector of a few words, without building the latter.

    Its squared norm is the sum over pairs of words in one cell, so this suits short texts.
    """
    index = lambda w: F.conv(F.substring(F.sha1(w), 1, 8), 16, 10).cast("long") % dim
    sign = lambda w: F.when(F.conv(F.substring(F.sha1(w), 9, 2), 16, 10).cast("int") % 2 == 1, -1.0).otherwise(1.0)
    placed = F.transform(words, lambda w: F.struct((index(w) + 1).cast("int").alias("i"), sign(w).alias("s")))

    def similarity(p: Column) -> Column:
        square = F.aggregate(p, F.lit(0.0), lambda total, a: total + F.aggregate(p, F.lit(0.0), lambda t, b: t + F.when(a["i"] == b["i"], a["s"] * b["s"]).otherwise(0.0)))
        product = F.aggregate(p, F.lit(0.0), lambda t, a: t + a["s"] * F.element_at(asked, a["i"]))
        return let(square, lambda n: F.when(n > 0, product / F.sqrt(n)).otherwise(product))

    return let(placed, similarity)


def folded_similarity(asked: Column, words: Column, dim: int = TEXT_DIM) -> Column:
    """``sparse_similarity`` for texts of any length: the words' cells are sorted, so that each cell is summed in one run."""
    code = lambda h: (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim * 2 + F.conv(F.substring(h, 10, 1), 16, 10).cast("long") % 2).cast("int")
    codes = F.sort_array(F.transform(words, lambda w: code(F.sha1(w))))
    state = lambda i, run, square, product: F.struct(i.alias("i"), run.alias("run"), square.alias("square"), product.alias("product"))
    whole = lambda s: (s["square"] + s["run"] * s["run"], s["product"] + F.when(s["i"] > 0, s["run"] * F.element_at(asked, F.greatest(s["i"], F.lit(1)))).otherwise(0.0))

    def step(s: Column, c: Column) -> Column:
        i, sign = F.shiftright(c, 1) + 1, F.when(c.bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
        return F.when(s["i"] == i, state(s["i"], s["run"] + sign, s["square"], s["product"])).otherwise(state(i, sign, *whole(s)))

    def done(s: Column) -> Column:
        square, product = whole(s)
        return F.when(square > 0, product / F.sqrt(square)).otherwise(product)

    return F.aggregate(codes, state(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), step, done)


def embedded_texts(texts: DataFrame, key: str, words: Column, dim: int = TEXT_DIM) -> DataFrame:
    """(key, dim, value): the cells other than 0 of ``text_embedding`` of each key's words, summed map side first."""
    h = texts.select(key, F.explode(words).alias("_w")).select(key, F.sha1("_w").alias("_h"))
    cell, odd = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % dim, F.conv(F.substring("_h", 10, 1), 16, 10).cast("int") % 2
    sums = h.groupBy(key, cell.alias("dim")).agg(F.sum(F.when(odd == 1, -1.0).otherwise(1.0)).alias("v")).where("v <> 0")
    packed = sums.groupBy(key).agg(F.collect_list(F.struct("dim", "v")).alias("_p"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_n"))
    return packed.select(key, "_n", F.inline("_p")).select(key, "dim", (F.col("v") / F.col("_n")).alias("value"))


def query_embedding(query: str, dim: int = TEXT_DIM) -> list[float]:
    """``text_embedding`` of one query text, worked out on the driver so that a plan holds it as a literal."""
    out = [0.0] * dim
    for word in re.findall("[a-z0-9]+", query.lower()):
        if len(word) > 1:
            h = hashlib.sha1(word.encode()).digest()
            out[int.from_bytes(h[:4], "big") % dim] += -1.0 if h[4] & 1 else 1.0
    n = sum(x * x for x in out) ** 0.5 or 1.0
    return [x / n for x in out]


def hash_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    """1 less the share of differing bits of two integers; 0 where one is missing."""
    return F.coalesce(1.0 - F.bit_count(a.bitwiseXOR(b)) / bits, F.lit(0.0))


def crop_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    """1 up to 12 differing bits, less in proportion beyond."""
    d = F.bit_count(a.bitwiseXOR(b))
    return F.coalesce(F.when(d <= 12, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - d / bits)), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x, y, w, h)."""
    wide = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    high = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - wide * high
    return F.when(union > 0, wide * high / union).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def review_threshold(n: Column, base: float = 0.95) -> Column:
    """The catalog's bar for adding to a confirmed identity: falls with the number of faces."""
    return clamp(base + 0.03 - 0.02 * (n - 1), 0.50, 0.98)


def cluster_threshold(n: Column) -> Column:
    """The clusterer's bar: 0.95, less 0.01 for each face beyond five, not below 0.50."""
    return F.greatest(F.lit(0.50), 0.95 - 0.01 * F.greatest(n - 5, F.lit(0)))


def support_needed(n: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(6), F.ceil(n * 0.2))).cast("int")
