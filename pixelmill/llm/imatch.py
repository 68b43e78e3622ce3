"""I-Match document fingerprints, with DataFrame functions only.

Terms are the lower-cased words between white space and ASCII punctuation.  Those whose
document frequency lies in the band [``low``, ``high``] of the documents form the lexicon.  A
document's distinct lexicon terms, sorted, are hashed once for each of ``SUBSETS`` randomised
lexicon subsets; subset k keeps a term with probability ``4 ** -(2 + k // 8)``, so that short and
long documents both have subsets with one or a few of their terms.  The fingerprint is the row of
these hashes, and the likeness of two is the share of equal ones among the subsets that are not
empty for both.

The lexicon is broadcast while it has at most ``LEXICON`` rows, which are counted first; a larger
one is joined by a shuffle.  The fingerprints are the same either way.  Counting runs jobs while
the query is being built.

Cases: a text of which no subset keeps a term is fingerprinted by one hash of all its distinct
terms, sorted, and is like only its equals; a null text counts as empty, and texts without terms
share one fingerprint; repeated ids are ordered by a hash of their text; a null doc_id comes
first; an empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.session import shuffle_partitions, stage_table

LOW, HIGH = 0.0005, 0.1
LEXICON = 400_000
SUBSETS = 32
EMPTY = 0  # stands for the hash of no terms


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of ``text``."""
    words = F.split(F.lower(text), r"[\s\p{Punct}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, text_col: str = "text", limit: int = LEXICON) -> DataFrame:
    """The terms in the band by subset: one row (term, k) for each subset that keeps the term; marked for broadcast if few."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = stage_table(texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "imatch-df")
    n = docs.count()
    least = max(2, int(low * n))
    band = counted.where(F.col("df").between(least, max(least, int(high * n))))
    subsets = [F.when(F.pmod(F.xxhash64("term", F.lit(k + 1)), F.lit(16 << 2 * (k // 8))) == 0, F.lit(k)) for k in range(SUBSETS)]
    kept = band.select("term", F.explode(F.array_compact(F.array(*subsets))).alias("k"))
    return F.broadcast(kept) if kept.count() <= limit else kept


def _bucket(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``x``, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
        low_side = (s["lo"] < s["hi"]) & (F.element_at(table, F.greatest(mid, F.lit(1))) <= x)
        return F.struct(F.when(low_side, mid).otherwise(s["lo"]).alias("lo"), F.when(low_side | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid - 1).alias("hi"))

    return F.aggregate(steps, start, step)["lo"]


def with_next(docs: DataFrame, parts: int) -> tuple[DataFrame, Window]:
    """(doc_id, text, bucket, sentinel) dealt into runs of ascending ids, and the order in a run.

    Runs are cut at ids that exist, and the row at which a run begins is also put at the end of
    the run before it (the first of all at the end of the last), so every row finds its next one
    in its own run.  One shuffle moves the texts.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    q = [i / parts for i in range(1, parts)]
    found = source.select("doc_id").agg(F.percentile_approx("doc_id", q, 10_000).alias("q"), F.min("doc_id").alias("least")).first()
    bounds = sorted(set(found["q"] or []) - {found["least"]})
    own = F.coalesce(_bucket(F.col("doc_id"), bounds), F.lit(0))
    placed = source.withColumn("own", own)
    is_bound = F.lit(False) if not bounds else (F.col("own") > 0) & (F.element_at(F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), F.greatest(F.col("own"), F.lit(1))) == F.col("doc_id"))
    is_least = F.col("doc_id").eqNullSafe(F.lit(found["least"]).cast("long"))
    places = F.array(
        F.struct(F.col("own").alias("bucket"), F.lit(False).alias("sentinel")),
        F.when(is_bound, F.struct((F.col("own") - 1).alias("bucket"), F.lit(True).alias("sentinel"))),
        F.when(is_least, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(True).alias("sentinel"))),
    )
    out = placed.select("doc_id", "text", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).select("doc_id", "text", "p.bucket", "p.sentinel")
    return out, Window.partitionBy("bucket").orderBy("sentinel", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def _chained(found: Column) -> Column:
    """(key, h) for each run of one key in ``found``, sorted (key, term): terms are hashed one after the other."""
    none = F.array().cast("array<struct<key:int,h:bigint>>")
    start = F.struct(F.lit(-1).alias("key"), F.lit(0).cast("long").alias("h"), none.alias("out"))

    def closed(s: Column) -> Column:
        return F.when(s["key"] < 0, s["out"]).otherwise(F.array_append(s["out"], F.struct(s["key"].alias("key"), s["h"].alias("h"))))

    def step(s: Column, x: Column) -> Column:
        same = s["key"] == x["key"]
        h = F.xxhash64(x["term"], F.when(same, s["h"]).otherwise(F.lit(0).cast("long")))
        return F.struct(x["key"].alias("key"), h.alias("h"), F.when(same, s["out"]).otherwise(closed(s)).alias("out"))

    return F.aggregate(found, start, step, closed)


def _hashes(chains: Column, of: int) -> Column:
    """The row of subset hashes of one text, EMPTY where a subset keeps none of its terms."""
    own = F.map_from_entries(F.filter(chains, lambda x: F.floor(x["key"] / SUBSETS) == of))
    row = F.transform(F.array(own), lambda m: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: F.coalesce(F.try_element_at(m, k + of * SUBSETS), F.lit(EMPTY).cast("long"))))
    return F.element_at(row, 1)  # the map is built once, not for each subset


def _or_all(row: Column, rest: Column) -> Column:
    """The row, or one hash of all terms if no subset keeps any."""
    return F.when(F.exists(row, lambda h: h != EMPTY), row).otherwise(F.array(rest))


def likeness(a: Column, b: Column) -> Column:
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(a == b, F.lit(1.0)).when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(same / F.greatest(F.size(pairs), F.lit(1)))


def shown(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _hash_of(found: Column) -> Column:
    """One hash of all distinct terms, sorted."""
    return F.xxhash64(F.sort_array(found))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (see op5's contract)."""
    terms_of_band = lexicon(docs)
    rows, order = with_next(docs, 4 * shuffle_partitions(docs.sparkSession))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.when(~F.col("sentinel"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce(F.col("next"), F.lit("")), F.lit(1), half))))
    rows = rows.select(
        "bucket", "sentinel", "doc_id", "n_chars", F.xxhash64("text").alias("tie"), F.unhex(F.sha2("edited", 256)).alias("sha"),
        terms(F.col("text")).alias("t0"), F.coalesce(terms(F.col("edited")), F.array().cast("array<bigint>")).alias("t1"), F.monotonically_increasing_id().alias("rid"),
    )
    mark = F.struct(F.xxhash64("rid").alias("term"), F.lit(0).alias("of"))  # keeps rows without terms; its hash spreads them
    tagged = F.concat(F.array(mark), F.transform("t0", lambda x: F.struct(x.alias("term"), F.lit(1).alias("of"))), F.transform("t1", lambda x: F.struct(x.alias("term"), F.lit(2).alias("of"))))
    keys = ["bucket", "rid", "sentinel", "doc_id", "n_chars", "tie", "sha", "rest0", "rest1"]
    # What a document has once is worked out before its terms are exploded.
    once = rows.select(*keys[:-2], _hash_of(F.col("t0")).alias("rest0"), _hash_of(F.col("t1")).alias("rest1"), tagged.alias("tagged"))
    long_form = once.select(*keys, F.explode("tagged").alias("x")).select(*keys, "x.term", "x.of")
    hit = long_form.join(terms_of_band, "term", "left").where("of = 0 or k is not null")
    first = [F.first(c).alias(c) for c in keys[2:]]
    key = (F.col("of") * SUBSETS + F.col("k")).cast("int")
    found = F.sort_array(F.collect_list(F.when(F.col("of") > 0, F.struct(key.alias("key"), "term"))))
    grouped = hit.groupBy("bucket", "rid").agg(*first, found.alias("found"))
    row = ["bucket", "sentinel", "doc_id", "n_chars", "tie", "sha"]
    chained = grouped.select(*row, "rest0", "rest1", _chained(F.col("found")).alias("chains"))
    hashed = chained.select(*row, "rest0", "rest1", _hashes(F.col("chains"), 1).alias("a"), _hashes(F.col("chains"), 2).alias("b"))
    hashed = hashed.select(*row, _or_all(F.col("a"), F.col("rest0")).alias("a"), _or_all(F.col("b"), F.col("rest1")).alias("b"))
    again = Window.partitionBy("bucket").orderBy("sentinel", F.col("doc_id").asc_nulls_first(), "tie")
    final = hashed.withColumn("c", F.lead("a").over(again)).where("not sentinel")
    return final.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), shown(F.col("a")).alias("fingerprint"), shown(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.coalesce("c", "a")).alias("near_next"),
    )
