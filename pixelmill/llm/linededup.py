"""Cross-site line deduplication by distinct-site spread.

Each line (exact, blank lines aside) is keyed by two 64-bit hashes and its length.  HyperLogLog
sketches of the sites that show it merge by aggregation, map side first.  A line whose
estimate lies clear above ``min_sites`` is boilerplate, one clear below is not, and the lines
within ``BAND`` (eight) standard errors of the threshold get exact distinct counts, so that a
decision other than exact counting's has a chance below 1e-14.  A boilerplate line is removed
wherever it occurs but for its first occurrence, that with the smallest (doc_id, position); a
document that loses all its lines is dropped by the filter.

Cases: a null site is one site of its own; a null text has no lines and stays null; an empty
or blank text has no countable line and stays as it is; rows with the same doc_id count as one
document; a null doc_id ranks before all; an empty table gives an empty result; further columns
pass through whatever their names, but for the two counts, which replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.session import free_names, row_of, stage_table

MIN_SITES = 5
LG_K = 9
BAND = 8.0
_ERROR = 1.04 / (1 << LG_K) ** 0.5
_NO_ID = -(1 << 63)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _second(line: Column) -> Column:
    """A hash of a line that is independent of its first one."""
    return F.xxhash64(F.lit(7), line)


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(h, g, len, doc_id, at, site) of every line that isn't blank."""
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col(site_col).cast("string"), F.lit("\u0000")).alias("site"), F.col(text_col).cast("string").alias("text"))
    lines = source.select("doc_id", "site", F.posexplode(_lines(F.col("text"))).alias("at", "line")).where(F.trim("line") != "")
    return lines.select(F.xxhash64("line").alias("h"), _second(F.col("line")).alias("g"), F.octet_length("line").alias("len"), "doc_id", "at", F.xxhash64("site").alias("site"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g, len, keep_id, keep_at) of the lines on at least ``min_sites`` sites."""
    key = ["h", "g", "len"]
    band = BAND * _ERROR * min_sites + 1
    merged = stage_table(
        lines.groupBy(key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("first"))
        .where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites - band)),
        "line-spread",
    )
    near = F.abs(F.col("sites") - min_sites) <= band
    again = merged.where(near).select(*key, "first").repartition(*reversed(key))
    # Grouped by the first occurrence, which names the line too: sums cross a shuffle of their own, so AQE can split a hot line's join.
    spread = lines.join(again, key).groupBy("first", "site").agg(*[F.first(c).alias(c) for c in key])
    exact = spread.groupBy("first").agg(F.count("*").alias("sites"), *[F.first(c).alias(c) for c in key]).where(F.col("sites") >= min_sites)
    clear = merged.where(~near & (F.col("sites") > min_sites))
    both = clear.select(*key, "first").unionByName(exact.select(*key, "first"))
    return both.select(*key, F.col("first.doc_id").alias("keep_id"), F.col("first.at").alias("keep_at"))


def _kept_lines(split: Column, gone: Column) -> Column:
    """The lines of ``split`` but for those whose (position, hashes) are in ``gone``.

    Lines and removals are sorted together, a removal right before its line, so the work grows
    with their number and not with its square.
    """
    none = F.lit(None).cast("string")
    lines = F.transform(split, lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), _second(x).alias("g"), F.lit(1).alias("is_line"), x.alias("line")))
    marks = F.transform(gone, lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), x["g"].alias("g"), F.lit(0).alias("is_line"), none.alias("line")))
    both = F.sort_array(F.concat(lines, marks))

    def next_to(pairs: Column) -> Column:
        removed = lambda p: (p["before"]["is_line"] == 0) & (p["before"]["at"] == p["own"]["at"]) & (p["before"]["h"] == p["own"]["h"]) & (p["before"]["g"] == p["own"]["g"])
        return F.filter(pairs, lambda p: (p["own"]["is_line"] == 1) & ~F.coalesce(removed(p), F.lit(False)))

    # ``transform`` over an array of one binds the sorted array, so that it is sorted once
    paired = F.element_at(F.transform(F.array(both), lambda s: F.zip_with(s, F.slice(F.concat(F.array(F.lit(None)), s), 1, F.size(s)), lambda x, y: F.struct(x.alias("own"), y.alias("before")))), 1)
    return F.transform(next_to(paired), lambda p: p["own"]["line"])


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: tuple[str, str] = ("_n_lines", "_n_removed")) -> DataFrame:
    """``docs`` with the text rewritten, and two columns more: the lines that count, and those removed."""
    lines = stage_table(line_table(docs, id_col, text_col, site_col), "lines")
    key = ["h", "g", "len"]
    bad = boilerplate(lines, min_sites).repartition("keep_id", "h")  # a shuffle of its own lets AQE split a hot line's join
    hits = lines.join(bad, key).where((F.col("keep_id") != F.col("doc_id")) | (F.col("keep_at") != F.col("at")))
    per_doc = hits.groupBy("doc_id").agg(F.collect_set(F.struct("at", "h", "g")).alias("gone"))

    columns = [c for c in docs.columns if c not in counts]
    held = docs.select(row_of(docs, *counts).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = held.join(per_doc, "doc_id", "left").withColumn("split", _lines(F.col("text")))
    joined = joined.withColumn("left", F.when(F.col("gone").isNotNull(), _kept_lines(F.col("split"), F.col("gone"))))
    counted = F.coalesce(F.size(F.filter("split", lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    removed = F.coalesce(F.size("split") - F.size("left"), F.lit(0)).cast("long")
    rewritten = F.when(F.col("left").isNotNull(), F.array_join("left", "\n")).otherwise(F.col("text"))
    return joined.select(*[(rewritten if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns], F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(counted).alias(counts[0]), removed.alias(counts[1]))


def filter_documents(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without boilerplate lines and without documents that consisted of them, n_chars brought up to date."""
    n, removed = free_names(docs, "n_lines", "n_removed")
    out = dedup_lines(docs, min_sites, counts=(n, removed))
    out = out.where(~((F.col(removed) > 0) & (F.col(removed) == F.col(n)))).drop(n, removed)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
