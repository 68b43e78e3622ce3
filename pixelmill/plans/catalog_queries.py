"""Queries of the media catalog over the driver's tables, each with its DuckDB SQL.

The driver's tables stand in for the catalog's: orders are assets with times, documents assets
with content, embeddings faces, events jobs and journal entries, conversations extracted
segments.  Expressions that both engines read alike are written once and used by both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill import schema
from pixelmill.functions import text, timex, vector
from pixelmill.operators import catalog, dedupe, identity, jobs, journal, metadata, repair, search, sinks, tuning
from pixelmill.operators.graph import connected_components
from pixelmill.session import stage_table
from pixelmill.sources import scan
from pixelmill.streaming import media

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Orders as assets: column, and its expression in both engines.
_ASSET = {
    "id": "o_orderkey",
    "source": "concat('src', cast(o_custkey % 7 as varchar(9)))",
    "source_kind": "case when o_orderkey % 2 = 0 then 'file' else 'zip' end",
    "source_locator": "concat('loc', cast(o_custkey % 40 as varchar(9)))",
    "source_root": "cast(null as varchar(9))",
    "media_type": "case o_orderstatus when 'O' then 'image' when 'F' then 'video' else 'raw' end",
    "orig_filename": "concat('IMG_', cast(o_orderkey % 5000 as varchar(9)), case when o_orderkey % 3 = 0 then '_edited.JPG' else '.jpg' end)",
    "orig_ext": "'.jpg'",
    "orig_size": "cast(floor(o_totalprice) as bigint)",
    "gps_lat": "case when o_orderkey % 3 = 0 then cast(o_custkey % 90 as double) end",
    "gps_lon": "case when o_orderkey % 3 = 0 then cast(o_custkey % 180 as double) end",
    "gps_alt": "cast(null as double)",
    "title": "case when o_orderkey % 4 = 0 then o_orderpriority end",
    "description": "case when o_orderkey % 10 = 0 then concat('order of ', o_orderpriority) end",
    "user_rating": "case when o_orderkey % 5 = 0 then cast(o_custkey % 6 as int) end",
    "review_score": "case when o_orderkey % 2 = 0 then cast(o_orderkey % 100 as double) / 10 end",
    "review_state": "case when o_orderkey % 6 = 0 then 'REVIEWED' when o_orderkey % 6 = 1 then 'REVIEW' end",
    "favorite": "case when o_orderkey % 7 = 0 then 1 when o_orderkey % 7 = 1 then 0 end",
    "source_dt": "case when o_orderkey % 4 = 0 then 'filename' when o_orderkey % 4 = 1 then 'exif_datetime' end",
    "src_mtime": "cast(null as varchar(9))",
}
_DT = {"spark": "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")", "duck": "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"}


def assets(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").selectExpr(*[f"{e.replace('varchar(9)', 'string')} as {c}" for c, e in _ASSET.items()], f"{_DT['spark']} as dt_original")


A = "a as (select " + ", ".join(f"{e} as {c}" for c, e in _ASSET.items()) + f", {_DT['duck']} as dt_original from orders)"

#: Managed rows: two thirds of the assets, some built.
_MANAGED = "o_orderkey % 3 <> 1"


def managed(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").where(_MANAGED).selectExpr("o_orderkey as asset_id", "case when o_orderkey % 2 = 0 then 'BUILT' else 'PLANNED' end as status", "concat('lib/', cast(o_orderkey as string)) as managed_path")


M = f"m as (select o_orderkey as asset_id, case when o_orderkey % 2 = 0 then 'BUILT' else 'PLANNED' end as status, concat('lib/', cast(o_orderkey as varchar)) as managed_path from orders where {_MANAGED})"


def items(spark: SparkSession, d: str) -> DataFrame:
    """Line items as duplicate items: the order is the asset, the part's residue the group."""
    return t(spark, d, "lineitem").selectExpr("l_partkey % 400 as group_id", "l_orderkey as asset_id", "l_discount * 10 as score", "case when l_linenumber = 7 then 'HIDE' when l_linenumber = 6 then 'CANONICAL' when l_linenumber = 5 then 'KEEP' end as keep_decision")


I = "i as (select l_partkey % 400 as group_id, l_orderkey as asset_id, l_discount * 10 as score, case when l_linenumber = 7 then 'HIDE' when l_linenumber = 6 then 'CANONICAL' when l_linenumber = 5 then 'KEEP' end as keep_decision from lineitem)"  # noqa: E741


def job_events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").selectExpr("event_id as id", "event_type as job_type", "case when value < 5 then 'FAILED' when value < 10 then 'RETRYABLE' else 'COMPLETED' end as status", "props as error_msg", "ts as created_at", "user_id")


J = "j as (select event_id as id, event_type as job_type, case when value < 5 then 'FAILED' when value < 10 then 'RETRYABLE' else 'COMPLETED' end as status, props as error_msg, ts as created_at, user_id from events)"


def faces(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").selectExpr("vec_id as id", "vec_id % 97 as asset_id", "label as identity_id", "embedding as vector", "'DETECTED' as status", "vec_id % 13 as created_at")


# --- duplicates -----------------------------------------------------------------------------


@query("""select sha256(text) as sha256, count(*) as members, arg_min(doc_id, {'s': -n_chars, 'i': doc_id}) as canonical_asset_id from documents group by text having count(*) > 1""")
def exact_dedupe(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("orig_size"), F.lit("").alias("dt_original"))
    return dedupe.exact_groups(docs)


@query(f"""with {I}, s as (select group_id, count(*) as items, count(*) filter (coalesce(keep_decision, '') <> 'HIDE') as visible, avg(score) filter (coalesce(keep_decision, '') <> 'HIDE') as a, max(score) filter (coalesce(keep_decision, '') <> 'HIDE') as m from i group by 1)
select group_id as id, items, visible, round(a, 6) as avg_score, round(m, 6) as max_score from s where visible > 1 and a >= 0.5""")
def duplicate_group_stats(spark, d):
    rows = items(spark, d)
    groups = rows.select(F.col("group_id").alias("id"), F.lit("OPEN").alias("status")).distinct()
    out = catalog.duplicate_groups(groups, rows, min_score=0.5)
    return out.select("id", "items", "visible", F.round("avg_score", 6).alias("avg_score"), F.round("max_score", 6).alias("max_score"))


@query(f"""with {I}, v as (select group_id, count(*) filter (coalesce(keep_decision, '') <> 'HIDE' and asset_id % 5 <> 0) as n from i group by 1)
select group_id as id, case when n = 0 then 'SKIPPED' when n = 1 then 'RESOLVED' else 'OPEN' end as status from v""")
def duplicate_resolution(spark, d):
    rows = items(spark, d).withColumn("keep_decision", F.when(F.col("asset_id") % 5 == 0, "HIDE").otherwise(F.col("keep_decision")))
    groups = rows.select(F.col("group_id").alias("id"), F.lit("OPEN").alias("status")).distinct()
    return dedupe.group_status(groups, rows).select("id", "status")


@query("""with h as (select doc_id as id, lang, source, cast(('0x' || substr(md5(text), 1, 8)) as bigint) as h from documents)
select a.id as src, b.id as dst, bit_count(xor(a.h, b.h)) as distance from h a join h b on a.lang = b.lang and a.source = b.source and a.id < b.id where bit_count(xor(a.h, b.h)) <= 6""")
def near_hash_pairs(spark, d):
    h = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long").alias("h"))
    a, b = h.alias("a"), h.alias("b")
    dist = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h")))
    joined = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") == F.col("b.source")) & (F.col("a.id") < F.col("b.id")))
    return joined.where(dist <= 6).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), dist.alias("distance"))


@query("""with recursive h as (select doc_id as id, lang, cast(('0x' || substr(md5(text), 1, 8)) as bigint) as h, source from documents),
e as (select a.id as x, b.id as y from h a join h b on a.lang = b.lang and a.source = b.source and a.id <> b.id and bit_count(xor(a.h, b.h)) <= 5),
r as (select distinct x as id, x as c from e union select e.y as id, r.c from r join e on r.id = e.x where r.c < e.y)
select id, least(min(c), id) as component from r group by id""")
def near_hash_components(spark, d):
    return connected_components(near_hash_pairs(spark, d).where("distance <= 5"))


#: SimHashes of documents that stand in for the five image hashes, and pairs scored by them in one lang and source.
_SIM = r"""w as (select doc_id as id, coalesce(lang, '') as lang, coalesce(source, '') as source, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) as w from documents),
v as (select id, lang, source, k, sum(case when (('0x' || substr(md5(w), 1 + 8 * (1 - k // 32), 8))::bigint >> (k % 32)) & 1 = 1 then 1 else -1 end) as v from w, range(64) t(k) group by all),
h as (select id, lang, source, coalesce(sum(2 ** (k - 32)) filter (v > 0 and k >= 32), 0)::bigint as hi, coalesce(sum(2 ** k) filter (v > 0 and k < 32), 0)::bigint as lo from v group by all),
d as (select a.id as src, b.id as dst, a.source, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) as bits from h a join h b on a.lang = b.lang and a.source = b.source and a.id < b.id),
s as (select src, dst, source, (0.42 + 0.23 + 0.17 + 0.10) * (1 - bits / 64.0) + 0.08 * case when bits <= 12 then 1 else 1 - bits / 64.0 end as sim from d),
p as (select src, dst, round_even((1 - sim) * 64, 2)::double as distance, (sim * 0.78 + case when source = '' then 0 else 0.12 end + 0.05 + case when round((1 - sim) * 64 / 0.92) <= 12 then 0.04 else 0 end)::double as score from s),
l as (select * from p where distance <= 6 or score >= 0.82 and distance <= 10)"""


def _hashed_documents(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    hashed = stage_table(dedupe.text_hashes(docs, "text", ["id", "lang", "source"]), "near-simhash")
    none = F.lit(None).cast("string")
    same = {c: F.col("simhash") for c in ("phash", "dhash", "whash", "colorhash", "crop_hash")}
    return hashed.withColumns(same | {"n": F.col("id"), "media_type": F.concat_ws("/", "lang", "source"), "dt_original": none, "source_kind": none, "source_root": none})


@query(f"with {_SIM} select src, dst, distance, round(score, 6) as score from l")
def near_dedupe_pairs(spark, d):
    return dedupe.near_pairs(_hashed_documents(spark, d)).select("src", "dst", "distance", F.round("score", 6).alias("score"))


@query(f"""with recursive {_SIM}, e as (select src as x, dst as y from l union select dst, src from l),
r as (select distinct x as id, x as c from e union select e.y as id, r.c from r join e on r.id = e.x where r.c < e.y)
select id, least(min(c), id) as component from r group by id""")
def near_dedupe_components(spark, d):
    return dedupe.near_groups(_hashed_documents(spark, d)).withColumnRenamed("n", "id")


@query("""with g as (select event_id, user_id, ts, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 86400 * 1000000::bigint then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from g)
select user_id, cast(island as bigint) as island, count(*) as members, min(ts) as first_at, max(ts) as last_at from s group by 1, 2 having count(*) > 1""")
def sequence_groups(spark, d):
    runs = dedupe.islands(t(spark, d, "events"), ["user_id"], "ts", 86400.0, "event_id")
    return runs.groupBy("user_id", F.col("island").cast("bigint").alias("island")).agg(F.count("*").alias("members"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")).where("members > 1")


@query(f"""with {A}, x as (select *, strptime(dt_original, '%Y-%m-%dT%H:%M:%S') as ts from a), g as (select *, case when lag(ts) over w is null or epoch(ts) - epoch(lag(ts) over w) > 180 then 1 else 0 end as fresh from x window w as (partition by source_locator order by ts, id)),
s as (select *, sum(fresh) over (partition by source_locator order by ts, id rows unbounded preceding) as island from g)
select source_locator as locator, cast(island as bigint) as island, count(*) as members, arg_min(id, {{'s': -orig_size, 'd': dt_original, 'i': id}}) as canonical_asset_id, min(dt_original) as first_at, max(dt_original) as last_at from s group by 1, 2 having count(*) > 1""")
def burst_groups(spark, d):
    return dedupe.sequence_groups(assets(spark, d)).withColumn("island", F.col("island").cast("bigint"))


@query("""with g as (select event_id, user_id, ts, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 21600 * 1000000::bigint then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from g)
select user_id, count(*) as members, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at from s group by user_id, island""")
def session_runs(spark, d):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return media.sequences(t(spark, d, "events"), "user_id", "ts", "21600 seconds").select("user_id", "members", shown("first_at"), shown("last_at"))


@query("""select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2""")
def daily_counts(spark, d):
    return media.daily(t(spark, d, "events"), "ts", ["event_type"]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


# --- listings -------------------------------------------------------------------------------

_DOM = "d as (select asset_id, arg_min(coalesce(keep_decision, ''), case keep_decision when 'HIDE' then 0 when 'CANONICAL' then 1 when 'KEEP' then 2 else 3 end) as dd from i group by 1)"
_LIST = f"with {A}, {M}, {I}, {_DOM}, h as (select distinct asset_id from i where keep_decision = 'HIDE') select a.id, a.dt_original, m.status as managed_status, coalesce(d.dd, '') as duplicate_decision from a left join m on m.asset_id = a.id left join d on d.asset_id = a.id where a.id not in (select asset_id from h)"
_SHOWN = ["id", "dt_original", "managed_status", "duplicate_decision"]


@query(f"{_LIST} order by case when coalesce(m.status, '') = 'BUILT' then 0 else 1 end, a.dt_original desc, a.id desc limit 100 offset 20")
def asset_listing_recent(spark, d):
    return catalog.listing(assets(spark, d), managed(spark, d), items(spark, d), offset=20).select(_SHOWN)


@query(f"{_LIST} order by coalesce(a.user_rating, 0) desc, coalesce(a.review_score, 0) desc, a.dt_original desc, a.id desc limit 50")
def asset_listing_rated(spark, d):
    return catalog.listing(assets(spark, d), managed(spark, d), items(spark, d), sort="rated", limit=50).select(_SHOWN)


@query(f"{_LIST} and (a.orig_filename ilike '%12%' or coalesce(a.title, '') ilike '%urgent%') and a.media_type = 'image' and coalesce(a.favorite, 0) = 1 order by coalesce(a.favorite, 0) desc, coalesce(a.user_rating, 0) desc, coalesce(a.review_score, 0) desc, a.dt_original desc, a.id desc limit 100".replace("(a.orig_filename ilike '%12%' or coalesce(a.title, '') ilike '%urgent%')", "(a.orig_filename ilike '%img_1%' or coalesce(a.title, '') ilike '%img_1%' or coalesce(a.description, '') ilike '%img_1%')"))
def asset_listing_filtered(spark, d):
    return catalog.listing(assets(spark, d), managed(spark, d), items(spark, d), sort="favorites", query="img_1", media_type="image", favorite_only=True).select(_SHOWN)


@query(f"with {A}, {I} select count(*) as n from a where id not in (select asset_id from i where keep_decision = 'HIDE') and coalesce(review_state, 'NEW') = 'REVIEWED' and source = 'src3'")
def asset_count(spark, d):
    return catalog.filtered(assets(spark, d), items(spark, d), review_state="REVIEWED", source="src3").agg(F.count("*").alias("n"))


@query(f"with {A}, {I} select id from a where id not in (select asset_id from i where keep_decision = 'HIDE')")
def hidden_antijoin(spark, d):
    return catalog.filtered(assets(spark, d), items(spark, d)).select("id")


@query(f"with {A} select id, user_rating, review_score from a where coalesce(review_state, '') in ('NEW', 'REVIEW', '') or user_rating is null order by coalesce(user_rating, 0), coalesce(review_score, 0) desc, dt_original desc, id desc limit 100 offset 10")
def review_queue(spark, d):
    return catalog.review_queue(assets(spark, d), offset=10).select("id", "user_rating", "review_score")


@query(f"""with {A}, w as (select id, lag(id) over w as previous_id, lead(id) over w as next_id from a window w as (order by dt_original desc nulls last, id desc))
select * from w where id in ((select max(id) from a), (select min(id) from a), (select quantile_disc(id, 0.5) from a))""")
def neighbors(spark, d):
    a = assets(spark, d)
    ends = a.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.expr("percentile_disc(0.5) within group (order by id)").cast("bigint").alias("mid")).first()
    keys = [("dt_original", False), ("id", False)]
    rows = [catalog.neighbors(a, ends[k], keys) for k in ("low", "mid", "high")]
    return rows[0].union(rows[1]).union(rows[2])


@query(f"with {A} select id, dt_original from a where substr(dt_original, 6, 5) = '03-15' order by dt_original desc, id desc limit 12")
def on_this_day(spark, d):
    return catalog.on_this_day(assets(spark, d), "03-15").select("id", "dt_original")


@query(f"""with {A}, g as (select substr(dt_original, 6, 5) as month_day, count(*) as asset_count, max(dt_original) as latest from a group by 1)
select *, cast((75 - dayofyear(strptime('2000-' || month_day, '%Y-%m-%d')) + 366) % 366 as bigint) as days_back from g order by days_back, month_day limit 12""")
def on_this_day_groups(spark, d):
    return catalog.on_this_day_groups(assets(spark, d), "03-15").withColumn("days_back", F.col("days_back").cast("bigint"))


@query(f"with {A} select strftime(strptime(dt_original, '%Y-%m-%dT%H:%M:%S'), '%B %Y') as moment, count(*) as n, min(dt_original) as first_at from a group by 1")
def moments(spark, d):
    return assets(spark, d).groupBy(timex.moment_label(F.col("dt_original")).alias("moment")).agg(F.count("*").alias("n"), F.min("dt_original").alias("first_at"))


# --- facets, coverage, health ---------------------------------------------------------------


@query("select coalesce(nullif(trim(source), ''), 'unknown') as source, count(*) as asset_count from documents group by 1")
def source_facets(spark, d):
    return catalog.sources(t(spark, d, "documents"))


@query("select coalesce(nullif(lang, ''), 'None') as value, count(*) as n from documents group by 1")
def histogram(spark, d):
    return catalog.histogram(t(spark, d, "documents"), "lang")


@query(f"""with {A} select count(*) as assets, count(*) filter (coalesce(dt_original, '') <> '') as with_time, count(*) filter (gps_lat is not null and gps_lon is not null) as with_location, count(*) filter (coalesce(title, '') <> '') as with_title,
count(*) filter (coalesce(description, '') <> '') as with_description, 0 as with_people, count(*) filter (coalesce(source_dt, 'unknown') not in ('unknown', 'filename', 'file_mtime', 'zip_mtime')) as strong_time, count(*) filter (coalesce(favorite, 0) = 1) as favorites, count(*) filter (user_rating is not null) as rated from a""")
def metadata_overview(spark, d):
    return catalog.overview(assets(spark, d).withColumn("people", F.lit(None).cast("array<string>")))


@query(f"""with {J} select job_type, count(*) as runs, count(*) filter (status in ('FAILED', 'RETRYABLE')) as failures, arg_max(error_msg, {{'t': created_at, 'i': id}}) filter (status in ('FAILED', 'RETRYABLE')) as latest_error from j group by 1""")
def pipeline_health(spark, d):
    return catalog.pipeline_health(job_events(spark, d))


@query(f"with {A}, {M} select count(*) filter (id not in (select asset_id from m where status = 'BUILT')) as missing_managed, count(*) filter (id % 4 <> 0) as missing_previews from a")
def library_gaps(spark, d):
    thumbs = t(spark, d, "orders").where("o_orderkey % 4 = 0").selectExpr("o_orderkey as asset_id", "'READY' as status")
    return catalog.library_gaps(assets(spark, d), managed(spark, d), thumbs)


@query(f"with {A}, {M} select count(distinct id) as total, count(distinct id) filter (id in (select asset_id from m where status = 'BUILT')) as ready, round_even(100.0 * count(distinct id) filter (id in (select asset_id from m where status = 'BUILT')) / count(distinct id), 1) as completion from a")
def import_progress(spark, d):
    return catalog.import_progress(assets(spark, d), managed(spark, d))


_FIELD_SQL = "f as (select doc_id as asset_id, 'title' as field_name from labels where quality = 1 union all select doc_id, 'people' from labels where toxic = 1 union all select doc_id, 'captured_at' from documents where doc_id % 3 <> 0)"
_DOC_ASSET = "x as (select doc_id as id, case when lang = 'en' then 'image' when lang = 'fr' then 'video' when lang = 'de' then 'raw' end as media_type from documents)"


def _doc_assets(spark, d):
    return t(spark, d, "documents").selectExpr("doc_id as id", "case when lang = 'en' then 'image' when lang = 'fr' then 'video' when lang = 'de' then 'raw' end as media_type")


def _doc_fields(spark, d):
    row = lambda df, name: df.select(F.col("doc_id").alias("asset_id"), F.lit(name).alias("field_name"), F.lit('"x"').alias("value_json"), F.lit(True).alias("is_canonical"))
    labels = t(spark, d, "labels")
    return row(labels.where("quality = 1"), "title").union(row(labels.where("toxic = 1"), "people")).union(row(t(spark, d, "documents").where("doc_id % 3 <> 0"), "captured_at"))


_W = {m: sum(w for _, _, w, ms in schema.STANDARD if m in ms) for m in ("image", "raw", "video")}
_TOTAL = f"case media_type when 'image' then {_W['image']} when 'raw' then {_W['raw']} when 'video' then {_W['video']} else {sum(w for _, _, w, _ in schema.STANDARD)} end"


@query(f"""with {_DOC_ASSET}, {_FIELD_SQL}, w as (select asset_id, sum(case field_name when 'title' then 6 when 'people' then 12 else 24 end) as filled from (select distinct * from f) group by 1)
select id, cast(coalesce(filled, 0) as int) as filled, {_TOTAL} as total, cast(round_even(100.0 * coalesce(filled, 0) / {_TOTAL}, 0) as int) as score from x left join w on w.asset_id = x.id""")
def completeness_score(spark, d):
    return catalog.completeness(_doc_assets(spark, d), _doc_fields(spark, d)).select("id", "filled", "total", "score")


@query(f"""with {_DOC_ASSET}, {_FIELD_SQL}, p as (select distinct f.* from f join x on x.id = f.asset_id where x.media_type is not null)
select field_name, 100.0 * count(*) / (select count(*) from x where media_type is not null) >= 50 as mostly, count(*) as present, (select count(*) from x where media_type is not null) - count(*) as missing from p group by field_name""")
def field_coverage(spark, d):
    out = catalog.field_coverage(_doc_assets(spark, d), _doc_fields(spark, d))
    return out.where("present > 0").select("field_name", (F.col("present") * 100.0 / F.col("applicable") >= 50).alias("mostly"), "present", "missing")


@query(f"with {_DOC_ASSET}, {_FIELD_SQL} select id from x where media_type in ('image', 'raw', 'video') and id not in (select asset_id from f where field_name = 'title')")
def missing_metadata(spark, d):
    return catalog.missing_field(_doc_assets(spark, d), _doc_fields(spark, d), "title").select("id")


@query(f"with {A} select source, source_kind, count(*) as assets, count(*) as with_time, count(*) filter (gps_lat is not null) as with_location, count(*) filter (coalesce(title, '') <> '') as with_title from a group by 1, 2")
def audit_by_source(spark, d):
    return catalog.audit_by_source(assets(spark, d))


@query("""with r as (select *, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents)
select doc_id, source from r where n <= 5 or i in (select cast(round_even(k * (n - 1) / 4.0, 0) as bigint) from range(5) t(k))""")
def audit_sample(spark, d):
    return catalog.evenly_sampled(t(spark, d, "documents"), ["source"], [F.col("doc_id")], 5).select("doc_id", "source")


@query(f"""with {A}, b as (select id, case when id % 2 = 0 then 'google' else 'local' end as source, source_dt from a)
select id, case when source = 'google' and source_dt = 'filename' then 'weak timestamp source (filename)' else '' end || case when source = 'google' and source_dt is null then 'unexpected Google timestamp source (missing)' when source = 'local' and source_dt is null then 'unexpected local timestamp source (missing)' else '' end as issues from b""")
def audit_issues(spark, d):
    rows = assets(spark, d).withColumn("source", F.when(F.col("id") % 2 == 0, "google").otherwise("local"))
    return rows.select("id", F.array_join(catalog.issues({"google": ["filename", "file_mtime"]}), "").alias("issues"))


@query("""with l as (select label as id, count(distinct vec_id) as faces, count(distinct vec_id % 97) as assets, arg_max(vec_id % 97, {'c': vec_id % 13, 'i': vec_id}) as cover_asset_id from embeddings group by 1) select * from l""")
def person_albums(spark, d):
    f = faces(spark, d)
    return catalog.albums(f.select(F.col("identity_id").alias("id")).distinct(), f).select("id", "faces", "assets", "cover_asset_id")


@query("select event_type as model_name, count(*) as n, max(ts) as last_seen from events group by 1 order by n desc, last_seen desc, model_name limit 1")
def modal_model(spark, d):
    return catalog.modal_model(t(spark, d, "events").select(F.col("event_type").alias("model_name"), F.col("ts").alias("created_at")))


@query("select user_id, event_type, arg_max(event_id, {'t': ts, 'i': event_id}) as event_id, arg_max(value, {'t': ts, 'i': event_id}) as value from events group by 1, 2")
def latest_per_key(spark, d):
    return catalog.latest_by_key(t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("select lower(split_part(p_name, ' ', 1)) as name, count(*) as n from part group by 1 having count(*) > 1")
def basename_repeats(spark, d):
    return scan.repeats(t(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("p")), "p")


@query("with r as (select p_name, count(*) as n from part group by lower(p_name), p_name having count(*) > 1) select count(*) as repeat_groups, cast(coalesce(sum(n - 1), 0) as bigint) as repeat_extras from (select lower(p_name) as p, count(*) as n from part group by 1 having count(*) > 1)")
def source_analysis(spark, d):
    return scan.repeat_totals(t(spark, d, "part"), "p_name")


# --- metadata -------------------------------------------------------------------------------


@query("""with e as (select c_custkey as id, c_name as title, c_mktsegment as media_type, c_acctbal as review_score, 'NEW' as status from customer where c_custkey % 3 <> 0),
i as (select c_custkey as id, case when c_custkey % 2 = 0 then upper(c_name) end as title, case when c_custkey % 5 <> 0 then 'X' end as media_type, case when c_custkey % 4 = 0 then 1.5 end as review_score, 'COPIED' as status from customer where c_custkey % 3 <> 1)
select coalesce(i.id, e.id) as id, coalesce(i.title, e.title) as title, case when i.id is not null then i.media_type else e.media_type end as media_type, coalesce(i.review_score, e.review_score) as review_score, coalesce(e.status, i.status) as status from e full join i on e.id = i.id""")
def upsert_merge(spark, d):
    c = t(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey as id", "c_name as title", "c_mktsegment as media_type", "c_acctbal as review_score", "'NEW' as status")
    new = c.where("c_custkey % 3 <> 1").selectExpr("c_custkey as id", "case when c_custkey % 2 = 0 then upper(c_name) end as title", "case when c_custkey % 5 <> 0 then 'X' end as media_type", "case when c_custkey % 4 = 0 then 1.5D end as review_score", "'COPIED' as status")
    return metadata.upsert(old, new)


@query(f"""with {A} select id as asset_id, 'title' as field_name, '"' || title || '"' as value_json, source as source_field from a where title is not null
union all select id, 'original_filename', '"' || orig_filename || '"', 'orig_filename' from a union all select id, 'provider', '"' || source || '"', 'source' from a
union all select id, 'captured_at', '"' || dt_original || '"', coalesce(source_dt, 'unknown') from a""")
def eav_unpivot(spark, d):
    a = assets(spark, d).withColumns({"keywords": F.lit(None).cast("array<string>"), "people": F.lit(None).cast("array<string>"), "source_gps": F.lit("x")})
    rows = metadata.ingest_fields(a).where("field_name in ('title', 'original_filename', 'provider', 'captured_at')")
    return rows.select("asset_id", "field_name", "value_json", "source_field")


_EVENTS_SQL = "v as (select user_id as asset_id, event_type as field_name, cast(event_id as varchar) as value, case when event_id % 9 = 0 then null else (event_id % 10) / 10.0 end as confidence, event_id as seq from events)"


@query(f"""with {_EVENTS_SQL}, k as (select asset_id, field_name, max(seq) filter (confidence is null) as cut, max(seq) as last from v group by 1, 2)
select asset_id, field_name, case when k.cut = k.last then max(value) filter (seq = k.last) else arg_max(value, {{'c': confidence, 's': seq}}) filter (confidence is not null and (k.cut is null or seq > k.cut)) end as value from v join k using (asset_id, field_name) group by asset_id, field_name, k.cut, k.last""")
def eav_canonical(spark, d):
    e = t(spark, d, "events").selectExpr("user_id as asset_id", "event_type as field_name", "cast(event_id as string) as value", "case when event_id % 9 = 0 then null else (event_id % 10) / 10.0D end as confidence", "event_id as seq")
    return metadata.canonical(e).select("asset_id", "field_name", "value")


@query(f"""with {A} select id, strftime(strptime(dt_original, '%Y-%m-%dT%H:%M:%S'), '%Y/%Y-%m') as target_relpath, strftime(strptime(dt_original, '%Y-%m-%dT%H:%M:%S'), '%Y%m%d_%H%M%S_') || substr(cast(id as varchar), 1, 8) || '.jpg' as target_filename, substr(sha1('managed|' || cast(id as varchar)), 1, 20) as managed_asset_id from a""")
def plan_targets(spark, d):
    return metadata.target_paths(assets(spark, d).withColumn("id", F.col("id").cast("string"))).withColumn("id", F.col("id").cast("bigint"))


@query("select conv_id, string_agg(text, ' ' order by turn) as extracted_text, count(*) as segments from conversations group by 1")
def group_concat_profile(spark, d):
    c = t(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("extracted_text"), F.count("*").alias("segments"))


@query("select c_custkey as id, array_to_string(list_sort(list_distinct([c_mktsegment, 'vip'])), ',') as added, case when c_custkey % 2 = 0 then '' else c_mktsegment end as removed from customer")
def label_sets(spark, d):
    c = t(spark, d, "customer").withColumn("labels", F.array("c_mktsegment"))
    gone = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise("nobody")
    return c.select(F.col("c_custkey").alias("id"), F.array_join(metadata.add_label(F.col("labels"), F.lit("vip")), ",").alias("added"), F.array_join(metadata.remove_label(F.col("labels"), gone), ",").alias("removed"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_field(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"""with {A}, k as (select *, regexp_replace(lower(regexp_replace(orig_filename, '\\.[^.]+$', '')), '(_original|-original|-edited|_edited|-main|_main|-overlay|_overlay)$', '') as key from a)
select id, coalesce(title, first_value(title ignore nulls) over w) as title, case when title is not null then 'sidecar_metadata' when first_value(title ignore nulls) over w is not null then 'paired_metadata' end as title_from,
case when title is not null then 0.94::double when first_value(title ignore nulls) over w is not null then 0.72::double end as title_confidence from k window w as (partition by key order by id rows between unbounded preceding and unbounded following)""")
def metadata_repair(spark, d):
    a = assets(spark, d)
    return repair.repaired(a, [("sidecar_metadata", a.select("id", "title"))], ["title"]).select("id", "title", "title_from", "title_confidence")


# --- vectors and search ---------------------------------------------------------------------


@query("select doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)) as n_tokens, list_aggregate(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1), 'max') as last_token from documents")
def tokenize(spark, d):
    words = text.tokens(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.array_max(words).alias("last_token"))


@query("""with w as (select item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)) as w from benchmark),
s as (select item_id, ('0x' || substr(sha1(w), 1, 8))::bigint % 96 as i, sum(case when ('0x' || substr(sha1(w), 9, 2))::bigint % 2 = 1 then -1.0 else 1.0 end) as v from w group by 1, 2),
n as (select item_id, sqrt(sum(v * v)) as n from s group by 1)
select s.item_id, s.i as dim, round(v / n.n, 6) as value from s join n using (item_id) where v <> 0""")
def text_embedding(spark, d):
    e = t(spark, d, "benchmark").select("item_id", F.posexplode(vector.text_embedding(text.tokens(F.col("text")))).alias("dim", "value"))
    return e.where("value <> 0").select("item_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query("""with w as (select doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)) as w from documents),
s as (select doc_id, ('0x' || substr(sha1(w), 1, 8))::bigint % 96 as i, sum(case when ('0x' || substr(sha1(w), 9, 2))::bigint % 2 = 1 then -1.0 else 1.0 end) as v from w group by 1, 2),
n as (select doc_id, sqrt(sum(v * v)) as n from s group by 1)
select s.doc_id, s.i as dim, round(v / n.n, 6) as value from s join n using (doc_id) where v <> 0""")
def document_embedding(spark, d):
    e = vector.embedded_texts(t(spark, d, "documents"), "doc_id", text.tokens(F.col("text")))
    return e.select("doc_id", "dim", F.round("value", 6).alias("value"))


@query("""with q as (select list_transform(embedding, lambda x: x::double) as q from embeddings where vec_id = 0)
select vec_id as id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::double), q), 6) as score from embeddings, q where vec_id <> 0 order by score desc, id limit 32""")
def cosine_topk(spark, d):
    f = faces(spark, d)
    ref = f.where("id = 0").select(F.col("vector").alias("centroid"))
    top = identity.candidates(f.where("id <> 0"), ref, floor=-1.0, k=32)
    return top.select("id", F.round("score", 6).alias("score"))


_POS = "e as (select label, vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as p from embeddings)"


@query(f"with {_POS} select label as identity_id, cast(p - 1 as bigint) as dim, round(sum(v) / count(*), 6) as value from e group by 1, 2")
def identity_centroids(spark, d):
    c = identity.centroids(faces(spark, d), "identity_id")
    return c.select("identity_id", F.posexplode("centroid").alias("dim", "value")).select("identity_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query(f"""with {_POS}, c as (select label, list(m order by p) as m from (select label, p, avg(v) as m from e group by 1, 2) group by 1)
select x.label as identity_id, round(list_cosine_similarity(x.m, y.m), 6) as score from c x, c y where y.label = 1 and x.label <> 1 order by score desc, identity_id limit 12""")
def related_identities(spark, d):
    c = identity.centroids(faces(spark, d), "identity_id")
    return identity.related(c, "identity_id", 1, threshold=-1.0).select("identity_id", F.round("score", 6).alias("score"))


@query("""select a.label as identity_id, round(avg(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double))), 6) as mean_similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by 1""")
def cluster_cohesion(spark, d):
    return identity.pairwise_similarity(faces(spark, d), "identity_id").select("identity_id", F.round("mean_similarity", 6).alias("mean_similarity"))


_NN = """p as (select a.vec_id as src, b.vec_id as dst, list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id)"""


@query(f"with {_NN} select src, dst, round(sim, 6) as sim from p qualify row_number() over (partition by src order by sim desc, dst) <= 3")
def nearest_neighbors(spark, d):
    return identity.nearest(faces(spark, d), 3).select("src", "dst", F.round("sim", 6).alias("sim"))


@query(f"""with recursive {_NN}, n as (select src, dst from p where sim >= 0.2 qualify row_number() over (partition by src order by sim desc, dst) = 1),
e as (select src as x, dst as y from n union select dst, src from n), r as (select x as id, x as c from e union select e.y, r.c from r join e on r.id = e.x where r.c < e.y)
select id, least(min(c), id) as component from r group by id""")
def nn_graph_components(spark, d):
    return identity.nearest_neighbor_components(faces(spark, d), floor=0.2)


@query(f"""with {_POS}, c as (select label, count(distinct vec_id) as n, list(m order by p) as m from (select label, p, avg(v) as m, any_value(vec_id) as vec_id from e group by 1, 2) group by 1),
k as (select label, count(*) as n from embeddings group by 1), s as (select a.vec_id as id, c.label as identity_id, k.n, list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), c.m) as score from embeddings a, c join k using (label)),
b as (select * from s qualify row_number() over (partition by id order by score desc) = 1)
select id, identity_id, round(score, 6) as score, case when score >= greatest(0.5, 0.95 - 0.01 * greatest(n - 5, 0)) then 'assign' else 'clarify' end as decision from b where score >= least(0.3, greatest(0.5, 0.95 - 0.01 * greatest(n - 5, 0)))""")
def identity_match(spark, d):
    f = faces(spark, d)
    return identity.match(f.drop("identity_id"), identity.centroids(f, "identity_id"), clarification=0.3).select("id", "identity_id", F.round("score", 6).alias("score"), "decision")


_TOK = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: length(x) > 1))"


@query(f"""with {A}, b as (select *, concat_ws(' ', orig_filename, title, description, dt_original, source, source_kind, media_type) as blob from a),
q as (select ['order', 'urgent'] as q), w as (select id, unnest(list_filter(regexp_extract_all(lower(blob), '[a-z0-9]+'), lambda x: length(x) > 1)) as w from b),
s as (select id, ('0x' || substr(sha1(w), 1, 8))::bigint % 96 as i, sum(case when ('0x' || substr(sha1(w), 9, 2))::bigint % 2 = 1 then -1.0 else 1.0 end) as v from w group by 1, 2),
qs as (select ('0x' || substr(sha1(w), 1, 8))::bigint % 96 as i, sum(case when ('0x' || substr(sha1(w), 9, 2))::bigint % 2 = 1 then -1.0 else 1.0 end) as v from (select unnest(q) as w from q) group by 1),
n as (select id, sqrt(sum(v * v)) as n from s group by 1), c as (select s.id, sum(s.v * qs.v) / (any_value(n.n) * (select sqrt(sum(v * v)) from qs)) as sim from s join qs using (i) join n on n.id = s.id group by s.id),
r as (select b.id, b.dt_original, round_even(coalesce(c.sim, 0) * 0.62 + len(list_intersect(q.q, {_TOK.format('blob')})) / 2.0 * 0.26 + coalesce(case when user_rating <> 0 then least(0.12, user_rating * 0.02) end, 0) + coalesce(least(0.08, greatest(0, review_score) * 0.01), 0) + case when review_state in ('REVIEWED', 'RANKED', 'KEPT') then 0.03 else 0 end, 4) as score from b cross join q left join c on c.id = b.id)
select id, score from r where score > 0 order by score desc, dt_original desc, id desc limit 100""")
def hybrid_search(spark, d):
    return search.search(assets(spark, d), "order urgent").select("id", "score")


@query(f"""with b as (select doc_id as id, concat_ws(' ', text, source, lang) as blob, text, case quality when 1 then 'KEPT' when 0 then 'REVIEW' end as review_state from documents left join labels using (doc_id) where toxic is distinct from 1),
q as (select ['thtion', 'lement', 'estion'] as q), w as (select id, unnest(list_filter(regexp_extract_all(lower(blob), '[a-z0-9]+'), lambda x: length(x) > 1)) as w from b),
s as (select id, ('0x' || substr(sha1(w), 1, 8))::bigint % 96 as i, sum(case when ('0x' || substr(sha1(w), 9, 2))::bigint % 2 = 1 then -1.0 else 1.0 end) as v from w group by 1, 2),
qs as (select ('0x' || substr(sha1(w), 1, 8))::bigint % 96 as i, sum(case when ('0x' || substr(sha1(w), 9, 2))::bigint % 2 = 1 then -1.0 else 1.0 end) as v from (select unnest(q) as w from q) group by 1),
n as (select id, sqrt(sum(v * v)) as n from s group by 1), c as (select s.id, sum(s.v * qs.v) / (any_value(n.n) * (select sqrt(sum(v * v)) from qs)) as sim from s join qs using (i) join n on n.id = s.id where n.n > 0 group by s.id),
r as (select b.id, round_even(coalesce(c.sim, 0) * 0.62 + len(list_intersect(q.q, {_TOK.format('blob')})) / 3.0 * 0.26 + case when len(list_intersect(q.q, {_TOK.format("coalesce(text, '')")})) > 0 then 0.14 else 0 end + case when review_state = 'KEPT' then 0.03 else 0 end, 4) as score from b cross join q left join c on c.id = b.id)
select id, score from r where score > 0 order by score desc, id desc limit 100""")
def document_search(spark, d):
    labels = t(spark, d, "labels")
    docs = t(spark, d, "documents").join(labels, "doc_id", "left")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    found = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("extracted_text"), "source", F.col("lang").alias("media_type"), F.expr("case quality when 1 then 'KEPT' when 0 then 'REVIEW' end").alias("review_state"), none("dt_original", "string"), none("gps_lat", "double"), none("gps_lon", "double"))
    return search.search(found, "thtion lement estion", hidden=labels.where("toxic = 1").select(F.col("doc_id").alias("asset_id"))).select("id", "score")


@query(f"""with {A} select id, round_even(0.01 + coalesce(case when user_rating <> 0 then least(0.12, user_rating * 0.02) end, 0) + coalesce(least(0.08, greatest(0, review_score) * 0.01), 0) + case when review_state in ('REVIEWED', 'RANKED', 'KEPT') then 0.03 else 0 end, 4) as score from a order by score desc, dt_original desc, id desc limit 40""")
def browse_search(spark, d):
    return search.search(assets(spark, d), limit=40).select("id", "score")


# --- tuning, journal, jobs, export ----------------------------------------------------------

_TUNE = "r as (select o_orderkey % 1000 / 1000.0 as score, case when (o_orderkey * 7) % 1000 + o_orderkey % 1000 > 1200 then 1 else 0 end as label, case when o_orderkey % 3 = 0 then 0.4 else 1.0 end::double as weight from orders)"


def _tune_rows(spark, d):
    return t(spark, d, "orders").selectExpr("cast(o_orderkey % 1000 / 1000.0 as double) as score", "case when (o_orderkey * 7) % 1000 + o_orderkey % 1000 > 1200 then 1 else 0 end as label", "case when o_orderkey % 3 = 0 then 0.4D else 1.0D end as weight")


@query(f"""with {_TUNE}, g as (select round(0.60 + k * 0.005, 4) as threshold from range(79) t(k)), w as (select score, label, weight::decimal(28, 6) as weight from r),
s as (select threshold, coalesce(sum(weight) filter (score >= threshold and label = 1), 0)::double as tp, coalesce(sum(weight) filter (score >= threshold and label = 0), 0)::double as fp, coalesce(sum(weight) filter (score < threshold and label = 0), 0)::double as tn, coalesce(sum(weight) filter (score < threshold and label = 1), 0)::double as fn from w, g group by 1)
select threshold::double as threshold, round_even(tp, 3) as tp, round_even(fp, 3) as fp, round_even(tn, 3) as tn, round_even(fn, 3) as fn, case when tp + fp > 0 then round_even(tp / (tp + fp), 4) else 0 end as precision, case when tp + fn > 0 then round_even(tp / (tp + fn), 4) else 0 end as recall, round_even(fp * 5 + fn, 4) as cost from s""")
def threshold_sweep(spark, d):
    return tuning.sweep(_tune_rows(spark, d))


@query(f"""with j as (select event_id as seq, user_id as target_id, cast(value as varchar) as after_json, event_id % 4 = 0 as undone from events)
select target_id, max(seq) filter (not undone) as seq from j group by 1""")
def undo_replay(spark, d):
    j = t(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("target_id"), F.col("event_id").cast("string").alias("after_json"), F.lit("").alias("before_json"), F.when(F.col("event_id") % 4 == 0, "x").alias("undone_at"))
    return journal.state(j).select("target_id", F.col("snapshot").cast("bigint").alias("seq"))


@query("select max(event_id) filter (event_id % 4 <> 0) as undo_seq, min(event_id) filter (event_id % 4 = 0) as redo_seq from events")
def journal_heads(spark, d):
    return journal.status(t(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "x").alias("undone_at")))


@query("""with e as (select user_id as id, event_id as seq, event_type, ts from events) select id, arg_max(event_type, seq) as status, min(ts) as created_at, max(ts) filter (event_type = 'purchase') as finished_at, count(*) > 0 as has_metrics from e group by 1""")
def job_state(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.lit("x").alias("job_type"), F.when(F.col("event_type") == "purchase", "COMPLETED").otherwise(F.col("event_type")).alias("status"), F.col("props").alias("error_msg"), F.col("ts").alias("at"), F.create_map(F.col("event_type"), F.col("event_id").cast("string")).alias("metrics"))
    out = jobs.current(e).withColumn("status", F.when(F.col("status") == "COMPLETED", "purchase").otherwise(F.col("status")))
    return out.select("id", "status", "created_at", "finished_at", (F.size("metrics") > 0).alias("has_metrics"))


@query("select event_id as id, case when props like '%not found%' then 'FAILED' else 'RETRYABLE' end as status from events")
def job_failures(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("id"), jobs.failure_status(F.col("props")).alias("status"))


@query("""with b as (select doc_id, case when doc_id % 11 = 0 then 'missing' when doc_id % 5 = 0 and doc_id % 10 = 0 then 'skipped' when doc_id % 5 = 0 then 'failed' else 'exported' end as status from documents) select status, count(*) as n from b group by 1""")
def export_summary(spark, d):
    i = F.col("doc_id")
    docs = t(spark, d, "documents").withColumn("status", sinks.export_status(i % 11 != 0, i % 5 == 0, i % 10 == 0))
    return sinks.summary(docs)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from pixelmill.plans import function_queries, graph_queries, view_queries  # noqa: E402, F401  they register their queries
