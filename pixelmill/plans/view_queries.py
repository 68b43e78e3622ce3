"""Queries of the catalog's views, queues, overviews and edits over the driver's tables, each with its DuckDB SQL.

Line items stand in for faces, suppliers for identities, orders for assets and their previews,
conversations for extraction results.  A relation is written once and read by both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators import dedupe, edits, identity, journal, metadata, search, views
from pixelmill.plans.catalog_queries import A, _ASSET, I, items, query, t

AT = "2024-06-01T00:00:00"


class _Rel:
    """A relation over one of the driver's tables: a DataFrame, and ``name as (select ...)`` for SQL.

    What the engines write differently: ``iso(time)``, ``listof(values)`` and ``varchar(9)``.
    """

    def __init__(self, name: str, table: str, columns: dict[str, str], where: str = "true"):
        self.table, self.columns, self.where = table, columns, where
        duck = re.sub(r"iso\((\w+)\)", r"strftime(\1, '%Y-%m-%dT%H:%M:%S')", ", ".join(f"{e} as {c}" for c, e in columns.items()))
        self.sql = f"{name} as (select {duck.replace('listof(', 'list_value(')} from {table} where {where})"

    def __call__(self, spark, d: str) -> DataFrame:
        shown = lambda e: re.sub(r"iso\((\w+)\)", r"""date_format(\1, "yyyy-MM-dd'T'HH:mm:ss")""", e).replace("listof(", "array(").replace("varchar(9)", "string")
        return t(spark, d, self.table).where(self.where).selectExpr(*[f"{shown(e)} as {c}" for c, e in self.columns.items()])


_TEXT = "cast(null as varchar(9))"
ASSETS = _Rel("a", "orders", _ASSET | {
    "dt_original": "iso(o_orderdate)", "status": "case o_orderkey % 5 when 0 then 'EMBEDDED' when 1 then 'COPIED' when 2 then 'ERROR' else 'NEW' end",
    "target_relpath": "case when o_orderkey % 11 <> 0 then 'x' end", "target_filename": "'y'", "last_updated": "concat('u', cast(o_custkey % 50 as varchar(9)))",
    "people": "case when o_orderkey % 3 = 0 then listof(concat('Person ', cast(o_custkey % 20 as varchar(9))), 'Joanna') end",
    "sha256": _TEXT, "last_embed_hash": _TEXT, "exiftool_version": _TEXT, "error_msg": _TEXT,
})
MANAGED = _Rel("m", "orders", {"asset_id": "o_orderkey", "status": "case o_orderkey % 4 when 0 then 'PLANNED' when 3 then 'FAILED' else 'BUILT' end", "managed_path": "concat('lib/', cast(o_orderkey as varchar(9)))", "built_at": _TEXT, "error_msg": _TEXT}, "o_orderkey % 7 <> 1")
THUMBS = _Rel("th", "lineitem", {"asset_id": "l_orderkey", "kind": "case l_linenumber when 1 then 'small' when 2 then 'video_preview' else 'primary' end", "path": "concat('t/', cast(l_partkey as varchar(9)))", "status": "case when l_quantity < 20 then 'FAILED' else 'READY' end"}, "l_linenumber <= 3")
FACES = _Rel("f", "lineitem", {
    "id": "l_orderkey * 10 + l_linenumber", "asset_id": "l_orderkey", "identity_id": "case when l_partkey % 3 <> 0 then l_suppkey end", "embedding_ref": "concat('e', cast(l_orderkey * 10 + l_linenumber as varchar(9)))",
    "status": "case l_linenumber when 7 then 'REJECTED' when 6 then 'REVIEW' when 5 then 'LABELED' when 4 then 'CLUSTERED' else 'DETECTED' end", "created_at": "iso(l_shipdate)",
}, "l_orderkey % 3 = 0")
IDENTITIES = _Rel("n", "supplier", {"id": "s_suppkey", "label": "s_name", "status": "case s_suppkey % 3 when 0 then 'CONFIRMED' when 1 then 'CLUSTERED' else 'UNCONFIRMED' end", "created_at": "'c'"})
CLARIFY = _Rel("c", "lineitem", {
    "face_id": "l_orderkey * 10 + l_linenumber", "suggested_identity_id": "l_suppkey", "suggested_label": "concat('maybe ', cast(l_suppkey as varchar(9)))", "score": "l_discount * 10", "rationale": "'r'",
    "status": "case when l_quantity < 25 then 'OPEN' when l_quantity < 40 then 'RESOLVED' else 'DISMISSED' end", "created_at": "iso(l_shipdate)", "resolved_at": _TEXT,
}, "l_linenumber in (5, 6) and l_orderkey % 3 = 0")
VECTORS = _Rel("v", "lineitem", {"id": "concat('e', cast(l_orderkey * 10 + l_linenumber as varchar(9)))", "asset_id": "l_orderkey", "embedding_type": "case when l_linenumber = 2 then 'text' else 'face' end", "model_name": "case when l_returnflag = 'A' then '' else l_returnflag end", "vector": "l_tax"})
FIELDS = _Rel("x", "orders", {
    "asset_id": "o_orderkey", "field_name": "case o_orderkey % 3 when 0 then 'duration_seconds' when 1 then 'title' else 'people' end", "source_name": "case when o_orderkey % 2 = 0 then 'face_label' else 'sidecar' end",
    "source_field": "cast(o_custkey % 100 as varchar(9))", "value_json": "case o_orderkey % 3 when 0 then '12.5' when 1 then '\"A title\"' else '[\"Ann\", \"bob\"]' end", "value_text": "case o_orderkey % 9 when 0 then ' 7.25 ' when 3 then 'none' end",
    "value_real": "case when o_orderkey % 9 = 6 then cast(o_custkey as double) end", "is_canonical": "o_orderkey % 4 <> 3", "updated_at": "iso(o_orderdate)",
})
EXTRACTED = _Rel("ex", "conversations", {"id": "concat('x', cast(conv_id * 1000 + turn as varchar(9)))", "asset_id": "conv_id", "result_type": "role", "segment_start_ms": "turn * 100", "text_content": "text", "status": "case when turn % 5 = 4 then 'FAILED' else 'READY' end", "created_at": "'c'"})
SEARCHES = _Rel("s", "customer", {"id": "concat('s', cast(c_custkey as varchar(9)))", "label": "c_name", "params_json": "'{}'", "created_at": "'c'", "updated_at": "cast(c_nationkey as varchar(9))"})
_THUMB = "p as (select asset_id, arg_min(path, {'k': case kind when 'primary' then 0 else 1 end, 'p': path}) as thumbnail_path from th where kind in ('primary', 'video_preview') group by 1)"


_V = f"with {ASSETS.sql}, {MANAGED.sql}, {THUMBS.sql}, {FACES.sql}, {IDENTITIES.sql}, {CLARIFY.sql}, {VECTORS.sql}, {FIELDS.sql}, {EXTRACTED.sql}, {SEARCHES.sql}, {_THUMB}"


# --- records --------------------------------------------------------------------------------


@query(f"{_V} select a.id, a.dt_original, m.status as managed_status, m.managed_path, p.thumbnail_path from a left join m on m.asset_id = a.id left join p on p.asset_id = a.id")
def asset_records(spark, d):
    return views.asset_records(ASSETS(spark, d), MANAGED(spark, d), THUMBS(spark, d)).select("id", "dt_original", "managed_status", "managed_path", "thumbnail_path")


@query(f"{_V} select id, dt_original from a where gps_lat is not null and gps_lon is not null order by dt_original desc, id desc limit 32")
def geotagged_assets(spark, d):
    return views.geotagged(ASSETS(spark, d)).select("id", "dt_original")


@query(f"{_V} select field_name, source_name, source_field, case when field_name = 'people' then '[\"Ann\",\"bob\"]' else json_extract_string('{{\"v\":' || value_json || '}}', '$.v') end as value from x where asset_id = 7")
def asset_fields(spark, d):
    return views.fields_of(FIELDS(spark, d), 7).select("field_name", "source_name", "source_field", F.replace("value", F.lit(", "), F.lit(",")).alias("value"))


@query(f"{_V} select kind, path, status from th where asset_id = 3 order by kind, path")
def asset_artifacts(spark, d):
    return views.belonging(THUMBS(spark, d), 3, ["kind", "path"]).select("kind", "path", "status")


@query(f"{_V} select id, model_name from v where asset_id = 3 and embedding_type = 'face'")
def asset_embeddings(spark, d):
    return views.belonging(VECTORS(spark, d), 3, ["id"], embedding_type="face").select("id", "model_name")


@query(f"{_V} select id, segment_start_ms, text_content from ex where asset_id = 2 and result_type = 'user'")
def extraction_results(spark, d):
    return views.belonging(EXTRACTED(spark, d), 2, ["segment_start_ms", "id"], result_type="user").select("id", "segment_start_ms", "text_content")


@query(f"{_V} select f.id, f.identity_id, v.model_name, v.vector from f join v on v.id = f.embedding_ref where f.status <> 'REJECTED' and v.embedding_type = 'face' and v.model_name = 'N'")
def face_vectors(spark, d):
    return views.face_embeddings(FACES(spark, d), VECTORS(spark, d), "N").select("id", "identity_id", "model_name", "vector")


_RECORD = f"{_V}, r as (select f.id, f.asset_id, f.identity_id, f.status, f.created_at, n.label as identity_label, a.orig_filename, a.media_type, m.managed_path, p.thumbnail_path, c.suggested_label, c.score as clarification_score, c.status as clarification_status from f left join n on n.id = f.identity_id left join a on a.id = f.asset_id left join m on m.asset_id = f.asset_id left join p on p.asset_id = f.asset_id left join c on c.face_id = f.id)"
_RECORD_COLUMNS = ["id", "asset_id", "identity_id", "status", "created_at", "identity_label", "orig_filename", "media_type", "managed_path", "thumbnail_path", "suggested_label", "clarification_score", "clarification_status"]


def _records(spark, d):
    return views.face_records(FACES(spark, d), IDENTITIES(spark, d), ASSETS(spark, d), MANAGED(spark, d), THUMBS(spark, d), CLARIFY(spark, d))


@query(f"{_RECORD} select * from r")
def face_records(spark, d):
    return _records(spark, d).select(_RECORD_COLUMNS)


@query(f"{_RECORD} select * from r where status <> 'REJECTED' order by identity_id is not null, created_at desc, id desc limit 50")
def face_listing(spark, d):
    return views.face_listing(_records(spark, d)).select(_RECORD_COLUMNS)


@query(f"{_V} select c.face_id, c.score, f.asset_id, f.identity_id, f.status as face_status, a.orig_filename, n.label as suggested_identity_label from c join f on f.id = c.face_id left join n on n.id = c.suggested_identity_id left join a on a.id = f.asset_id where c.status = 'OPEN' order by c.score desc, c.created_at desc, c.face_id limit 200")
def face_suggestions(spark, d):
    return views.suggestions(CLARIFY(spark, d), FACES(spark, d), IDENTITIES(spark, d), ASSETS(spark, d)).select("face_id", "score", "asset_id", "identity_id", "face_status", "orig_filename", "suggested_identity_label")


@query(f"{_V}, {I} select i.asset_id, i.score, i.keep_decision, a.orig_size, m.managed_path, p.thumbnail_path from i join a on a.id = i.asset_id left join m on m.asset_id = a.id left join p on p.asset_id = a.id where i.group_id = 5 and coalesce(i.keep_decision, '') <> 'HIDE'")
def group_members(spark, d):
    return views.group_items(items(spark, d), 5, ASSETS(spark, d), MANAGED(spark, d), THUMBS(spark, d)).select("asset_id", "score", "keep_decision", "orig_size", "managed_path", "thumbnail_path")


@query(f"{_V} select id, 'part' as how from (select id from a where list_contains(list_transform(people, lambda p: lower(p)), 'joanna') order by dt_original desc, id desc limit 48) union all select id, 'whole' from (select id from a where list_contains(people, 'Person 3') order by dt_original desc, id desc limit 48)")
def tagged_assets(spark, d):
    part, whole = views.tagged(ASSETS(spark, d), "Ann"), views.tagged(ASSETS(spark, d), "person 3", exact=True)
    return part.select("id", F.lit("part").alias("how")).unionAll(whole.select("id", F.lit("whole").alias("how")))


@query(f"{_V} select asset_id, arg_min(path, {{'k': case kind when 'primary' then 0 when 'video_preview' then 1 else 2 end, 'p': path}}) as thumbnail_path from th where status = 'READY' group by 1")
def ready_previews(spark, d):
    return views.previews(THUMBS(spark, d), ready=True)


@query(f"{_V}, e as (select asset_id, string_agg(text_content, ' ' order by segment_start_ms, id) as extracted_text from ex where status = 'READY' group by 1), l as (select f.asset_id, string_agg(distinct n.label, ' ' order by n.label) as face_labels from f join n on n.id = f.identity_id group by 1) select a.id, e.extracted_text, l.face_labels, case when a.id % 3 = 1 then 'A title' end as location_text from a left join e on e.asset_id = a.id left join l on l.asset_id = a.id")
def text_profiles(spark, d):
    fields = FIELDS(spark, d).where("field_name = 'title'").withColumns({"field_name": F.lit("location"), "value_text": F.lit("A title")})
    named = FACES(spark, d).join(IDENTITIES(spark, d).select(F.col("id").alias("identity_id"), "label"), "identity_id")
    return search.text_profiles(ASSETS(spark, d), EXTRACTED(spark, d), fields, named).select("id", "extracted_text", "face_labels", "location_text")


# --- queues ---------------------------------------------------------------------------------

_DONE = "a.status in ('EMBEDDED', 'COPIED')"


@query(f"{_V} select a.id, m.managed_path from a join m on m.asset_id = a.id where m.status = 'BUILT'")
def built_assets(spark, d):
    return views.built(ASSETS(spark, d), MANAGED(spark, d)).select("id", "managed_path")


_TO_BUILD = "from a join m on m.asset_id = a.id where a.target_relpath is not null and a.target_filename is not null and (m.status in ('PLANNED', 'FAILED') or a.status = 'NEW')"


@query(f"{_V} select a.id, m.status as managed_status {_TO_BUILD}")
def build_queue(spark, d):
    return views.to_build(ASSETS(spark, d), MANAGED(spark, d)).select("id", "managed_status")


@query(f"{_V} select least(count(*), 700) as n, count(*) as of_all {_TO_BUILD}")
def build_queue_count(spark, d):
    a, m = ASSETS(spark, d), MANAGED(spark, d)
    return views.count_to_build(a, m, 700).crossJoin(views.count_to_build(a, m).withColumnRenamed("n", "of_all"))


@query(f"{_V} select a.id, m.managed_path from a join m on m.asset_id = a.id where {_DONE} and m.status = 'BUILT' and not exists (select 1 from th where th.asset_id = a.id and th.status = 'READY' and th.kind = case when a.media_type = 'video' then 'video_preview' else 'primary' end)")
def preview_queue(spark, d):
    return views.to_preview(ASSETS(spark, d), MANAGED(spark, d), THUMBS(spark, d)).select("id", "managed_path")


@query(f"{_V} select a.id, a.last_updated from a join m on m.asset_id = a.id where {_DONE} and m.status = 'BUILT'")
def repair_queue(spark, d):
    return views.to_repair(ASSETS(spark, d), MANAGED(spark, d)).select("id", "last_updated")


@query(f"""{_V} select a.id, p.thumbnail_path, x.duration_seconds from a join m on m.asset_id = a.id left join p on p.asset_id = a.id
left join (select asset_id, coalesce(value_real, case when value_text is not null then coalesce(try_cast(trim(value_text) as double), 0) end) as duration_seconds from x where field_name = 'duration_seconds' and is_canonical) x on x.asset_id = a.id
where {_DONE} and m.status = 'BUILT' and a.id not in (select asset_id from f)""")
def detection_queue(spark, d):
    return views.to_detect(ASSETS(spark, d), MANAGED(spark, d), THUMBS(spark, d), FIELDS(spark, d), FACES(spark, d)).select("id", "thumbnail_path", "duration_seconds")


@query(f"{_V} select id, label, updated_at from s order by updated_at desc, id desc limit 20")
def saved_searches(spark, d):
    return views.saved_searches(SEARCHES(spark, d)).select("id", "label", "updated_at")


# --- overviews ------------------------------------------------------------------------------


@query(f"{_V} select (select count(*) from a) as assets_total, (select count(*) from a where status = 'EMBEDDED') as embedded_assets, (select count(*) from a where status = 'COPIED') as copied_assets, (select count(*) from a where status = 'ERROR') as errored_assets, (select count(*) from m) as managed_assets, (select count(*) from th where status = 'READY') as ready_thumbnails, (select count(*) from events) as jobs")
def library_overview(spark, d):
    return views.overview(ASSETS(spark, d), MANAGED(spark, d), THUMBS(spark, d), t(spark, d, "events"))


@query(f"""{_V}, k as (select identity_id, count(*) as k from f where status <> 'REJECTED' group by 1) select count(*) as total_faces, count(*) filter (identity_id is null and status <> 'REJECTED') as unlabeled_faces, count(*) filter (identity_id is not null and status = 'CLUSTERED') as clustered_faces, count(*) filter (identity_id is not null and status = 'LABELED') as labeled_faces,
count(*) filter (status = 'REVIEW') as review_faces, count(*) filter (status = 'REJECTED') as rejected_faces, count(distinct asset_id) filter (status <> 'REJECTED') as assets_with_faces, (select count(*) from n) as identities, (select count(*) from n where status = 'CONFIRMED') as confirmed_identities, (select count(*) from n where status = 'CLUSTERED') as clustered_identities,
(select count(*) from n join k on k.identity_id = n.id where status = 'CLUSTERED' and k >= 3) as strong_clustered_identities, (select count(*) from c where status = 'OPEN') as clarifications_open from f""")
def face_overview(spark, d):
    return views.face_overview(FACES(spark, d), IDENTITIES(spark, d), CLARIFY(spark, d))


@query(f"{_V} select n.id, n.label, count(f.id) as face_count from n left join f on f.identity_id = n.id where n.status = 'CLUSTERED' group by 1, 2 order by face_count desc, label, n.id limit 20")
def identity_listing(spark, d):
    return views.identity_listing(IDENTITIES(spark, d), FACES(spark, d), "CLUSTERED", 20).select("id", "label", "face_count")


@query(f"{_V} select n.id, count(distinct f.id) as face_count, count(distinct f.asset_id) as asset_count, max(f.created_at) as last_seen_at from n left join f on f.identity_id = n.id and f.status <> 'REJECTED' group by 1")
def identity_records(spark, d):
    return views.identity_records(IDENTITIES(spark, d), FACES(spark, d)).select("id", "face_count", "asset_count", "last_seen_at")


_SEEN = "select a.id, max(f.created_at) as last_seen_at, count(f.id) as face_count from f join n on n.id = f.identity_id join a on a.id = f.asset_id where {} and f.status <> 'REJECTED' group by a.id, a.dt_original order by max(f.created_at) desc, a.dt_original desc, a.id desc limit 48"


@query(f"{_V} {_SEEN.format(chr(39) + 'supplier#000000003' + chr(39) + ' = lower(n.label)')}")
def person_assets(spark, d):
    return views.assets_of(FACES(spark, d), IDENTITIES(spark, d), ASSETS(spark, d), MANAGED(spark, d), label="SUPPLIER#000000003").select("id", "last_seen_at", "face_count")


@query(f"{_V} {_SEEN.format('n.id = 2')}")
def identity_assets(spark, d):
    return views.assets_of(FACES(spark, d), IDENTITIES(spark, d), ASSETS(spark, d), MANAGED(spark, d), identity_id=2).select("id", "last_seen_at", "face_count")


_MODEL = "select model_name from f join v on v.id = f.embedding_ref where f.identity_id = 2 and f.status <> 'REJECTED' and embedding_type = 'face' and model_name <> ''"


@query(f"{_V}, u as ({_MODEL}) select (select model_name from u group by 1 order by model_name = 'R' desc, count(*) desc, model_name limit 1) as preferred, (select model_name from u group by 1 order by count(*) desc, model_name limit 1) as other")
def identity_model(spark, d):
    f, v = FACES(spark, d), VECTORS(spark, d)
    pick = lambda p, name: views.identity_model(f, v, 2, p).agg(F.first("model_name").alias(name))
    return pick("R", "preferred").crossJoin(pick("no such model", "other"))


@query(f"""with {A}, y as (select *, strptime(dt_original, '%Y-%m-%dT%H:%M:%S') as ts from a), g as (select l.id as a_id, r.id as b_id, abs(epoch(l.ts) - epoch(r.ts)) as gap, l.ts::date = r.ts::date as same_day, least(l.orig_size, r.orig_size) / greatest(l.orig_size, r.orig_size) as ratio from y l join y r on l.source_locator = r.source_locator and substr(l.dt_original, 1, 10) = substr(r.dt_original, 1, 10) and l.id < r.id)
select a_id, b_id, case when gap > 180 then 0.0 else round(least(0.95, 0.55 + 0.12 + case when same_day then 0.05 else 0 end + case when gap <= 10 then 0.15 when gap <= 30 then 0.10 when gap <= 60 then 0.06 else 0.03 end + case when ratio >= 0.95 then 0.05 when ratio >= 0.8 then 0.03 else 0 end), 3) end::double as score from g""")
def sequence_scores(spark, d):
    a = ASSETS(spark, d).withColumn("day", F.substring("dt_original", 1, 10))
    pairs = a.alias("a").join(a.alias("b"), (F.col("a.source_locator") == F.col("b.source_locator")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), views.sequence_score("a", "b").alias("score"))


# --- edits ----------------------------------------------------------------------------------

_CHANGED = "select o_orderkey as asset_id, concat('h', cast(o_custkey as varchar)) as sha256 from orders where o_orderkey % 6 = 0"


def _done(spark, d):
    none = F.lit(None).cast("string")
    return t(spark, d, "orders").where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("asset_id"), F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("sha256"), F.lit("e").alias("embed_hash"), F.lit("13.0").alias("tool_version"), F.when(F.col("o_orderkey") % 12 == 0, "w").otherwise(none).alias("warning"))


_HASHES = _Rel("h", "orders", {"asset_id": "o_orderkey", "algorithm": "'sha256'", "scope": "case when o_orderkey % 2 = 0 then 'managed' else 'source' end", "value": "'old'", "created_at": "'c'"}, "o_orderkey % 5 = 0")


@query(f"{_V}, z as ({_CHANGED}) select a.id, z.sha256, case when z.asset_id is not null then 'EMBEDDED' else a.status end as status, case when z.asset_id is not null then 'e' end as last_embed_hash, case when z.asset_id is not null and m.asset_id is not null then 'BUILT' else m.status end as managed_status from a left join z on z.asset_id = a.id left join m on m.asset_id = a.id")
def mark_embedded(spark, d):
    a, m, _ = edits.mark_done(ASSETS(spark, d), MANAGED(spark, d), _HASHES(spark, d), _done(spark, d), "EMBEDDED", AT)
    return a.join(m.select(F.col("asset_id").alias("id"), F.col("status").alias("managed_status")), "id", "left").select("id", "sha256", "status", "last_embed_hash", "managed_status")


@query(f"{_V}, z as ({_CHANGED}) select m.asset_id, case when z.asset_id is not null then 'BUILT' else m.status end as status, case when z.asset_id is not null then '{AT}' end as built_at, case when z.asset_id % 12 = 0 then 'w' end as error_msg from m left join z using (asset_id)")
def mark_copied(spark, d):
    return edits.mark_done(ASSETS(spark, d), MANAGED(spark, d), _HASHES(spark, d), _done(spark, d), "COPIED", AT)[1].select("asset_id", "status", "built_at", "error_msg")


@query(f"with {_HASHES.sql}, z as ({_CHANGED}) select asset_id, scope, value from h where not (scope = 'managed' and asset_id in (select asset_id from z)) union all select asset_id, 'managed', sha256 from z")
def record_hashes(spark, d):
    return edits.mark_done(ASSETS(spark, d), MANAGED(spark, d), _HASHES(spark, d), _done(spark, d), "COPIED", AT)[2].select("asset_id", "scope", "value")


@query(f"{_V} select a.id, case when id % 4 = 0 then case when id % 8 = 0 then 'ERROR' else 'NEW' end else a.status end as status, case when id % 8 = 0 and m.asset_id is not null then 'FAILED' else m.status end as managed_status, case when id % 4 = 0 then 'loc' else a.source_locator end as source_locator from a left join m on m.asset_id = a.id")
def update_statuses(spark, d):
    a = ASSETS(spark, d)
    changes = a.where("id % 4 = 0").select(F.col("id").alias("asset_id"), F.when(F.col("id") % 8 == 0, "ERROR").otherwise("NEW").alias("status"), F.lit("why").alias("error"), F.lit("loc").alias("source_locator"))
    a, m = edits.update_status(a, MANAGED(spark, d), changes, AT)
    a = edits.update_locators(a, changes, AT)
    return a.join(m.select(F.col("asset_id").alias("id"), F.col("status").alias("managed_status")), "id", "left").select("id", "status", "managed_status", "source_locator")


@query(f"{_V} select kind, path, status, asset_id from th where asset_id % 2 <> 0 or kind <> 'primary' union all select 'primary', 'new', 'READY', o_orderkey from orders where o_orderkey % 2 = 0")
def replace_previews(spark, d):
    new = t(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("asset_id"), F.lit("primary").alias("kind"), F.lit("new").alias("path"), F.lit("READY").alias("status"))
    return edits.replaced(THUMBS(spark, d), new, ["asset_id", "kind"])


@query(f"{_V}, w as (select concat('new ', cast(c_custkey % 30 as varchar)) as label, c_custkey + 1000000 as id from customer union all select upper(s_name), s_suppkey + 2000000 from supplier) select id, label, status from n union all select min(id), min(label), 'CONFIRMED' from w where lower(label) not in (select lower(label) from n) group by lower(label)")
def create_identities(spark, d):
    w = t(spark, d, "customer").selectExpr("concat('new ', cast(c_custkey % 30 as string)) as label", "c_custkey + 1000000 as id").union(t(spark, d, "supplier").selectExpr("upper(s_name)", "s_suppkey + 2000000"))
    return edits.create_identities(IDENTITIES(spark, d), w, AT).select("id", "label", "status")


def _merged(spark, d):
    mapping = t(spark, d, "supplier").selectExpr("s_suppkey as source", "s_suppkey - 1 as target").where("source % 4 = 3").union(spark.createDataFrame([(1, 1), (2, 99999999)], "source long, target long"))
    return edits.merge_identities(IDENTITIES(spark, d), FACES(spark, d), CLARIFY(spark, d), mapping)


@query(f"{_V} select id, case when identity_id % 4 = 3 then identity_id - 1 else identity_id end as identity_id from f")
def merge_identities(spark, d):
    return _merged(spark, d)[1].select("id", "identity_id")


@query(f"{_V} select 'identity' as kind, id, null as to_id from n where id % 4 <> 3 union all select 'suggestion', face_id, case when suggested_identity_id % 4 = 3 then suggested_identity_id - 1 else suggested_identity_id end from c")
def merged_identities_left(spark, d):
    i, _, c = _merged(spark, d)
    return i.select(F.lit("identity").alias("kind"), "id", F.lit(None).cast("long").alias("to_id")).union(c.select(F.lit("suggestion"), "face_id", "suggested_identity_id"))


_FACE = 125  # line 5 of order 12


@query(f"{_V}, o as (select identity_id from f where id = {_FACE}) select id, case when id = {_FACE} or identity_id in (select identity_id from o) then 2 else identity_id end as identity_id, case when (id = {_FACE} or identity_id in (select identity_id from o) or identity_id = 2) and status <> 'REJECTED' then 'LABELED' else status end as status from f")
def assign_face(spark, d):
    return edits.assign(IDENTITIES(spark, d), FACES(spark, d), CLARIFY(spark, d), _FACE, 2, AT)[1].select("id", "identity_id", "status")


@query(f"{_V} select f.id, case when id % 20 = 5 then 'REVIEW' when id = {_FACE + 1} then 'REJECTED' when id = {_FACE + 2} and identity_id is null then 'DETECTED' else status end as status, case when id = {_FACE + 1} then null else identity_id end as identity_id from f")
def review_faces(spark, d):
    f, c = FACES(spark, d), CLARIFY(spark, d)
    f, c = edits.dismiss(f, c, _FACE + 2, AT)
    f, c = edits.reject(f, c, _FACE + 1, AT)
    new = f.where("id % 20 = 5").select(F.col("id").alias("face_id"), F.lit(1).cast("long").alias("suggested_identity_id"), F.lit("one").alias("suggested_label"), F.lit(0.5).cast("double").alias("score"), F.lit("why").alias("rationale")).distinct()
    return edits.suggest(f, c, new, AT)[0].select("id", "status", "identity_id")


@query(f"{_V} select face_id, status, score from c where face_id % 20 <> 5 union all select id, 'OPEN', 0.5 from f where id % 20 = 5")
def save_suggestions(spark, d):
    f, c = FACES(spark, d), CLARIFY(spark, d)
    new = f.where("id % 20 = 5").select(F.col("id").alias("face_id"), F.lit(1).cast("long").alias("suggested_identity_id"), F.lit("one").alias("suggested_label"), F.lit(0.5).cast("double").alias("score"), F.lit("why").alias("rationale"))
    return edits.suggest(f, c, new, AT)[1].select("face_id", "status", "score")


@query(f"{_V} select asset_id, string_agg(label, ',' order by lower(label)) as people from (select distinct f.asset_id, n.label from f join n on n.id = f.identity_id where f.status <> 'REJECTED' union select asset_id, unnest(['Ann', 'bob']) from x where field_name = 'people' and source_name <> 'face_label') group by 1")
def people_of_faces(spark, d):
    return edits.synced_people(FIELDS(spark, d), FACES(spark, d), IDENTITIES(spark, d)).select("asset_id", F.array_join("people", ",").alias("people"))


@query(f"{_V} select id, asset_id, identity_id, status from f where asset_id % 2 <> 0 union all select asset_id * 10 + 9, asset_id, null, 'DETECTED' from (select distinct asset_id from f where asset_id % 2 = 0)")
def replace_faces(spark, d):
    f = FACES(spark, d)
    assets = f.where("asset_id % 2 = 0").select("asset_id").distinct()
    new = assets.select((F.col("asset_id") * 10 + 9).alias("id"), "asset_id")
    return edits.replace_faces(f, FIELDS(spark, d), new, assets, AT)[0].select("id", "asset_id", "identity_id", "status")


@query(f"with {I} select group_id, asset_id, score, keep_decision from i where group_id % 2 = 1 union all select o_custkey % 10 + 1000, o_orderkey, 1.0, case when o_orderkey = min(o_orderkey) over (partition by o_custkey % 10) then 'CANONICAL' end from orders")
def replace_groups(spark, d):
    rows = items(spark, d).withColumn("rationale", F.lit("x"))
    groups = rows.select(F.col("group_id").alias("id")).distinct().select("id", F.when(F.col("id") % 2 == 0, "near").otherwise("exact").alias("group_type"), F.lit("OPEN").alias("status"), F.lit(0).cast("long").alias("canonical_asset_id"), F.lit("c").alias("created_at"), F.lit(None).cast("string").alias("resolved_at"))
    new = t(spark, d, "orders").select((F.col("o_custkey") % 10 + 1000).alias("group_id"), F.col("o_orderkey").alias("asset_id"), F.lit(1.0).cast("double").alias("score"), F.lit("r").alias("rationale"))
    new_groups = new.groupBy(F.col("group_id").alias("id")).agg(F.min("asset_id").alias("canonical_asset_id"))
    return edits.replace_groups(groups, rows, "near", new_groups, new, AT)[1].select("group_id", "asset_id", "score", "keep_decision")


@query(f"{_V} select id, case when c_custkey % 2 = 0 then 'new label' else s.label end as label, 'c' as created_at, case when c_custkey % 2 = 0 then '{AT}' else s.updated_at end as updated_at from s join customer on s.id = concat('s', cast(c_custkey as varchar)) union all select 'fresh', 'f', '{AT}', '{AT}'")
def save_searches(spark, d):
    new = t(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("concat('s', cast(c_custkey as string)) as id", "'new label' as label", "'{}' as params_json").union(spark.createDataFrame([("fresh", "f", "{}")], "id string, label string, params_json string"))
    return edits.save_searches(SEARCHES(spark, d), new, AT).select("id", "label", "created_at", "updated_at")


@query(f"{_V} select n.id, case when n.id % 4 = 1 then 'renamed' else n.label end as label, case when n.id % 4 = 1 then 'CONFIRMED' else n.status end as status from n where n.id % 4 <> 2 or n.id % 4 = 2")
def restore_identities(spark, d):
    now = IDENTITIES(spark, d)
    log = now.where("id % 4 = 1").select(F.col("id").cast("long").alias("seq"), F.col("id").alias("target_id"), F.to_json(F.struct("label", "status")).alias("before_json"), F.to_json(F.struct(F.lit("renamed").alias("label"), F.lit("CONFIRMED").alias("status"))).alias("after_json"), F.lit(None).cast("string").alias("undone_at"))
    return edits.restored(now, journal.state(log), ["label", "status"]).select("id", "label", "status")


@query(f"with {I} select group_id, asset_id, case when group_id = 3 then case when asset_id % 7 = 0 then 'KEEP' else 'HIDE' end when group_id = 4 then 'KEEP' when group_id = 5 then coalesce(keep_decision, 'SKIP') when group_id = 6 and asset_id % 5 = 0 then keep_decision else keep_decision end as keep_decision from i")
def resolve_groups(spark, d):
    rows = items(spark, d)
    kept = [r["asset_id"] for r in rows.where("group_id = 3 and asset_id % 7 = 0").select("asset_id").distinct().collect()]  # what a person has picked in one group
    return dedupe.skip(dedupe.keep_all(dedupe.resolve(rows, 3, -1, kept), 4), 5).select("group_id", "asset_id", "keep_decision")


@query(f"{_V} select a.id, case when a.id % 2 = 0 then least(5, greatest(0, a.id % 9 - 1)) else a.user_rating end as user_rating, case when a.id % 2 = 0 then 'KEPT' else a.review_state end as review_state from a")
def review_assets(spark, d):
    a = ASSETS(spark, d)
    changes = a.where("id % 2 = 0").select("id", (F.col("id") % 9 - 1).cast("int").alias("user_rating"), F.lit("kept").alias("review_state"), F.lit(None).cast("double").alias("review_score"), F.lit(None).cast("boolean").alias("favorite"))
    return metadata.reviewed(a, changes).select("id", "user_rating", "review_state")


@query(f"{_V} select a.id, case when a.id % 2 = 0 and a.id % 3 = 0 then 'T' else a.title end as title, case when a.id % 2 = 0 then 1.5 else a.gps_lat end as gps_lat from a")
def promote_updates(spark, d):
    a = ASSETS(spark, d)
    u = a.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, "T").alias("title"), F.lit(1.5).cast("double").alias("gps_lat"))
    return metadata.promote(a, u).select("id", "title", "gps_lat")


@query(f"{_V} select asset_id, field_name, source_name from x where not (asset_id = 7 and field_name = 'title') union all select 7, 'rating', 'user'")
def edit_fields(spark, d):
    x = FIELDS(spark, d)
    change = spark.createDataFrame([(7, "rating", "user")], "asset_id long, field_name string, source_name string")
    return metadata.set_field(metadata.delete_field(x, 7, "title"), change).select("asset_id", "field_name", "source_name")


@query(f"{_V}, k as (select id from n where status = 'CONFIRMED') select id, case when identity_id in (select id from k) or status = 'REJECTED' then identity_id end as identity_id, case when identity_id in (select id from k) or status = 'REJECTED' then status else 'DETECTED' end as status from f")
def reset_faces(spark, d):
    return identity.reset_machine_made(FACES(spark, d), IDENTITIES(spark, d)).select("id", "identity_id", "status")


@query("""with j as (select event_id as seq, case when event_id % 4 = 0 then 'x' end as undone from events), u as (select max(seq) filter (undone is null) as u, min(seq) filter (undone is not null) as r from j)
select seq, 'undo' as how, case when seq = u then 'now' else undone end as undone_at from j, u union all select seq, 'redo', case when seq = r then null else undone end from j, u union all select seq, 'restore', case when seq > 50 and undone is null then 'now' else undone end from j
union all select seq, 'record', undone from j where undone is null union all select (select max(seq) from j) + 1, 'record', null""")
def journal_moves(spark, d):
    j = t(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "x").alias("undone_at"), F.lit(None).cast("string").alias("redone_at"))
    entry = spark.createDataFrame([(None, None)], "undone_at string, redone_at string")
    moved = {"undo": journal.undo(j, "now"), "redo": journal.redo(j, "now"), "restore": journal.restore_to(j, 50, "now"), "record": journal.record(j, entry)}
    out = None
    for how, df in moved.items():
        part = df.select("seq", F.lit(how).alias("how"), "undone_at")
        out = part if out is None else out.unionAll(part)
    return out


@query("select event_id as seq from events order by 1 desc limit 8")
def journal_history(spark, d):
    return journal.history(t(spark, d, "events").select(F.col("event_id").alias("seq")))
