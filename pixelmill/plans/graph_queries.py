"""Queries of the clusterers, of tuning, of jobs and of the stage drivers over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill import schema
from pixelmill.operators import identity, jobs, metadata, pipeline, tuning
from pixelmill.plans.catalog_queries import _TUNE, A, J, _tune_rows, assets, faces, job_events, query, t

_PAIRS = "p as (select a.vec_id as src, b.vec_id as dst, list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id)"
_REACH = "r as (select x as id, x as c from e union select e.y, r.c from r join e on r.id = e.x where r.c < e.y)"


@query(f"with recursive {_PAIRS}, e as (select src as x, dst as y from p where sim >= 0.45), {_REACH} select id, least(min(c), id) as component from r group by id")
def threshold_components(spark, d):
    return identity.threshold_components(faces(spark, d), 0.45)


@query(f"""with recursive {_PAIRS}, n as (select v.vec_id as id, 1 + count(p.src) as n from embeddings v left join p on p.src = v.vec_id and p.sim >= 0.4 group by 1), k as (select id from n where n >= 3),
e as (select src as x, dst as y from p where sim >= 0.4 and src in (select id from k) and dst in (select id from k) union select id, id from k), {_REACH}, q as (select id, least(min(c), id) as component from r group by id),
b as (select src as id, arg_max(dst, {{'s': sim, 'd': dst}}) as dst from p where sim >= 0.4 and src not in (select id from k) and dst in (select id from k) group by 1)
select id, component from q union all select b.id, q.component from b join q on q.id = b.dst""")
def dbscan_clusters(spark, d):
    return identity.dbscan(faces(spark, d), 0.6, 3)


@query(f"""with recursive {_PAIRS}, n as (select * from p where sim >= 0.2 qualify row_number() over (partition by src order by sim desc, dst) <= 5), k as (select src as id from n group by 1 having avg(sim) >= 0.3),
e as (select src as x, dst as y from n where src in (select id from k) and dst in (select id from k) union select dst, src from n where src in (select id from k) and dst in (select id from k)), {_REACH} select id, least(min(c), id) as component from r group by id""")
def density_clusters(spark, d):
    return identity.density_components(faces(spark, d), 5, 0.2, 0.3)


@query("with e as (select label, vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as p from embeddings), c as (select label, list(m order by p) as m from (select label, p, avg(v) as m from e group by 1, 2) group by 1) select c.label as identity_id, round(avg(list_cosine_similarity(list_transform(x.embedding, lambda x: x::double), c.m)), 6) as cohesion from embeddings x join c using (label) group by 1")
def centroid_cohesion(spark, d):
    return identity.cohesion(faces(spark, d), "identity_id").select("identity_id", F.round("cohesion", 6).alias("cohesion"))


@query("select vec_id as id from embeddings where vec_id % 3 <> 0")
def dominant_vectors(spark, d):
    f = faces(spark, d).withColumn("vector", F.when(F.col("id") % 3 == 0, F.slice("vector", 1, 7)).otherwise(F.col("vector")))
    return identity.dominant_length(f).select("id")


@query(f"""with {_PAIRS}, s as (select vec_id, label, vec_id % 97 as a from embeddings), g as (select x.label, avg(p.sim) as m from p join s x on x.vec_id = p.src join s y on y.vec_id = p.dst where x.label = y.label group by 1), n as (select label, count(distinct a) as assets, count(*) as n from s group by 1)
select n.label as component, n.assets, n.n, round(g.m, 6) as mean_similarity from n join g using (label) where n.assets >= 30 and g.m >= -0.01""")
def qualified_clusters(spark, d):
    f = faces(spark, d)
    return identity.qualified(f.select("id", F.col("identity_id").alias("component")), f, 30, -0.01).select("component", "assets", "n", F.round("mean_similarity", 6).alias("mean_similarity"))


@query(f"with {_PAIRS}, s as (select x.label as component, p.sim from p join embeddings x on x.vec_id = p.src join embeddings y on y.vec_id = p.dst where x.label = y.label and p.src < p.dst), n as (select label as component, count(*) as n from embeddings group by 1) select component, n, round(avg(sim), 6) as mean_similarity, round(quantile_cont(sim, 0.1), 6) as p10_similarity from n join s using (component) group by 1, 2")
def cluster_statistics(spark, d):
    f = faces(spark, d).select("id", F.col("identity_id").alias("component"), "vector")
    out = tuning.cluster_stats(f).where("mean_similarity is not null")
    return out.select("component", "n", F.round("mean_similarity", 6).alias("mean_similarity"), F.round("p10_similarity", 6).alias("p10_similarity"))


@query("""with s as (select o_orderkey as face_id, o_custkey % 10 as identity_id, o_orderkey % 3 = 0 as own, o_orderkey % 100 / 100.0 as score from orders), k as (select *, case when own then 'positive' when score >= 0.60 then 'hard_negative' when score <= 0.45 then 'easy_negative' end as seed_type from s),
r as (select *, row_number() over (partition by identity_id, seed_type order by case when seed_type = 'easy_negative' then score else -score end, face_id) as r from k where seed_type is not null)
select identity_id, face_id, seed_type, own::int as label, case when seed_type = 'hard_negative' then 0.4 else 1.0 end::double as weight from r where r <= case seed_type when 'positive' then 24 when 'hard_negative' then 16 else 12 end""")
def seed_pairs(spark, d):
    s = t(spark, d, "orders").selectExpr("o_orderkey as face_id", "o_custkey % 10 as identity_id", "o_orderkey % 3 = 0 as own", "cast(o_orderkey % 100 / 100.0 as double) as score")
    return identity.seed_benchmark(s).select("identity_id", "face_id", "seed_type", "label", "weight")


@query(f"""with {_TUNE}, g as (select round(0.60 + k * 0.005, 4) as threshold from range(79) t(k)), w as (select score, label, weight::decimal(28, 6) as weight from r), s as (select threshold::double as threshold, coalesce(sum(weight) filter (score >= threshold and label = 1), 0)::double as tp, coalesce(sum(weight) filter (score >= threshold and label = 0), 0)::double as fp, coalesce(sum(weight) filter (score < threshold and label = 1), 0)::double as fn from w, g group by 1),
b as (select threshold, round_even(fp * 5 + fn, 4) as cost, case when tp + fp > 0 then round_even(tp / (tp + fp), 4) else 0 end as precision, case when tp + fn > 0 then round_even(tp / (tp + fn), 4) else 0 end as recall from s order by cost, precision desc, recall desc, threshold limit 1)
select threshold, cost, greatest(0.68, round_even(threshold - 0.08, 4))::double as clarification_floor, greatest(0.58, round_even(greatest(0.68, round_even(threshold - 0.08, 4)) - 0.12, 4))::double as candidate_floor from b""")
def best_threshold(spark, d):
    return tuning.best(tuning.sweep(_tune_rows(spark, d))).select("threshold", "cost", "clarification_floor", "candidate_floor")


@query(f"with {J} select id from j where not (job_type = 'purchase' and status in ('FAILED', 'RETRYABLE'))")
def cleared_jobs(spark, d):
    return jobs.cleared(job_events(spark, d), "purchase", ["FAILED", "RETRYABLE"]).select("id")


@query(f"with {J} select id, job_type from j order by created_at desc, id desc limit 20")
def newest_jobs(spark, d):
    return jobs.newest(job_events(spark, d)).select("id", "job_type")


@query("with e as (select event_type as job_type, case when value < 5 then 'FAILED' when value < 50 then 'RUNNING' else 'COMPLETED' end as status, event_id as seq from events) select job_type, arg_max(status, seq) as status, count(*) as events, count(*) filter (status = 'FAILED') as failures, arg_max(status, seq) = 'RUNNING' as active from e group by 1")
def live_progress(spark, d):
    e = t(spark, d, "events").selectExpr("event_type as job_type", "case when value < 5 then 'FAILED' when value < 50 then 'RUNNING' else 'COMPLETED' end as status", "event_id as seq", "cast(ts as string) as at")
    return pipeline.live_progress(e).select("job_type", "status", "events", "failures", "active")


@query(f"""with {A}, k as (select id, dt_original, orig_filename from a) select substr(sha1('managed|' || id::varchar), 1, 20) as id, id::varchar as asset_id, strftime(strptime(dt_original, '%Y-%m-%dT%H:%M:%S'), '%Y/%Y-%m/%Y%m%d_%H%M%S_') || substr(id::varchar, 1, 8) || '.jpg' as managed_path, case when id % 3 <> 1 and id % 2 = 0 then 'BUILT' else 'PLANNED' end as status from k""")
def plan_library(spark, d):
    from pixelmill.plans.catalog_queries import managed

    a = assets(spark, d).withColumn("id", F.col("id").cast("string"))
    return metadata.plan(a, managed(spark, d).withColumn("asset_id", F.col("asset_id").cast("string"))).select("id", "asset_id", "managed_path", "status")


@query("""with f as (select vec_id as id, label, embedding from embeddings where vec_id % 3 <> 0), e as (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as p from embeddings where vec_id % 3 = 0 and label = 3), c as (select list(m order by p) as m from (select p, avg(v) as m from e group by 1)), n as (select count(*) as n from embeddings where vec_id % 3 = 0 and label = 3),
s as (select f.id, list_cosine_similarity(list_transform(f.embedding, lambda x: x::double), c.m) as score from f, c) select id, round(score, 6) as score, case when score >= greatest(0.5, least(0.98, 0.98 - 0.02 * (n - 1))) then 'assign' when score >= 0.25 then 'clarify' else 'candidate' end as decision from s, n where score >= 0.1""")
def refreshed_matches(spark, d):
    f = faces(spark, d).withColumn("identity_id", F.when(F.col("id") % 3 == 0, F.col("identity_id")))
    return pipeline.refresh_matches(f, 3, 0.1, 0.25).select("id", F.round("score", 6).alias("score"), "decision")


def _sources(spark, d):
    docs = t(spark, d, "documents")
    name = F.concat(F.lit("/m/"), F.when(F.col("doc_id") % 2 == 0, "IMG_20240102_030405_").otherwise("pic"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 0, ".txt").otherwise(".jpg"))
    return docs.select(F.lit("/m").alias("locator"), name.alias("path"), F.length("text").cast("long").alias("size"), F.lit("2020-01-01T00:00:00").alias("mtime"), F.sha2("text", 256).alias("_sha"))


def _drive(spark, d):
    files = _sources(spark, d)
    tables = {name: schema.empty(spark, name) for name in ("assets", "managed_assets", "metadata_fields", "duplicate_groups", "duplicate_items", "extraction_results", "embeddings")}
    log = pipeline.Log()

    def hashed(now):
        sha = files.select(F.col("path").alias("source_path"), F.col("_sha"))
        return {"assets": now["assets"].join(sha, "source_path", "left").withColumn("sha256", F.col("_sha")).select(now["assets"].columns)}

    def listed(now):
        return pipeline.build_library(now["managed_assets"].select(F.col("managed_path").alias("path")))(now)

    stages = [("ingest", pipeline.ingest(files, "local")), ("again", pipeline.ingest(files, "local")), ("hash", hashed), ("plan", pipeline.plan_library), ("build", listed), ("exact", pipeline.exact_duplicates), ("index", pipeline.index_embeddings())]
    return pipeline.run(tables, stages, log), log


@query("""with f as (select doc_id, sha256(text) as sha, length(text) as size from documents where doc_id % 10 <> 0), g as (select sha, count(*) as n from f group by 1 having count(*) > 1)
select (select count(*) from f) as assets, (select count(*) from f) as managed, (select count(*) from g) as groups, (select coalesce(sum(n), 0)::bigint from g) as items, (select count(*) from f) as built, (select count(*) from f) as vectors, 14::bigint + 7 as events""")
def pipeline_run(spark, d):
    out, log = _drive(spark, d)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n(out["assets"], "assets"), n(out["managed_assets"], "managed"), n(out["duplicate_groups"], "groups"), n(out["duplicate_items"], "items"), n(out["managed_assets"].where("status = 'BUILT'"), "built"), n(out["embeddings"], "vectors"), n(log.events(spark), "events")]
    first = parts[0]
    for p in parts[1:]:
        first = first.crossJoin(p)
    return first


@query(f"with {A}, b as (select *, case when id % 2 = 0 then 'google' else 'local' end as s from a) select s as source, '## ' || s || ': ' || count(*) || ' assets, ' || count(*) || ' with time, ' || count(gps_lat) || ' with location, ' || count(title) || ' with title' as line from b group by 1")
def audit_heads(spark, d):
    rows = assets(spark, d).withColumn("source", F.when(F.col("id") % 2 == 0, "google").otherwise("local"))
    return pipeline.audit_report(rows, {"google": ["filename"]}).where("line like '## %'")
