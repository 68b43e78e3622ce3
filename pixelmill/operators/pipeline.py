"""Stage drivers: each takes the catalog's tables by name, returns those it changes, and logs its job.

A catalog is a dict of DataFrames.  A stage stages what it makes, so that a later failure doesn't
undo it; its job's events go to ``jobs.current``.  Decoders (image hashes, face detection,
text recognition) are outside: their outputs are tables that a stage takes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill import schema
from pixelmill.functions import text, vector
from pixelmill.operators import catalog, dedupe, edits, identity, jobs, metadata, repair, search, sinks
from pixelmill.session import stage_table
from pixelmill.sources import scan

Catalog = dict[str, DataFrame]
Stage = Callable[[Catalog], Catalog]


class Log:
    """Job events in order; ``events`` makes the table that ``jobs.current`` folds."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def __call__(self, job_type: str, status: str, error: str | None = None, metrics: dict[str, str] | None = None) -> None:
        seq = len(self.rows) + 1
        self.rows.append((job_type, seq, job_type, status, error, f"{seq:09d}", metrics or {}))

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "id string, seq long, job_type string, status string, error_msg string, at string, metrics map<string,string>")


def run(tables: Catalog, stages: list[tuple[str, Stage]], log: Log) -> Catalog:
    """``tables`` after all stages; every table that a stage returns is staged and counted in its job's metrics."""

    def ran(name: str, stage: Stage) -> Callable[[Catalog], Catalog]:
        def one(now: Catalog) -> Catalog:
            made = {k: stage_table(v, f"stage-{name}-{k}") for k, v in stage(now).items()}
            log(name, "RUNNING", None, {k: str(v.count()) for k, v in made.items()})
            return now | made

        return one

    return jobs.run_stages(tables, [(name, ran(name, stage)) for name, stage in stages], log)


# --- stages ---------------------------------------------------------------------------------


def ingest(files: DataFrame, source: str | None = None) -> Stage:
    """Scanned files merged into the assets, and their metadata rows."""

    def stage(now: Catalog) -> Catalog:
        incoming = schema.conform(scan.records(files, source).withColumn("status", F.lit("NEW")), "assets")
        assets = metadata.upsert(now["assets"], incoming)
        rows = schema.conform(metadata.ingest_fields(incoming), "metadata_fields")
        return {"assets": assets, "metadata_fields": edits.replaced(now["metadata_fields"], rows, ["asset_id", "field_name", "source_name"])}

    return stage


def plan_library(now: Catalog) -> Catalog:
    planned = metadata.plan(now["assets"], now["managed_assets"])
    paths = metadata.target_paths(now["assets"]).select("id", F.col("target_relpath").alias("_p"), F.col("target_filename").alias("_f"), F.col("managed_asset_id").alias("_m"))
    columns = now["assets"].columns
    assets = now["assets"].join(paths, "id", "left").withColumns({"target_relpath": F.col("_p"), "target_filename": F.col("_f"), "managed_asset_id": F.col("_m")}).select(columns)
    return {"assets": assets, "managed_assets": schema.conform(planned, "managed_assets")}


def build_library(listing: DataFrame) -> Stage:
    """Managed copies against the files that exist: BUILT or MISSING; built assets that were NEW are COPIED."""

    def stage(now: Catalog) -> Catalog:
        managed = sinks.build_status(now["managed_assets"], listing).select(now["managed_assets"].columns)
        done = managed.where("status = 'BUILT'").select(F.col("asset_id").alias("id"), F.lit(1).alias("_b"))
        assets = now["assets"].join(done, "id", "left").withColumn("status", F.when((F.col("_b") == 1) & (F.col("status") == "NEW"), "COPIED").otherwise(F.col("status"))).select(now["assets"].columns)
        return {"assets": assets, "managed_assets": managed}

    return stage


def exact_duplicates(now: Catalog) -> Catalog:
    """Groups of equal content by SHA-256, in place of older ones of that type."""
    found = dedupe.exact_groups(now["assets"])
    groups = found.select(F.concat(F.lit("exact-"), F.substring("sha256", 1, 20)).alias("id"), "canonical_asset_id", "sha256")
    members = now["assets"].select(F.col("id").alias("asset_id"), "sha256").join(groups.select(F.col("id").alias("group_id"), "sha256"), "sha256")
    rows = members.select("group_id", "asset_id", F.lit(1.0).cast("double").alias("score"), F.lit("same content").alias("rationale"))
    g, i = edits.replace_groups(now["duplicate_groups"], now["duplicate_items"], "exact", groups.select("id", "canonical_asset_id"), rows, "")
    return {"duplicate_groups": g, "duplicate_items": i}


def near_duplicates(hashes: DataFrame) -> Stage:
    """Groups of near duplicates from perceptual hashes (see ``dedupe.near_groups``); ``n`` is a long id of the assets."""

    def stage(now: Catalog) -> Catalog:
        of = dedupe.near_groups(hashes).join(hashes.select("n", F.col("id").alias("asset_id")), "n").withColumn("group_id", F.concat(F.lit("near-"), F.col("component").cast("string")))
        order = dedupe.canonical_order(F.col("orig_size"), F.col("dt_original"), F.col("asset_id"))
        first = of.join(now["assets"].select(F.col("id").alias("asset_id"), "orig_size", "dt_original"), "asset_id").groupBy(F.col("group_id").alias("id")).agg(F.min_by("asset_id", order).alias("canonical_asset_id"))
        rows = of.select("group_id", "asset_id", F.lit(None).cast("double").alias("score"), F.lit("alike").alias("rationale"))
        g, i = edits.replace_groups(now["duplicate_groups"], now["duplicate_items"], "near", first, rows, "")
        return {"duplicate_groups": g, "duplicate_items": i}

    return stage


def repair_metadata(sources: list[tuple[str, DataFrame]], columns: list[str]) -> Stage:
    """Missing values from ranked sources and from variants of one shot."""

    def stage(now: Catalog) -> Catalog:
        own = [("catalog", now["assets"].select("id", *columns)), *sources]
        return {"assets": metadata.promote(now["assets"], repair.repaired(now["assets"], own, columns).select("id", *columns))}

    return stage


def extract_content(extracted: DataFrame) -> Stage:
    """Recognised texts in place of those with the same id."""
    return lambda now: {"extraction_results": edits.replaced(now["extraction_results"], schema.conform(extracted, "extraction_results"), ["id"])}


def index_embeddings(model_name: str = "hashed-text") -> Stage:
    """A hashed vector of each asset's search text, in place of its older one of that model."""

    def stage(now: Catalog) -> Catalog:
        texts = now["extraction_results"].where("status = 'READY'").groupBy("asset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("segment_start_ms", F.lit(0)).alias("at"), "id", "text_content"))), lambda x: x["text_content"]), " ").alias("extracted_text"))
        found = now["assets"].join(texts.withColumnRenamed("asset_id", "id"), "id", "left")
        words = text.tokens(search.search_text(found))
        cells = vector.embedded_texts(found, "id", words).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("cells"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(vector.TEXT_DIM - 1)), lambda k: F.coalesce(F.try_element_at("cells", k.cast("long")), F.lit(0.0)))
        rows = cells.select(text.row_id(F.lit(model_name), F.col("id")).alias("id"), F.col("id").alias("asset_id"), F.lit("text").alias("embedding_type"), F.lit(model_name).alias("model_name"), dense.alias("vector"))
        return {"embeddings": edits.replaced(now["embeddings"], schema.conform(rows, "embeddings"), ["asset_id", "embedding_type", "model_name"])}

    return stage


def detect_faces(threshold: float = 0.9) -> Stage:
    """Detected faces with vectors clustered into identities (see ``identity.cluster``)."""

    def stage(now: Catalog) -> Catalog:
        faces, people = identity.cluster(now["face_vectors"], now["face_identities"], threshold)
        return {"face_vectors": faces, "face_identities": people}

    return stage


def refresh_matches(faces: DataFrame, identity_id, floor: float = 0.60, clarification: float = 0.72) -> DataFrame:
    """(id, score, decision): unassigned faces like one confirmed identity; ``assign`` at its bar, else ``clarify`` or ``candidate``."""
    own = identity.centroids(faces.where((F.col("identity_id") == identity_id) & (F.col("status") != "REJECTED")), "identity_id", unit=True)
    free = faces.where("identity_id is null and status <> 'REJECTED'")
    scored = free.join(F.broadcast(own.select("n", "centroid").limit(1))).withColumn("score", vector.cosine(F.col("vector"), F.col("centroid")))
    decision = F.when(F.col("score") >= vector.review_threshold(F.col("n")), "assign").when(F.col("score") >= clarification, "clarify").otherwise("candidate")
    return scored.where(F.col("score") >= floor).select("id", "score", decision.alias("decision"))


# --- reports --------------------------------------------------------------------------------


def live_progress(events: DataFrame, at: str | None = None) -> DataFrame:
    """Per job type its last state, rows so far and failures, up to a time."""
    seen = events if at is None else events.where(F.col("at") <= at)
    last = seen.groupBy("job_type").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("events"), F.count_if(F.col("status").isin("FAILED", "RETRYABLE")).alias("failures"), F.max("at").alias("updated_at"))
    return last.withColumn("active", F.col("status").isin("QUEUED", "RUNNING"))


def audit_report(assets: DataFrame, weak: dict[str, list[str]], samples: int = 3) -> DataFrame:
    """(source, line): the audit as text lines, a head, counts and evenly spaced samples with their issues for each source."""
    counts = catalog.audit_by_source(assets).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("assets", "with_time", "with_location", "with_title")])
    head = counts.select("source", F.lit(0).alias("at"), F.concat(F.lit("## "), F.coalesce("source", F.lit("unknown")), F.format_string(": %d assets, %d with time, %d with location, %d with title", "assets", "with_time", "with_location", "with_title")).alias("line"))
    picked = catalog.evenly_sampled(assets, ["source"], [F.col("dt_original"), F.col("id")], samples)
    found = F.array_join(catalog.issues(weak), "; ")
    rows = picked.select("source", F.lit(1).alias("at"), F.concat(F.lit("- "), F.coalesce("orig_filename", F.lit("?")), F.when(found != "", F.concat(F.lit(" ["), found, F.lit("]"))).otherwise("")).alias("line"))
    return reduce(DataFrame.unionByName, [head, rows]).orderBy("source", "at", "line").select("source", "line")
