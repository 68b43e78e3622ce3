"""Known answers of catalog operators on small inputs."""

import zipfile

import numpy as np
from pyspark.sql import functions as F

from pixelmill import schema
from pixelmill.functions import geo, text, timex, vector
from pixelmill.operators import catalog, dedupe, identity, jobs, journal, metadata, pipeline, search, sinks, tuning, views
from pixelmill.operators.graph import connected_components
from pixelmill.sources import nested, scan


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_locations(spark):
    lit = F.lit
    assert one(spark, geo.iso6709(lit("+51.5000-0.1200+35.5/"))).asDict() == {"lat": 51.5, "lon": -0.12, "alt": 35.5}
    assert one(spark, geo.parse_location(lit("Latitude, Longitude: 51.445824, -0.1195754")))["lat"] == 51.445824
    assert one(spark, geo.parse_location(lit("51.5 N; 0.12 W")))["lon"] == -0.12
    assert one(spark, geo.parse_location(lit("nowhere"))) is None
    assert one(spark, geo.parse_location(lit("95, 10"))) is None


def test_times(spark):
    lit = F.lit
    assert str(one(spark, timex.from_filename(lit("IMG_20240131_235959")))) == "2024-01-31 23:59:59"
    assert one(spark, timex.from_filename(lit("IMG_20241399_999999"))) is None
    assert str(one(spark, timex.from_local_text(lit("Friday March 1,2024 3:05 PM GMT")))) == "2024-03-01 15:05:00"
    assert one(spark, timex.zone_name(lit("+0530"))) == "UTC+05:30"
    z = one(spark, timex.with_zone(lit("2024-01-01T00:30:00"), lit("+01:00")))
    assert z["utc"] == "2023-12-31T23:30:00+00:00" and z["local"].endswith("+01:00")
    assert one(spark, timex.days_back(lit("03-14"), lit("03-15"))) == 1
    assert one(spark, timex.exif_to_iso(lit("2024:01:02 03:04:05.67"))) == "2024-01-02T03:04:05"
    whole = timex.prefer_name_at_whole_hours(timex.parse_iso(lit("2024-01-01T10:00:00")), timex.parse_iso(lit("2024-01-01T08:00:30")))
    assert str(one(spark, whole)) == "2024-01-01 10:00:00"


def test_text(spark):
    lit = F.lit
    assert one(spark, text.provider(lit("/a/takeout-1.zip"))) == "google"
    assert one(spark, text.provider(lit("/a/x.zip"), F.array(lit("memories/1-main.jpg")))) == "snapchat"
    assert one(spark, text.media_type(lit(".INSV"))) == "video"
    assert one(spark, text.pair_key(lit("IMG_1-edited.JPG"))) == "img_1"
    assert one(spark, text.human_size(lit(1536))) == "1.5 KB"
    assert one(spark, text.text_list(lit('["a", "", "b"]'))) == ["a", "b"]
    assert one(spark, text.sidecar_names(lit("d/a.jpg"))) == ["d/a.json", "d/a.jpg.json", "d/a.supplemental-metadata.json", "d/a.jpg.supplemental-metadata.json"]
    assert one(spark, text.typed_scalar(lit("0x10")))["number"] == 16.0


def test_sidecar_shapes():
    got = nested.parse_sidecar('{"mediaMetadata": {"photoTakenTime": {"timestamp": {"seconds": "1700000000"}}, "geoDataExif": {"latitudeE7": 515000000, "longitudeE7": -1200000, "altitude": 35}}, "title": {"text": "T"}, "description": {"caption": "C"}, "recognizedFaces": [{"name": "Ann"}, {"label": "Bo"}]}')
    assert got == {"epoch": 1700000000.0, "lat": 51.5, "lon": -0.12, "alt": 35.0, "title": "T", "description": "C", "people": ["Ann", "Bo"]}
    assert nested.parse_sidecar("{broken")["title"] is None
    assert nested.wire_records("1 {\n2 {\n7: 20240101120000\n}\n}\n2 {\n}") == [{"2": [{"7": [20240101120000]}]}]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "takeout.zip", "w") as z:
        z.writestr("p/IMG_20240102_030405.jpg", b"x")
        z.writestr("p/b.jpg", b"yy")
        z.writestr("p/b.jpg.json", '{"title": "Bee", "photoTakenTime": {"timestamp": "1700000000"}}')
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    members = scan.archive_members(spark, [str(tmp_path)])
    assert members.where("member is null").count() == 1
    side = members.select(F.col("member").alias("name"), "content").where("content is not null")
    media = members.where("member is not null").select(F.col("member").alias("path"), F.col("archive").alias("locator"), "size", "mtime")
    got = {r["orig_filename"]: r for r in scan.records(scan.joined_sidecars(media, side), "google").collect()}
    assert set(got) == {"IMG_20240102_030405.jpg", "b.jpg"}
    assert got["b.jpg"]["title"] == "Bee" and got["b.jpg"]["dt_original"] == "2023-11-14T22:13:20"
    assert got["IMG_20240102_030405.jpg"]["dt_original"] == "2024-01-02T03:04:05"


def test_history_by_rank(spark):
    h = spark.createDataFrame([("e", '{"Saved Media": [{"Date": "2024-05-01 02:19:31 UTC", "Media Type": "Video", "Location": "Latitude, Longitude: 1.5, 2.5"}, {"Date": "2024-05-01 10:24:55 UTC", "Media Type": "Video", "Location": ""}]}')], "export string, content string")
    m = spark.createDataFrame([("e", "memories/2024-05-01_A-main.mp4"), ("e", "memories/2024-05-01_B-main.mp4"), ("e", "memories/2024-05-01_B-overlay.png")], "export string, member string")
    got = {r["member"]: r["captured_at"] for r in scan.history_joined(m, scan.history_rows(h)).collect()}
    assert got == {"memories/2024-05-01_A-main.mp4": "2024-05-01T10:24:55", "memories/2024-05-01_B-main.mp4": "2024-05-01T02:19:31"}


def test_upsert_twice_changes_nothing(spark):
    new = schema.conform(spark.createDataFrame([("a", "T", ["k"])], "id string, title string, keywords array<string>"), "assets")
    once = metadata.upsert(schema.empty(spark, "assets"), new)
    again = metadata.upsert(once, schema.conform(new.select("id"), "assets"))
    assert once.count() == again.count() == 1
    assert again.first()["title"] == "T" and again.first()["keywords"] == ["k"]


def test_canonical_closed_form_equals_fold(spark):
    rng = np.random.default_rng(4)
    rows = [("a%d" % (i % 40), "f", "s%d" % i, "x", str(i), True, None if rng.random() < 0.2 else float(rng.integers(0, 5)) / 5, i) for i in range(600)]
    e = spark.createDataFrame(rows, "asset_id string, field_name string, source_name string, source_field string, value string, is_canonical boolean, confidence double, seq long")
    fold = {r["asset_id"]: r["value"] for r in metadata.exact_fold(e).where("is_canonical").collect()}
    assert fold == {r["asset_id"]: r["value"] for r in metadata.canonical(e).collect()}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_identity_methods(spark):
    at = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    f = spark.createDataFrame([(i, i, at(a)) for i, a in enumerate([0] * 5 + [10] * 5 + [120] * 6)], "id long, asset_id long, vector array<double>")
    for method in (identity.threshold_components, identity.density_components, identity.dbscan):
        got = {r["id"]: r["component"] for r in method(f).collect()}
        assert len({got[i] for i in range(10)}) == 1 and got[0] != got[12], method
    spread = {r["id"]: r["component"] for r in identity.label_propagation(f).collect()}
    assert not {spread[i] for i in range(10)} & {spread[i] for i in range(10, 16)}
    q = identity.qualified(identity.threshold_components(f), f, min_assets=7).collect()
    assert [(r["assets"], r["n"]) for r in q] == [(10, 10)]
    label = identity.complete_linkage(np.array([at(0), at(5), at(80), at(85)]))
    assert label[0] == label[1] != label[2] == label[3]
    a, b = np.array([at(0)] * 8 + [at(12)] * 2), np.array([at(42)] * 8 + [at(30)] * 2)
    assert identity.merge_evidence(a, b, set(range(10)), set(range(10, 20)), 0.7) is not None
    assert identity.merge_evidence(a, b, {1}, {1}, 0.7) is None
    assert one(spark, identity.vector.cluster_threshold(F.lit(15))) == 0.85


def test_links_beyond_the_nearest_64(spark):
    at = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    bursts = [at(i * 0.01) for i in range(70)] + [at(30 + i * 0.01) for i in range(70)] + [at(120 + i * 0.01) for i in range(3)]
    f = spark.createDataFrame(list(enumerate(bursts)), "id long, vector array<double>").withColumn("asset_id", F.col("id") % 141)
    for method in (identity.threshold_components, identity.dbscan):
        got = {r["id"]: r["component"] for r in method(f).collect()}
        assert got == {i: 0 if i < 140 else 140 for i in range(143)}, method
    pairs = {(r["src"], r["dst"]) for r in identity.links(f, 0.82, asset="asset_id").collect()}
    assert len(pairs) < 10 * 143 and not {(0, 141), (141, 0)} & pairs
    few = spark.createDataFrame([(1, at(0)), (2, at(30)), (3, at(60)), (4, at(180))], "id long, vector array<double>")
    assert {r["id"]: r["component"] for r in identity.dbscan(few).collect()} == {1: 2, 2: 2, 3: 2}  # one core, two borders


def test_search_finds_text_first(spark):
    a = spark.createDataFrame(
        [(1, "scan.jpg", "Airport gate", "boarding pass gate 12", ["Avery"], "London Bridge, London", None, None), (2, "desk.jpg", "Office desk", None, None, None, 5, 0.95)],
        "id long, orig_filename string, title string, extracted_text string, people array<string>, location_text string, user_rating int, review_score double",
    ).withColumns({c: F.lit(None).cast("string") for c in ("dt_original", "source", "source_kind", "media_type", "description", "review_state")}).withColumns({c: F.lit(None).cast("double") for c in ("gps_lat", "gps_lon")})
    assert search.search(a, "boarding pass gate").first()["id"] == 1
    assert search.search(a).first()["id"] == 2
    assert "people match" in search.search(a, "avery").first()["reasons"]
    assert "location match" in search.search(a, "london").first()["reasons"]
    words = F.split(F.lit("a b a c"), " ")
    dense = vector.cosine(F.array(*map(F.lit, vector.query_embedding("aa bb"))), vector.text_embedding(F.transform(words, lambda w: F.concat(w, w))))
    sparse = vector.sparse_similarity(F.array(*map(F.lit, vector.query_embedding("aa bb"))), F.transform(words, lambda w: F.concat(w, w)))
    assert abs(one(spark, dense) - one(spark, sparse)) < 1e-9


def test_whole_documents_are_embedded_and_searched(spark, tmp_path):
    import hashlib

    from pyspark.sql import Row

    from pixelmill.plans import catalog_queries

    rng = np.random.default_rng(9)
    texts = {1: " ".join(f"word{i}" for i in rng.integers(0, 900, 20_000)), 2: " ".join(f"word{i}" for i in rng.integers(0, 900, 300)) + " lement", 3: "short lement", 4: None, 5: "lement lement", 6: ""}
    spark.createDataFrame([(i, x, "en", "a") for i, x in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def brute(x):
        out = np.zeros(96)
        for w in x.split():
            h = hashlib.sha1(w.encode()).digest()
            out[int.from_bytes(h[:4], "big") % 96] += -1.0 if h[4] & 1 else 1.0
        return out / (np.linalg.norm(out) or 1.0)

    got = catalog_queries.queries()["document_embedding"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["dim"]): r["value"] for r in got} == {(i, k): round(v, 6) for i, x in texts.items() if x for k, v in enumerate(brute(x).tolist()) if v}
    hits = {r["id"]: r["score"] for r in catalog_queries.queries()["document_search"](spark, str(tmp_path)).collect()}
    assert set(hits) >= {2, 3} and 5 not in hits and hits[3] > hits[2]
    asked = vector.query_embedding("thtion lement estion")
    for i in (1, 2):
        words = spark.createDataFrame([Row(w=texts[i].split())]).select(vector.folded_similarity(F.array(*map(F.lit, asked)), F.col("w")).alias("s")).first()["s"]
        assert abs(words - float(np.dot(asked, brute(texts[i])))) < 1e-9
    assert one(spark, vector.folded_similarity(F.array(*map(F.lit, asked)), F.array().cast("array<string>"))) == 0.0


def test_journal(spark):
    j = spark.createDataFrame([(1, "t", "a", "b", None, None), (2, "t", "b", "c", None, None)], "seq long, target_id string, before_json string, after_json string, undone_at string, redone_at string")
    u = journal.undo(j, "now")
    assert journal.state(u).first()["snapshot"] == "b"
    assert journal.state(journal.undo(u, "now")).first()["snapshot"] == "a"
    assert journal.state(journal.redo(u, "now")).first()["snapshot"] == "c"
    assert journal.state(journal.restore_to(j, 0, "now")).first()["snapshot"] == "a"
    more = journal.record(u, spark.createDataFrame([("t", "b", "d")], "target_id string, before_json string, after_json string"))
    assert journal.state(more).first()["snapshot"] == "d" and more.count() == 2


def test_sweep_and_jobs_and_exports(spark):
    rows = spark.createDataFrame([(0.7, 1, 1.0), (0.9, 1, 1.0), (0.65, 0, 0.4), (0.95, 0, 0.25)], "score double, label int, weight double")
    b = tuning.best(tuning.sweep(rows)).first()
    assert b["threshold"] == 0.655 and b["cost"] == 1.25 and b["clarification_floor"] == 0.68
    e = spark.createDataFrame([("j", 1, "t", "RUNNING", None, "1", {"a": "1"}), ("j", 2, "t", "COMPLETED", None, "2", {"a": "2", "b": "3"})], "id string, seq int, job_type string, status string, error_msg string, at string, metrics map<string,string>")
    r = jobs.current(e).first()
    assert r["status"] == "COMPLETED" and r["metrics"] == {"a": "2", "b": "3"} and r["started_at"] == "1"
    assert one(spark, sinks.export_status(F.lit(True), F.lit(True), F.lit(True))) == "skipped"
    args = sinks.tag_arguments(F.lit("2024-01-02T03:04:05"), F.lit(51.5), F.lit(-0.12), F.lit(None).cast("double"), F.lit("T"), F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a")))
    assert one(spark, args) == ["-DateTimeOriginal=2024:01:02 03:04:05", "-CreateDate=2024:01:02 03:04:05", "-GPSCoordinates=+51.5000-000.1200/", "-Title=T", "-Subject=a", "-Subject=b"]


def test_duplicates_and_sequences(spark):
    a = spark.createDataFrame([("a", "h", 10, "2024-01-01T00:00:00", "z"), ("b", "h", 20, "2024-01-01T00:02:00", "z"), ("c", "x", 5, "2024-01-01T00:05:01", "z"), ("d", None, 5, "bad", "z")], "id string, sha256 string, orig_size long, dt_original string, source_locator string").withColumn("source_root", F.lit(None).cast("string"))
    assert [(r["members"], r["canonical_asset_id"]) for r in dedupe.exact_groups(a).collect()] == [(2, "b")]
    assert [(r["members"], r["canonical_asset_id"]) for r in dedupe.sequence_groups(a).collect()] == [(2, "b")]
    h = a.withColumns({c: F.lit(7).cast("long") for c in ("phash", "dhash", "whash", "colorhash", "crop_hash")}).withColumns({"media_type": F.lit("image"), "source": F.lit("s"), "source_kind": F.lit("file"), "n": F.ascii("id").cast("long")})
    assert {r["n"] for r in dedupe.near_groups(h).collect()} == {97, 98, 99}


def test_one_word_edit_links(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in rng.integers(0, 5000, 60)]
    other = [f"word{i}" for i in rng.integers(0, 5000, 60)]
    edited = words[:30] + ["changed"] + words[31:]
    rows = [(1, " ".join(words), "en", "a"), (2, " ".join(edited), "en", "a"), (3, " ".join(other), "en", "a"), (4, " ".join(words), "en", "b"), (5, None, "en", "a"), (6, "", "en", "a")]
    rows += [(7, "Слово за словом идёт", "ru", None), (8, "слово за словом идёт!", "ru", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    from pixelmill.plans import catalog_queries

    pairs = {(r["src"], r["dst"]) for r in catalog_queries.queries()["near_dedupe_pairs"](spark, str(tmp_path)).collect()}
    assert pairs == {(1, 2), (7, 8)}
    groups = {r["id"]: r["component"] for r in catalog_queries.queries()["near_dedupe_components"](spark, str(tmp_path)).collect()}
    assert groups == {1: 1, 2: 1, 7: 7, 8: 7}


def test_standard_and_confidence(spark):
    assert schema.standard(spark).count() == 24
    assert schema.standard(spark, "video").agg(F.sum("weight")).first()[0] == 137
    assert schema.standard(spark, "image").agg(F.sum("weight")).first()[0] == 114
    assert one(spark, schema.confidence(F.lit("sidecar_metadata"), F.lit("title"))) == 0.94
    assert one(spark, schema.confidence(F.lit("image_exif"), F.lit("title"), True)) == 0.72
    assert set(schema.empty(spark, "faces").columns) >= {"bbox", "identity_id"}
    assert catalog.sources(spark.createDataFrame([(" ",), ("a",)], "source string")).count() == 2


def at(degrees):
    return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]


def test_clusters_merge_by_evidence(spark):
    kinds = "id long, asset_id string, identity_id string, status string, vector array<double>"
    rows = lambda groups: [(n, f"a{n}", k, "CLUSTERED", at(x)) for n, (k, x) in enumerate((k, x) for k, angles in groups.items() for x in angles)]
    siblings = spark.createDataFrame(rows({"a": [0] * 8 + [12] * 2, "b": [42] * 8 + [30] * 2}), kinds)
    assert [tuple(r) for r in identity.merge_clusters(siblings, 0.7).collect()] == [("b", "a")]
    apart = spark.createDataFrame(rows({"a": [0] * 10, "b": [35] * 10, "c": [70] * 10}), kinds)
    merged = identity.merge_clusters(apart, 0.7)
    assert merged.count() == 1
    after = identity.remap(apart, merged)
    assert sorted(r["count"] for r in after.groupBy("identity_id").count().collect()) == [10, 20]
    together = spark.createDataFrame([(n, "same", k, "CLUSTERED", at(x)) for n, (k, x) in enumerate([("a", 0)] * 4 + [("b", 1)] * 4)], kinds)
    assert identity.merge_clusters(together, 0.7).count() == 0  # faces of one asset are different people


def test_clusterer(spark):
    kinds = "id long, asset_id string, identity_id string, status string, vector array<double>"
    people = spark.createDataFrame([("p", "Avery", "CONFIRMED")], "id string, label string, status string")
    rows = [(n, f"a{n}", None, "DETECTED", [0.1] * 168) for n in range(10)]
    faces, known = identity.cluster(spark.createDataFrame(rows, kinds), people.limit(0), 0.95)
    assert {(r["identity_id"], r["status"]) for r in faces.collect()} == {("cluster-0", "CLUSTERED")} and known.count() == 1
    few, _ = identity.cluster(spark.createDataFrame(rows[:9], kinds), people.limit(0), 0.95)
    assert few.where("identity_id is not null").count() == 0
    rows = [(n, f"a{n}", "p" if n < 6 else None, "LABELED" if n < 6 else "DETECTED", at(n % 5)) for n in range(8)] + [(n, f"a{n}", None, "DETECTED", at(120 + n % 4)) for n in range(20, 32)] + [(99, "z", None, "REJECTED", at(0))]
    faces, known = identity.cluster(spark.createDataFrame(rows, kinds), people)
    got = {r["id"]: (r["identity_id"], r["status"]) for r in faces.collect()}
    assert {got[n] for n in range(8)} == {("p", "LABELED")} and got[99] == (None, "REJECTED")
    assert len({got[n] for n in range(20, 32)}) == 1 and got[20][0].startswith("cluster-") and known.count() == 2


def test_neighbors_with_missing_times(spark):
    rows = [(1, "2024-01-01"), (2, None), (3, "2024-01-03"), (4, "2024-01-01"), (5, None)]
    df = spark.createDataFrame(rows, "id long, dt_original string")
    order = [3, 4, 1, 5, 2]  # latest first, those without a time last, larger ids first
    for k, i in enumerate(order):
        r = catalog.neighbors(df, i, [("dt_original", False), ("id", False)]).first()
        assert (r["previous_id"], r["next_id"]) == (order[k - 1] if k else None, order[k + 1] if k < 4 else None), i


def test_cluster_statistics_are_exact_in_blocks_and_form_no_pairs(spark):
    r = np.random.default_rng(5)
    mixed, alike = r.normal(size=(90, 6)), np.ones((40, 6))
    rows = [(k, "mixed", v.tolist()) for k, v in enumerate(mixed)] + [(k, "copies", v.tolist()) for k, v in enumerate(alike)] + [(0, "alone", [1.0] * 6), (1, "missing", [1.0] * 6), (2, "missing", [2.0] * 6), (3, "missing", None)]
    faces = spark.createDataFrame(rows, "id long, component string, vector array<double>")
    for block, listed in ((8192, 1 << 17), (16, 100)):
        got = {x["component"]: x for x in tuning.cluster_stats(faces, block=block, listed=listed).collect()}
        unit = mixed / np.linalg.norm(mixed, axis=1, keepdims=True)
        sim = (unit @ unit.T)[np.triu_indices(90, 1)]
        assert np.allclose([got["mixed"]["mean_similarity"], got["mixed"]["p10_similarity"]], [sim.mean(), np.quantile(sim, 0.1)], atol=1e-12)
        assert np.allclose([got["copies"]["mean_similarity"], got["copies"]["p10_similarity"], got["missing"]["p10_similarity"]], 1, atol=1e-12)
        assert {k: x["n"] for k, x in got.items()} == {"mixed": 90, "copies": 40, "alone": 1, "missing": 3}
        assert got["alone"]["mean_similarity"] is None and got["alone"]["p10_similarity"] is None


def test_assets_with_one_managed_path_stay_one_row_each(spark):
    # ids are cut to eight digits in a managed path, so of many assets two may have the same one
    planned = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "k long, managed_path string")
    listing = planned.where("k < 4").select(F.col("managed_path").alias("path"))
    got = sorted((r["k"], r["status"]) for r in sinks.build_status(planned, listing).collect())
    assert got == [(1, "BUILT"), (2, "BUILT"), (3, "BUILT"), (4, "MISSING")]
    assets = spark.createDataFrame([("1", "NEW"), ("2", "NEW")], "id string, status string")
    managed = spark.createDataFrame([("1", "a", "PLANNED"), ("2", "a", "PLANNED")], "asset_id string, managed_path string, status string")
    built = pipeline.build_library(managed.select(F.col("managed_path").alias("path")))({"assets": assets, "managed_assets": managed})
    assert sorted(r["id"] + r["status"] for r in built["assets"].collect()) == ["1COPIED", "2COPIED"] and built["managed_assets"].count() == 2


def test_suggestions_of_repeated_faces_are_cut_the_same_in_any_order(spark):
    asked = spark.createDataFrame([(1, 7, 0.5, "OPEN", "t"), (2, 7, 0.9, "OPEN", "t")], "face_id long, suggested_identity_id long, score double, status string, created_at string")
    faces = [(1, 10, None, "A"), (1, 10, 3, "A"), (1, 10, 5, "A"), (1, 10, 4, "B"), (2, 10, 6, "A")]
    people = spark.createDataFrame([(7, "Ann")], "id long, label string")
    assets = spark.createDataFrame([(10, "a.jpg", "image")], "id long, orig_filename string, media_type string")
    for order in (faces, faces[::-1], faces[2:] + faces[:2]):
        f = spark.createDataFrame(order, "id long, asset_id long, identity_id long, status string").coalesce(1)
        got = [r["identity_id"] for r in views.suggestions(asked, f, people, assets, limit=3).collect()]
        assert got == [6, 5, 4], got
