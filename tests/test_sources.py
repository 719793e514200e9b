"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from hedgerow.operators import filters, registry
from hedgerow.sources import readers, sinks


def test_document_dir(spark, tmp_path):
    for name in ("a.pdf", "b.txt", "c.PDF"):
        (tmp_path / name).write_bytes(name.encode())
    got = readers.read_document_dir(spark, str(tmp_path))
    assert [r.file_name for r in got.collect()] == ["a.pdf"] and len(got.head().file_hash) == 64
    both = readers.read_document_dir(spark, str(tmp_path), ["*.pdf", "*.txt", "a.*"])
    assert sorted(r.file_name for r in both.collect()) == ["a.pdf", "b.txt"]
    marked = filters.supported_files(both)
    assert {r.file_name: r.file_status for r in marked.collect()} == {"a.pdf": "supported", "b.txt": "unsupported_file_type"}


def test_policy_seed(spark, tmp_path):
    seed = {"policies": [{"source": "P", "title": "T", "category": "local_plan", "revisions": [
        {"version_label": "v1", "effective_from": "2020-07-27", "effective_to": None, "file": "p.pdf"},
        {"version_label": "v2", "effective_from": "2023-01-01", "file": "missing.pdf"}]}, {"source": "Q", "title": "U", "category": "supplementary", "revisions": []}]}
    (tmp_path / "seed.json").write_text(json.dumps(seed))
    p, r = readers.read_policy_seed(spark, str(tmp_path / "seed.json"))
    assert p.count() == 2 and r.count() == 2
    known = spark.createDataFrame([("Q",)], "source string")
    held = spark.createDataFrame([], "source string, revision_id string")
    files = spark.createDataFrame([("p.pdf",)], "file string")
    new_p, new_r = registry.seed_policies(known, held, p, r, files)
    assert {(x.source, x.status) for x in new_p.collect()} == {("P", "created"), ("Q", "skipped")}
    assert {(x.revision_id, x.status) for x in new_r.collect()} == {("rev_P_2020_07", "created"), ("rev_P_2023_01", "file_missing")}


def test_site_and_map_extracts(spark, tmp_path):
    ring = [[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]]
    sites = tmp_path / "sites"
    sites.mkdir()
    (sites / "a.json").write_text(json.dumps({"features": [{"attributes": {"location": "x"}, "geometry": {"rings": [ring]}}]}))
    (sites / "b.json").write_text(json.dumps({"features": []}))
    (sites / "c.json").write_text(json.dumps({"features": [{"attributes": {}, "geometry": {"rings": []}}]}))
    rows = readers.read_site_features(spark, str(sites)).collect()
    assert len(rows) == 1 and rows[0].rings == [ring]
    maps = tmp_path / "maps"
    maps.mkdir()
    (maps / "route1.json").write_text(json.dumps({"elements": [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}, {"type": "way", "id": 2, "tags": {"highway": "path"}, "geometry": [{"lat": 1.0, "lon": 2.0}]}]}))
    ways, nodes = readers.read_map_elements(spark, str(maps))
    assert [(w.route_id, w.ord, w.way_id, w.tags) for w in ways.collect()] == [("route1", 1, 2, {"highway": "path"})]
    assert [(n.ord, n.node_id, n.tags) for n in nodes.collect()] == [(0, 1, {})]


def test_manifest_round_trip(spark, tmp_path):
    path = str(tmp_path / "manifests")
    assert readers.read_manifest(spark, path).count() == 0
    entries = spark.createDataFrame([("r1", "25/1/F", "d1", "k", "sha256:x"), ("r2", "25/2/F", "d2", "k", "h")],
                                    "review_id string, application_ref string, document_id string, s3_key string, file_hash string")
    for c in ("description", "document_type", "date_published", "source_url"):
        entries = entries.withColumn(c, F.lit(None).cast("string"))
    sinks.write_manifest(entries, path)
    (tmp_path / "manifests" / "folder=bad").mkdir()
    (tmp_path / "manifests" / "folder=bad" / "x.json").write_text('{"documents": [')
    got = {(r.application_ref, r.document_id, r.file_hash) for r in readers.read_manifest(spark, path).collect()}
    assert got == {("25/1/F", "d1", "sha256:x"), ("25/2/F", "d2", "h")}


def test_review_outputs(spark, tmp_path):
    df = spark.createDataFrame([("r1", "25/1/F", "amber", "# md", [1, 2]), ("r2", "25/1/F", "red", None, None)],
                               "review_id string, application_ref string, rating string, full_markdown string, route_assessments array<int>")
    sinks.write_review_outputs(df, str(tmp_path / "out"))
    assert "route_assessments" not in spark.read.json(str(tmp_path / "out/review")).columns
    assert spark.read.json(str(tmp_path / "out/routes")).count() == 2 and spark.read.json(str(tmp_path / "out/markdown")).count() == 1


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_chunks(spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int"), path)
    sinks.upsert_chunks(spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int"), path)
    assert {tuple(r) for r in sinks.read_current(spark, path).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    counts = sinks.delete_chunks(spark, spark.createDataFrame([("a",), ("zz",)], "chunk_id string"), path, "chunk_id")
    assert [tuple(r) for r in counts.collect()] == [("a", 1)]
    assert {r.chunk_id for r in sinks.read_current(spark, path).collect()} == {"b", "c"}


def test_pages_once_per_address(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([(2, "u", "b"), (1, "u", "a"), (3, "v", "c")], "page_id int, url string, html string").write.parquet(path)
    assert {(r.page_id, r.url, r.html) for r in readers.read_pages(spark, path).collect()} == {(1, "u", "a"), (3, "v", "c")}
