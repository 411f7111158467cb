"""Newest manifests, snapshots, freezes, quarantine moves and listings."""

from pyspark.sql import functions as F

from corpusloom.operators import diagnostics, retrieval
from corpusloom.sources import files, sinks


def test_newest_manifests(spark):
    rows = [("a.json", 1, '{"indexed_points": 3}'), ("b.json", 2, '{"indexed_points": 4}'), ("c.json", 3, "not json"), ("d.json", 3, "[1]")]
    found = spark.createDataFrame(rows, "path string, modified int, json string")
    assert diagnostics.newest_readable(found).first().path == "b.json"
    assert tuple(diagnostics.newest(found).first()) == ("d.json", 3, None)
    assert diagnostics.newest_readable(found.filter("modified = 3")).count() == 0


def test_snapshot_and_freeze(spark):
    points = spark.createDataFrame([("x",), ("x",), (None,)], "category string")
    manifests = spark.createDataFrame([("a.json", 1, '{"indexed_points": 3}'), ("b.json", 2, "broken")], "path string, modified int, json string")
    documents = spark.createDataFrame([("a.md",), ("b.md",)], "source_path string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    snapshot = diagnostics.runtime_snapshot(points, manifests, documents, now, "b.md")
    row = snapshot.first()
    assert row.active_index_matches_latest_manifest and row.latest_manifest == "a.json" and row.documents == 2 and row.selected_document_exists
    assert row.points_by_category == {"uncategorized": 1, "x": 2}
    gates = spark.createDataFrame([("one", True), ("two", True)], "check string, ok boolean")
    reports = spark.createDataFrame([("s", 3, 3)], "suite string, passed long, total long")
    frozen = diagnostics.release_freeze(snapshot, gates, reports, now).first()
    assert frozen.ready and frozen.failed_checks == [] and frozen.suites[0].suite == "s" and frozen.points_by_category["x"] == 2
    bad = diagnostics.release_freeze(snapshot, gates.withColumn("ok", F.col("check") == "one"), reports, now).first()
    assert not bad.ready and bad.failed_checks == ["two"]
    assert not diagnostics.release_freeze(snapshot, gates, reports.withColumn("passed", F.lit(2).cast("long")), now).first().ready


def test_quarantined_files_are_moved(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    for name in ("a/bad.md", "a/good.md", "odd.md"):
        (tmp_path / "in" / name).write_text(name)
    scanned = spark.createDataFrame([("a/bad.md", "rejected"), ("a/good.md", "accepted"), ("odd.md", "quarantined"), ("gone.md", "rejected")], "path string, status string")
    got = sorted(map(tuple, sinks.move_quarantined(scanned, str(tmp_path / "in"), str(tmp_path / "q"), "r1").collect()))
    assert got == [("a/bad.md", "rejected", True), ("gone.md", "rejected", False), ("odd.md", "quarantined", True)]
    assert (tmp_path / "q/r1/rejected/a/bad.md").read_text() == "a/bad.md" and (tmp_path / "q/r1/quarantined/odd.md").exists()
    assert (tmp_path / "in/a/good.md").exists() and not (tmp_path / "in/odd.md").exists()


def test_counts_and_listings(spark):
    points = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "point_id int, category string")
    assert retrieval.count_points(points, {"category": "a"}).first()[0] == 2 and retrieval.count_points(points).first()[0] == 3
    found = spark.createDataFrame([("b/x.md",), ("a/y.TXT",), ("c.png",), (".md",)], "path string")
    assert [r.path for r in files.list_documents(found).collect()] == ["a/y.TXT", "b/x.md"]
    points.createOrReplaceTempView("points_of_a_test")
    assert ("points_of_a_test", True) in {(r.name, r.is_temporary) for r in diagnostics.tables_of(spark).collect()}
