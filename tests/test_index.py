"""The bucketed index: filters that skip, upserts that touch their buckets alone, writers side by side, staging."""

import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import sinks


def data_files(root):
    return {str(p) for p in root.glob("data/**/*.parquet")}


def scanned_rows(df):
    """Rows that the scans of a query gave, after row groups were left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, stack = 0, [plan]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
        if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
            total += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_filters_skip_row_groups(spark, tmp_path):
    points = spark.range(40_000).select(F.col("id").alias("point_id"), F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(8))).alias("category"), F.concat(F.lit("p"), F.xxhash64("id")).alias("source_path"), F.concat(F.lit("d"), F.xxhash64("id", F.lit(2))).alias("document_id"), F.array(F.lit(1.0)).alias("embedding"))
    spark.conf.set("spark.hadoop.parquet.block.size", str(64 * 1024))
    old = spark.sparkContext._jsc.hadoopConfiguration().get("parquet.block.size")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(64 * 1024))
    try:
        sinks.write_index(points, str(tmp_path / "i"), buckets=2)
    finally:
        spark.conf.unset("spark.hadoop.parquet.block.size")
        spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", old or str(128 * 1024 * 1024))
    index = sinks.read_index(spark, str(tmp_path / "i"))
    assert index.count() == 40_000
    some = index.filter("category = 'c3'").select("point_id")
    assert 0 < some.count() <= scanned_rows(some) < 20_000  # statistics
    name = points.select("document_id").first()[0]
    one = index.filter(F.col("document_id") == name).select("point_id")
    assert one.count() == 1 and scanned_rows(one) < 20_000  # Bloom filters: ids are in no order
    assert scanned_rows(index.filter("document_id = 'd5x'").select("point_id")) < 20_000


def test_upserts_touch_their_buckets(spark, tmp_path):
    path = str(tmp_path / "i")
    sinks.write_index(spark.range(300).select(F.col("id").alias("point_id"), F.lit("old").alias("text")), path, buckets=8)
    before = data_files(tmp_path / "i")
    folders = sinks._latest(spark, path)[1]["folders"]
    sinks.upsert_index(spark.createDataFrame([(5, "new", "x")], "point_id long, text string, category string"), path)
    after = sinks._latest(spark, path)[1]["folders"]
    assert sum(folders[b] != after[b] for b in folders) == 1 and before < data_files(tmp_path / "i")
    rows = {r.point_id: (r.text, r.category) for r in sinks.read_index(spark, path).collect()}
    assert len(rows) == 300 and rows[5] == ("new", "x") and rows[6] == ("old", None)
    got = sinks.get_points(spark, path, [5, 7, 999])
    assert sorted(r.point_id for r in got.collect()) == [5, 7]
    assert {f.split("bucket=")[1].split("/")[0] for f in got.inputFiles()} < set(folders)


def test_writers_side_by_side_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    rows = lambda k: spark.createDataFrame([(i, f"w{k}") for i in range(k * 100, k * 100 + 20)] + [(9000 + k, f"w{k}")], "point_id long, text string")
    sinks.write_index(rows(0), path, buckets=4)
    held, real = [True], sinks._write_buckets

    def late(merged, *rest):  # another writer is through before this one writes its buckets
        if held:
            held.clear()
            sinks.upsert_index(rows(2), path)
        return real(merged, *rest)

    monkeypatch.setattr(sinks, "_write_buckets", late)
    sinks.upsert_index(rows(1), path)
    monkeypatch.setattr(sinks, "_write_buckets", real)
    assert sinks.read_index(spark, path).groupBy("text").count().sort("text").collect() == [("w0", 21), ("w1", 21), ("w2", 21)]
    threads = [threading.Thread(target=sinks.upsert_index, args=(rows(k), path)) for k in (3, 4, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sinks.read_index(spark, path).groupBy("text").count().sort("text").collect() == [(f"w{k}", 21) for k in range(6)]
    assert len(sinks.versions(spark, path)) == 6
    with pytest.raises(ValueError, match="no version"):
        sinks.restore_index(spark, path, "v-none")


def test_staging_keeps_what_comes_meanwhile(spark, tmp_path, monkeypatch):
    stage, docs = str(tmp_path / "stage"), str(tmp_path / "docs")
    sinks.promote(spark, stage, docs)  # nothing is staged
    sinks.stage(spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"1"))], "path string, content binary"), stage)
    held, real = [True], sinks.upsert_index

    def late(*args, **more):
        if held:
            held.clear()
            sinks.stage(spark.createDataFrame([("b", bytearray(b"2")), ("c", bytearray(b"2"))], "path string, content binary"), stage)
        return real(*args, **more)

    monkeypatch.setattr(sinks, "upsert_index", late)
    sinks.promote(spark, stage, docs)
    assert sorted(r.path for r in sinks.staged(spark, stage).collect()) == ["b", "c"]
    assert sorted((r.path, bytes(r.content)) for r in sinks.read_index(spark, docs).collect()) == [("a", b"1"), ("b", b"1")]
    sinks.promote(spark, stage, docs)
    assert sinks.staged(spark, stage).count() == 0
    assert sorted((r.path, bytes(r.content)) for r in sinks.read_index(spark, docs).collect()) == [("a", b"1"), ("b", b"2"), ("c", b"2")]
