"""Manifests of rebuilds, reports of suites, and whether they agree with what is live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fields of a manifest, where they stand, and their types.
MANIFEST = {
    "rebuild_id": ("rebuild_id", "string"), "mode": ("mode", "string"), "started_at_utc": ("started_at_utc", "string"), "completed_at_utc": ("completed_at_utc", "string"),
    "indexed_points": ("qdrant.indexed_points", "long"), "accepted_files": ("document_safety.accepted_files", "long"), "quarantined_files": ("document_safety.quarantined_files", "long"),
    "rejected_files": ("document_safety.rejected_files", "long"), "warned_files": ("document_safety.warned_files", "long"), "secret_hits": ("document_safety.secret_hits", "long"),
    "snapshot_enabled": ("snapshot.enabled", "boolean"), "snapshot_created": ("snapshot.created", "boolean"), "snapshot_name": ("snapshot.snapshot_name", "string"),
}


def read_json_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified and the whole text of each JSON file of a folder, a row each; no folder, no rows."""
    from corpusloom.sources.sinks import _fs

    fs, p = _fs(spark, folder)
    schema = "path string, modified timestamp, json string"
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("json"))


def summaries(manifests: DataFrame) -> DataFrame:
    """``manifests``: path, json. The fields of each; ``error`` where the text is no JSON object."""
    whole = F.json_object_keys("json").isNotNull()
    fields = [F.when(whole, F.get_json_object("json", f"$.{place}").try_cast(kind)).alias(name) for name, (place, kind) in MANIFEST.items()]
    return manifests.select(F.col("path").alias("manifest_path"), *fields, F.when(~whole, "not a JSON object").alias("error"))


def inventory(found: DataFrame, limit: int = 10) -> DataFrame:
    """The newest manifests by their names (a report, so limited)."""
    return found.orderBy(F.desc("manifest_path")).limit(limit)


def newest_readable(manifests: DataFrame) -> DataFrame:
    """``manifests``: path, modified, json. The newest whose text is a JSON object, by time and then by path; the others are passed over."""
    whole = manifests.filter(F.json_object_keys("json").isNotNull())
    return whole.orderBy(F.desc("modified"), F.desc("path")).limit(1)


def newest(manifests: DataFrame) -> DataFrame:
    """The newest of all, with its text if that is a JSON object, else null."""
    first = manifests.orderBy(F.desc("modified"), F.desc("path")).limit(1)
    return first.withColumn("json", F.when(F.json_object_keys("json").isNotNull(), F.col("json")))


def tables_of(spark: SparkSession, database: str = "default") -> DataFrame:
    """(name, kind, is_temporary) of the catalogue's tables, by name."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, kind string, is_temporary boolean").orderBy("name")


def runtime_snapshot(points: DataFrame, manifests: DataFrame, documents: DataFrame, now: Column, selected: str | None = None) -> DataFrame:
    """One row: when it was taken, points by category, documents, the newest readable manifest, and :func:`consistency`. ``points``: category; ``documents``:
    source_path; ``manifests``: path, modified, json."""
    by = points.groupBy("category").agg(F.count("*").alias("n"))
    listed = by.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("point_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("category", F.lit("uncategorized")).alias("k"), "n")))).alias("points_by_category"))  # a row per category
    latest = newest_readable(manifests).select("path", F.get_json_object("json", "$.indexed_points").try_cast("long").alias("indexed_points"))
    held = consistency(listed.select("point_count"), latest, documents, selected)
    files = documents.agg(F.count_distinct("source_path").alias("documents"))
    named = latest.agg(F.max("path").alias("latest_manifest"))
    return held.crossJoin(F.broadcast(listed.select("points_by_category"))).crossJoin(F.broadcast(files)).crossJoin(F.broadcast(named)).withColumn("taken_at", now)  # one row each


def release_freeze(snapshot: DataFrame, gates: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """One row: whether every gate holds, the gates that don't, the newest report of each suite, and the snapshot. ``snapshot``: one row; ``gates``: check, ok;
    ``reports``: suite, passed, total (one row each)."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("check"))))
    held = gates.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ready"), failed.alias("failed_checks"), F.count("*").alias("checks"))
    suites = reports.agg(F.array_sort(F.collect_list(F.struct("suite", "passed", "total"))).alias("suites"), F.coalesce(F.bool_and(F.col("passed") == F.col("total")), F.lit(False)).alias("suites_passed"))
    one = held.crossJoin(F.broadcast(suites)).crossJoin(F.broadcast(snapshot))  # one row each
    return one.withColumns({"frozen_at": now, "ready": F.col("ready") & F.col("suites_passed") & F.col("active_index_matches_latest_manifest")})


def latest_per(reports: DataFrame, key: str, *order: Column) -> DataFrame:
    """The newest whole report of each suite."""
    return reports.withColumn("v", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("v = 1").drop("v")


def consistency(live: DataFrame, manifest: DataFrame, documents: DataFrame, selected: str | None) -> DataFrame:
    """One row: points that are live (``live``: point_count) and in the latest manifest (indexed_points; no row: null), whether they agree,
    and whether the selected document exists (null without one). Counts meet as rows of one aggregate."""
    counts = live.select(F.col("point_count").cast("long").alias("active"), F.lit(None).cast("long").alias("listed"), F.lit(0).cast("long").alias("there"))
    counts = counts.unionByName(manifest.select(F.lit(None).cast("long").alias("active"), F.col("indexed_points").cast("long").alias("listed"), F.lit(0).cast("long").alias("there")))
    counts = counts.unionByName(documents.filter(F.col("source_path") == selected).limit(1).select(F.lit(None).cast("long").alias("active"), F.lit(None).cast("long").alias("listed"), F.lit(1).cast("long").alias("there")))
    one = counts.agg(F.max("active").alias("active_point_count"), F.max("listed").alias("latest_manifest_indexed_points"), F.max("there").alias("there"))
    same = F.coalesce(F.col("active_point_count") == F.col("latest_manifest_indexed_points"), F.lit(False))
    return one.select(same.alias("active_index_matches_latest_manifest"), "active_point_count", "latest_manifest_indexed_points", (F.col("there") > 0 if selected else F.lit(None).cast("boolean")).alias("selected_document_exists"))


def parse_settings(lines: DataFrame) -> DataFrame:
    """``lines``: place, value. KEY=VALUE lines as (key, value): comments go, quotes around a value too; of a repeated key the last holds."""
    line = F.trim("value")
    rows = lines.select("place", line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#") & F.contains("line", F.lit("=")))
    value = F.trim(F.expr("substring(line, instr(line, '=') + 1)"))
    value = F.regexp_replace(F.regexp_replace(value, '^"+|"+$', ""), "^'+|'+$", "")
    rows = rows.select("place", F.trim(F.substring_index("line", "=", 1)).alias("key"), value.alias("value"))
    return latest_per(rows, "key", F.desc("place")).select("key", "value")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a settings file; a missing file has none."""
    from corpusloom.sources.sinks import _fs

    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], "key string, value string")
    stream = fs.open(p)  # not by Spark's readers, which leave out names that begin with a dot
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return parse_settings(spark.createDataFrame(list(enumerate(text.splitlines())), "place long, value string"))
