"""Sinks: a versioned vector index in Parquet, quarantine, JSON and Markdown reports."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusloom.sources.scratch import written


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _rename(spark: SparkSession, source: str, target: str, overwrite: bool) -> bool:
    """Moves a file in one step; False if the target is there already and stays."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, at = _fs(spark, target)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, int(overwrite))
    if overwrite:
        how[0] = kind.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(_fs(spark, source)[1], at, how)
    except Py4JJavaError as e:
        if not overwrite and fs.exists(at):
            return False
        raise e
    return True


def put_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """A small file in any store that Spark reaches: written beside and moved, so readers see the old one or the new one, whole. Without ``overwrite``
    a file that is there stays, and False says so."""
    folder, _, name = path.rpartition("/")
    beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    fs, p = _fs(spark, beside)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    moved = _rename(spark, beside, path, overwrite)
    if not moved:
        fs.delete(p, False)
    return moved


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect()).strip() if fs.exists(p) else None


# --- the index: hash buckets of rows by key, and a log of which folder holds each bucket --------------------------------------
#
# <path>/log/000000000007.json names a version: the columns, and for each bucket the folder of its rows. A writer puts new folders beside
# the old ones and then the next number of the log, which only one writer can: the other looks at what has changed and does its buckets again.

BUCKETS = 16
#: Payload that searches filter by: strings get Bloom filters, numbers have Parquet's statistics.
KEYWORDS = ("category", "source_path", "source_extension", "loader_type", "document_id", "unit_type", "sheet_name", "source_sha256")
INTEGERS = ("page_number", "row_start", "row_end", "chunk_index_within_unit")
#: Different values of a column in a row group that Bloom filters are made for.
DISTINCT = 10_000


def _entries(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/log")
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName()[:1].isdigit()) if fs.exists(p) else []


def _entry(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(get_text(spark, f"{path}/log/{number:012d}.json"))


def _latest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    numbers = _entries(spark, path)
    return (numbers[-1], _entry(spark, path, numbers[-1])) if numbers else (-1, None)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, path: str, key: str, buckets: int) -> str:
    """Rows by bucket, in the order of the payload, so that a filter skips row groups; the name of their folder."""
    folder = uuid.uuid4().hex
    order = [c for c in (*KEYWORDS[:2], key) if c in rows.columns]
    writer = rows.withColumn("bucket", _bucket(key, buckets)).repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order).write.partitionBy("bucket")
    for c in (key, *KEYWORDS):
        if c in rows.columns and rows.schema[c].dataType.typeName() == "string":
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(DISTINCT))
    writer.parquet(f"{path}/data/{folder}")
    return folder


def _read_buckets(spark: SparkSession, path: str, entry: dict, buckets: list[int] | None = None) -> DataFrame:
    held = [(b, f) for b, f in entry["folders"].items() if buckets is None or int(b) in buckets]
    schema = StructType.fromJson(entry["schema"])
    return spark.read.schema(schema).parquet(*[f"{path}/data/{f}/bucket={b}" for b, f in held]) if held else spark.createDataFrame([], schema)


def _folders(spark: SparkSession, path: str, folder: str) -> dict[str, str]:
    fs, p = _fs(spark, f"{path}/data/{folder}")
    return {s.getPath().getName().removeprefix("bucket="): folder for s in fs.listStatus(p) if s.isDirectory()}


def _commit(spark: SparkSession, path: str, number: int, schema: StructType, key: str, buckets: int, folders: dict[str, str], version: str | None = None) -> str | None:
    version = version or f"v-{number:06d}-{uuid.uuid4().hex[:8]}"
    text = json.dumps({"version": version, "key": key, "buckets": buckets, "schema": schema.jsonValue(), "folders": folders}, sort_keys=True)
    return version if put_text(spark, f"{path}/log/{number:012d}.json", text, overwrite=False) else None


#: Bytes of keys up to which they are broadcast.
KEY_BYTES = 64_000_000


def _keys(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The keys of ``rows`` (written) as a table of their own, broadcast if they are few: what they meet is not shuffled."""
    keys = written(rows.select(F.col(key).alias("_key")), name)
    held = keys.agg(F.sum(F.octet_length(F.col("_key").cast("string")).cast("long") + 16)).first()[0] or 0
    return F.broadcast(keys) if held <= KEY_BYTES else keys


def _one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (written): of those of one key the largest. Only keys are counted; rows of a key that is not repeated stay where they are."""
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if again.isEmpty():
        return rows
    again = _keys(again, key, "upsert-again")
    same, rest = F.col(key).eqNullSafe(F.col("_key")), [c for c in rows.columns if c != key]
    some = rows.join(again, same, "left_semi")
    one = some.groupBy(key).agg(F.max(F.struct(*rest)).alias("row")).select(key, "row.*") if rest else some.distinct()
    return written(rows.join(again, same, "left_anti").unionByName(one), "upsert-of-each")


def write_index(points: DataFrame, path: str, key: str = "point_id", buckets: int = BUCKETS) -> str:
    """A new version of all rows. Readers see it once its number is in the log, so a failed rebuild changes nothing; the version before
    is its snapshot."""
    spark = points.sparkSession
    folders = _folders(spark, path, _write_buckets(points, path, key, buckets))
    while True:
        number, _ = _latest(spark, path)
        if version := _commit(spark, path, number + 1, points.schema, key, buckets, folders):
            return version


def read_index(spark: SparkSession, path: str) -> DataFrame:
    _, entry = _latest(spark, path)
    if entry is None:
        raise ValueError(f"there is no index in {path}")
    return _read_buckets(spark, path, entry)


def get_points(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """Rows of a few ids: only their buckets are read, and of these the row groups whose Bloom filter may hold one."""
    _, entry = _latest(spark, path)
    key = entry["key"]
    kind = StructType.fromJson(entry["schema"])[key].dataType
    asked = spark.createDataFrame([(i,) for i in ids], StructType([StructField(key, kind)]))
    buckets = [r[0] for r in asked.select(_bucket(key, entry["buckets"])).distinct().collect()]
    return _read_buckets(spark, path, entry, buckets).filter(F.col(key).isin(ids))


def upsert_index(points: DataFrame, path: str, key: str = "point_id", buckets: int = BUCKETS) -> str:
    """Rows replace those of the same key; the rest stays, and buckets without any of the rows stay the same files. Of rows of ``points``
    with one key one is written, that of the largest content. Where another writer was faster, the buckets that it
    changed are merged again, on top of its rows."""
    spark = points.sparkSession
    new = _one_of_each(written(points, "upsert"), key)
    keys = _keys(new, key, "upsert-keys")
    while True:
        number, entry = _latest(spark, path)
        count = entry["buckets"] if entry else buckets
        touched = [r[0] for r in new.select(_bucket(key, count)).distinct().collect()]  # buckets, not rows
        merged, base = new, {}
        if entry:
            old = _read_buckets(spark, path, entry, touched)
            merged, base = old.join(keys, F.col(key) == F.col("_key"), "left_anti").unionByName(new, allowMissingColumns=True), entry["folders"]
        own = _folders(spark, path, _write_buckets(merged, path, key, count))
        while True:
            schema = _wider(StructType.fromJson(entry["schema"]) if entry else new.schema, merged.schema)
            if version := _commit(spark, path, number + 1, schema, key, count, (entry["folders"] if entry else {}) | own):
                return version
            number, entry = _latest(spark, path)
            if entry["buckets"] != count or any(entry["folders"].get(str(b)) != base.get(str(b)) for b in touched):
                break  # the other changed a bucket of ours


def _wider(a: StructType, b: StructType) -> StructType:
    return StructType([*a.fields, *[f for f in b.fields if f.name not in a.names]])


def restore_index(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Makes an older version the newest again; one row tells what was and what is."""
    for number in reversed(_entries(spark, path)):
        if (old := _entry(spark, path, number))["version"] == version:
            break
    else:
        raise ValueError(f"there is no version {version}")
    while True:
        number, now = _latest(spark, path)
        if _commit(spark, path, number + 1, StructType.fromJson(old["schema"]), old["key"], old["buckets"], old["folders"], version):
            return spark.createDataFrame([(now["version"], version)], "snapshot_before string, snapshot_name string")


def versions(spark: SparkSession, path: str) -> list[str]:
    """Versions of an index, oldest first; the old ones are its snapshots."""
    return list(dict.fromkeys(_entry(spark, path, n)["version"] for n in _entries(spark, path)))


# --- staging ----------------------------------------------------------------------------------

_FILES = "path string, content binary"


def stage(files: DataFrame, path: str) -> None:
    """``files``: path, content. Adds them to the staged ones."""
    files.select("path", "content").write.mode("append").parquet(path)


def staged(spark: SparkSession, path: str) -> DataFrame:
    fs, p = _fs(spark, path)
    return spark.read.schema(_FILES).parquet(path) if fs.exists(p) else spark.createDataFrame([], _FILES)


def clear_staged(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def promote(spark: SparkSession, staging: str, documents: str) -> None:
    """Moves what is staged now into the documents, an index by path: a stream over the staged files that ends when it has read those that were
    there, with its checkpoint beside the documents. A file is deleted once the version that holds it is in the log, so what
    is staged meanwhile stays for the next promotion, and a promotion that was stopped is taken up again. Of files of one path the largest content
    of a batch stays."""
    fs, p = _fs(spark, staging)
    if not fs.exists(p):
        return

    def moved(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():  # the batch is a list of files, which stay until they are deleted below
            return
        upsert_index(batch.select("path", "content"), documents, key="path")
        for row in batch.select("file").distinct().toLocalIterator():
            store, file = _fs(spark, row.file)
            store.delete(file, False)

    files = spark.readStream.schema(_FILES).option("ignoreMissingFiles", True).parquet(staging).select("*", F.col("_metadata.file_path").alias("file"))
    files.writeStream.foreachBatch(moved).option("checkpointLocation", f"{documents}/promotions").trigger(availableNow=True).start().awaitTermination()


def write_quarantine(scanned: DataFrame, path: str, rebuild_id: str) -> None:
    scanned.filter("status != 'accepted'").write.partitionBy("status").parquet(f"{path}/{rebuild_id}")


def move_quarantined(scanned: DataFrame, root: str, path: str, rebuild_id: str) -> DataFrame:
    """Moves each file below ``root`` that was not accepted to ``path/rebuild_id/status/`` and its own path. ``scanned``: path, status. (path, status, moved): a file
    that is no longer there is not moved. Renames of single files by the driver, which streams their names; no contents pass through it."""
    spark, rows = scanned.sparkSession, []
    for row in scanned.filter("status != 'accepted'").select("path", "status").toLocalIterator():
        fs, source = _fs(spark, f"{root}/{row.path}")
        there = fs.exists(source)
        if there:
            _, target = _fs(spark, f"{path}/{rebuild_id}/{row.status}/{row.path}")
            fs.mkdirs(target.getParent())
            there = fs.rename(source, target)
        rows.append((row.path, row.status, bool(there)))
    return spark.createDataFrame(rows, "path string, status string, moved boolean")


def write_manifest(row: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    put_text(row.sparkSession, path, row.select(F.to_json(F.struct("*"))).first()[0])


def json_report(results: DataFrame, path: str) -> None:
    """A case per line, all of them, in files of JSON."""
    results.write.mode("overwrite").json(path)


def markdown_report(results: DataFrame, limit: int = 1000) -> str:
    """A table of evaluation results (a report for people, so limited: a last line tells how many cases it leaves out)."""
    total = results.count()
    rows = results.select("case_id", (F.size("failures") == 0).alias("passed"), F.array_join("failures", "; ").alias("failures")).orderBy("case_id").limit(limit).collect()
    more = [f"| … {total - len(rows)} more | | |"] if total > len(rows) else []
    return "\n".join(["| case | passed | failures |", "| --- | --- | --- |", *(f"| {r[0]} | {'yes' if r[1] else 'no'} | {r[2]} |" for r in rows), *more])


def release_manifest(spark: SparkSession, path: str, parts: dict[str, DataFrame]) -> None:
    """One JSON object of named one-row tables, as one file."""
    rows = {name: row.select(F.to_json(F.struct("*"))).first() for name, row in parts.items()}
    put_text(spark, path, "{" + ", ".join(f'"{name}": {row[0] if row else "null"}' for name, row in rows.items()) + "}")
