"""Shared storage for intermediate tables, and small helpers that every operator here uses."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. One of our own only where none is set and the
    session is local, so that one machine is all there is."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, and a
    lost executor costs only the tasks that it was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it holds more than one in HOT rows; so there are fewer than HOT of them.
HOT = 1000
#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 64_000_000


def table_bytes(df: DataFrame) -> int:
    """What the rows hold, about: characters of strings, bytes and elements, eight for other values."""
    sizes = []
    for f in df.schema:
        kind = f.dataType.typeName()
        size = F.octet_length(f.name) if kind in ("string", "binary") else F.octet_length(F.to_json(f.name)) if kind in ("array", "struct", "map") else F.lit(0)
        sizes.append(F.coalesce(size.cast("long"), F.lit(0)) + 16)
    return df.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """The table (already written) with a broadcast hint if it holds few enough bytes."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_BYTES else df


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` (already written) joined with ``right``, which has a row per key at most and small rows. Rows of
    hot keys are joined by a broadcast of their fewer than ``HOT`` rows, and are not shuffled; the others by a shuffle."""
    total = left.count()
    hot = [r[0] for r in left.groupBy(key).count().filter(F.col(key).isNotNull() & (F.col("count") > max(total // HOT, HOT))).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.filter(~is_hot).join(right.filter(~is_hot), key, how).unionByName(left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how))


#: Rows of an Arrow batch: texts are long, and a batch is held on both sides of the pipe.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Where the session has Spark's own batch size, a smaller one is set."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run):
    """A mapInArrow function that gives memory back to the system at the end of its partition; workers live
    on, and what they hold counts against the executor."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
            trim(0)

    return wrapped


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra ones (of whatever name) never clash."""
    return df.select(*[df[c] for c in columns])


#: Bits of the largest filter that is broadcast: 2**26 bits are 8 MB.
FILTER_BITS = 26


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A one-hash Bloom filter of a long column as 2**bits bits, whatever the number of keys.

    Each 64-bit word is OR-ed together on the executors, so that at most 2**(bits-6) pairs of a
    word and its place reach the driver. A filter can only let through too much: what uses it
    checks exactly afterwards."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = (
        keys.select(F.shiftright(slot, 6).cast("int").alias("at"), F.expr("1L").alias("one"), slot.bitwiseAND(63).cast("int").alias("bit"))
        .select("at", F.expr("shiftleft(one, bit)").alias("w"))
        .groupBy("at")
        .agg(F.bit_or("w").alias("w"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["at"].to_numpy()] = words["w"].to_numpy().view(np.uint64)
    return out


def may_hold(filter_words: np.ndarray, keys: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Which of the uint64 keys the filter lets through."""
    slot = keys >> np.uint64(64 - bits)
    return (filter_words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
