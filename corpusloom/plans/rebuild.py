"""The index rebuild as one lazy plan: files, safety, units, chunks, unique chunks, vectors, index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions import text as T
from corpusloom.operators import chunking, dedup, governance
from corpusloom.sources import files, sinks


class Embedder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing of tokens: a stand-in where no neural model is at hand."""

    dimension = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed(chunks: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """Rows whose text is not blank, with ``embedding``; the embedder goes to each task once and gets Arrow batches."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.encode(texts.tolist())))

    return chunks.filter(T.strip(F.col(text)) != "").withColumn("embedding", encode(F.col(text)))


def plan(spark: SparkSession, root: str, production: bool = True, embedder: Embedder | None = None) -> dict[str, DataFrame]:
    """The tables of a rebuild, lazily: safety, units, reports, chunks, points."""
    found = files.discover(spark, root)
    readable = T.extension(F.col("path")).isin(*rules.SCANNED_EXTENSIONS)
    supported = found.filter(T.extension(F.col("path")).isin(*rules.LOADED_EXTENSIONS))
    safety = governance.scan(supported.select("path", F.when(readable, F.try_validate_utf8(F.substring("content", 1, 800_000))).alias("text"), "modified", F.sha2("content", 256).alias("sha256")), production)
    kept = found.join(safety.filter("status != 'accepted'").select("path"), "path", "left_anti")
    units = files.load(kept)
    chunks = chunking.chunk_units(units.filter("text is not null").select("unit_id", "text", "row_start"))
    lineage = units.select("unit_id", F.col("path").alias("source_path"), "document_id", "unit_index")
    chunks = chunks.join(lineage, "unit_id").withColumn("category", T.category(F.col("source_path"))).withColumn("ord", F.struct("source_path", "unit_index", "chunk_index"))
    chunks = chunks.join(safety.select(F.col("path").alias("source_path"), F.col("status").alias("index_file_status"), F.col("sha256").alias("index_file_sha256"), F.col("warnings").alias("index_file_warnings")), "source_path", "left")
    points = embed(dedup.unique_chunks(chunks).filter("first").drop("first", "ord"), embedder or HashEmbedder())
    return {"safety": safety, "units": units, "reports": files.reports(units), "chunks": chunks, "points": points.withColumn("point_id", T.uuid5(T.POINT_NAMESPACE, F.col("chunk_id")))}


def rebuild(spark: SparkSession, root: str, index: str, production: bool = True, embedder: Embedder | None = None) -> str:
    return sinks.write_index(plan(spark, root, production, embedder)["points"], index)
