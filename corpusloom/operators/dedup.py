"""Exact duplicates with lineage: one shuffle on the content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_groups(chunks: DataFrame, key: str = "content_sha256", order: str = "ord", id_: str = "chunk_id", path: str = "source_path") -> DataFrame:
    """Groups of two or more: the first chunk stands for the group."""
    g = chunks.groupBy(key).agg(F.min_by(id_, order).alias("representative_id"), F.count("*").alias("n"), F.array_sort(F.collect_set(path)).alias("occurrence_source_paths"), F.array_sort(F.collect_list(F.struct(order, id_))).alias("all"))
    return g.filter("n > 1").select(key, "representative_id", F.expr(f"transform(slice(all, 2, cast(n as int) - 1), x -> x.{id_})").alias("duplicate_chunk_ids"), "occurrence_source_paths", (F.col("n") - 1).alias("duplicate_count"))


def duplicate_rows(chunks: DataFrame, key: str = "content_sha256", order: str = "ord", id_: str = "chunk_id") -> DataFrame:
    """The groups as rows, one for each further chunk, for groups that are too large to be one row: key, representative_id, duplicate_id. The
    first of a content is found by a partial minimum, and the join with it can be split."""
    first = chunks.groupBy(key).agg(F.min(F.struct(order, id_)).alias("f"), F.count("*").alias("n")).filter("n > 1").select(key, F.col(f"f.{id_}").alias("representative_id"), F.col("f").alias("head"))
    return chunks.join(first, key).filter(F.struct(order, id_) > F.col("head")).select(key, "representative_id", F.col(id_).alias("duplicate_id"))


def unique_chunks(chunks: DataFrame, key: str = "content_sha256", order: str = "ord", id_: str = "chunk_id") -> DataFrame:
    """All rows with ``first``: whether it is the first of its content (by order and id). A content's first is found by a partial minimum, so that
    no content's rows are sorted in one task; the join with it can be split where one content is very frequent."""
    first = chunks.groupBy(key).agg(F.min(F.struct(order, id_)).alias("head"))
    return chunks.join(first, key).withColumn("first", F.struct(order, id_) == F.col("head")).drop("head").select(*chunks.columns, "first")


def counters(chunks: DataFrame, key: str = "content_sha256") -> DataFrame:
    """Two levels of aggregation: groups with duplicates, and chunks that are skipped."""
    return chunks.groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_groups"), F.sum(F.col("count") - 1).alias("skipped_exact_duplicates"), F.count("*").alias("unique_chunks"), F.sum("count").alias("all_chunks"))
