"""A training-data pipeline over ``documents``: five stages, each by one operator of corpusloom.llm.

Each stage takes what its predecessor kept, as a table that was written and read again, and returns
the columns of documents; the last returns the token digests of each document. Columns beyond those of
documents are left out; an empty table gives an empty one. Rows are told apart by doc_id (null or not) and
text, so that a doc_id that stands on rows of different texts does not join their fates."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontamination, jaccard, secrets, toxicity
from corpusloom.llm.store import materialize, small, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[docs[c] for c in COLUMNS])


def _without(docs: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """``docs`` without the rows whose keys are in ``gone``; a null is like a null. Broadcast if few enough bytes."""
    gone = small(materialize(gone.select(*[F.col(k).alias(f"gone_{k}") for k in keys]).distinct(), "pipeline-gone"))
    same = [docs[k].eqNullSafe(F.col(f"gone_{k}")) for k in keys]
    return docs.join(gone, same, "left_anti")


def _text_key() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels of these documents, takes for toxic go, each by its own text.

    A null or empty text, or a null doc_id, is scored like any other; repeated rows go or stay together; without
    labels of both classes the score is the share of toxic labels."""
    docs = _documents(docs)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.trained_rows(F.col("doc_id")))
    return toxicity.score_documents(docs, model, keep=COLUMNS).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of the smallest doc_id, and of that the text with the smallest
    SHA-256 and the smallest other columns.

    Rows of one doc_id with different texts are in groups by their texts. A null or empty text, or one of a
    null doc_id, is in no group, and stays, as often as it is repeated."""
    docs = _documents(docs).withColumn("key", _text_key())
    found = materialize(jaccard.link_documents(docs.select("doc_id", "text", "key"), keep=("key",)).filter("component is not null").select("doc_id", "key", "component"), "pipeline-groups")
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("kept"))
    stays = materialize(kept.select("kept.doc_id", "kept.key", F.lit(True).alias("stays")), "pipeline-stays")
    gone = found.join(stays, ["doc_id", "key"], "left").filter("stays is null").select("doc_id", "key")
    docs = _without(docs, gone, "doc_id", "key")
    repeated = found.join(stays, ["doc_id", "key"]).groupBy("doc_id", "key").count().filter("count > 1")
    repeated = materialize(repeated.select(F.col("doc_id").alias("again_id"), F.col("key").alias("again_key")), "pipeline-repeated")
    if repeated.isEmpty():
        return docs.select(*COLUMNS)
    again = [docs["doc_id"] == F.col("again_id"), docs["key"] == F.col("again_key")]
    one = docs.join(small(repeated), again, "left_semi").groupBy("doc_id", "key").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return docs.join(small(repeated), again, "left_anti").select(*COLUMNS).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go, each by its own text, with a doc_id or without.

    A null or empty text holds none and stays; so does everything if the benchmark is empty."""
    docs = _documents(docs)
    found = decontamination.find_passages(docs, table(spark, sf_dir, "benchmark")).filter("hits is not null")
    return _without(docs.withColumn("th", F.xxhash64("text")), found, "doc_id", "th").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, repeated ones too; secrets in its text give way to their kind, and n_chars follows the text.

    A null text becomes the empty text."""
    found = secrets.scan_secrets(_documents(docs), keep=("doc_id", "lang", "source", "n_chars"), redacted=True)
    return found.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row, with or without a doc_id: the number of its tokens and the digests of ids and of the text they decode to.

    A null or empty text has no tokens."""
    coded = bpe.encode_documents(_documents(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", *bpe.digests(F.col("ids"), F.col("decoded")))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level bpe", tokenize),
]

#: SQL cannot learn a classifier or run merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
