"""Batched retrieval: dense and lexical top-k, fusion, acceptance and context packing. A batch of
queries is a small table; it is broadcast only behind a check of its size."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.numbering import number_rows
from corpusloom.sources.scratch import written

#: Queries that are broadcast at once, and the bytes that they may hold.
QUERIES, QUERY_BYTES = 10_000, 64_000_000


def query_blocks(queries: DataFrame, most: int = QUERIES, row_bytes: int = 0) -> list[DataFrame]:
    """The queries in blocks, each small enough to broadcast (``most`` rows, and ``QUERY_BYTES`` of rows of ``row_bytes``); the points are read
    once for each block. Blocks are dealt by a hash of query_id, half of ``most`` on average, so that none exceeds it."""
    n = queries.count()
    most = min(most, max(1, QUERY_BYTES // row_bytes)) if row_bytes else most
    if n <= most:
        return [F.broadcast(queries)]
    blocks = -(-2 * n // most)
    of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return [F.broadcast(queries.filter(of == i)) for i in range(blocks)]


def match_filter(**criteria) -> Column | None:
    """AND of equalities, IN for lists; None and empty lists are dropped; None if nothing is left."""
    parts = [F.col(k).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in criteria.items() if v is not None and v != []]
    return reduce(Column.__and__, parts) if parts else None


def unit(v: Column) -> Column:
    """v over its L2 norm, as doubles; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def ranked(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k of each query, ranks from 1; Spark limits groups before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows over their L2 norms, as doubles; zero vectors stay."""
    if not len(vectors):
        return np.zeros((0, 0))
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norms = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(norms == 0, 1.0, norms)


#: Scores that a worker holds at once.
SCORES = 4_000_000


def _scores(points: DataFrame, block: DataFrame, k: int | None, threshold: float | None) -> DataFrame:
    """(query_id, point_id, score): a matrix product per Arrow batch of points with the block's queries. Of each batch and query the ``k``
    best come out (None: all), with what ties with the last of them."""
    asked = block.select("query_id", "vector").toArrow()  # a block is bounded in rows and bytes
    kinds = {f.name: f.dataType.simpleString() for f in [block.schema["query_id"], points.schema["point_id"]]}
    shared = points.sparkSession.sparkContext.broadcast((asked["query_id"].combine_chunks(), _matrix(asked["vector"].combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        step = max(1, SCORES // max(1, len(ids)))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            if not len(ids):
                continue
            score = np.round(_matrix(batch.column(1)) @ queries.T, 9) + 0.0
            keep = np.ones(score.shape, bool)
            if k is not None and len(score) > k:
                keep = score >= np.partition(score, len(score) - k, axis=0)[len(score) - k]
            if threshold is not None:
                keep &= score >= threshold
            point, query = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), batch.column(0).take(pa.array(point)), pa.array(score[point, query])], names=["query_id", "point_id", "score"])

    own = points.filter(F.size("embedding") > 0).select("point_id", "embedding")
    return own.mapInArrow(run, f"query_id {kinds['query_id']}, point_id {kinds['point_id']}, score double")


def _row_bytes(queries: DataFrame) -> int:
    return 8 * (queries.agg(F.max(F.size("vector"))).first()[0] or 1)


def dense_search(points: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, criteria: dict | None = None) -> DataFrame:
    """``points``: point_id, embedding, payload; ``queries``: query_id, vector. Cosine, best first, ties by point_id. Points or queries without a
    vector are in no result; all vectors have one length."""
    where = match_filter(**(criteria or {}))
    points = points if where is None else points.filter(where)
    queries = queries.select("query_id", "vector").filter(F.size("vector") > 0)
    found = [ranked(_scores(points, block, k, threshold), k, F.desc("score"), F.asc("point_id")) for block in query_blocks(queries, row_bytes=_row_bytes(queries))]
    return reduce(DataFrame.unionByName, found)


def count_points(points: DataFrame, criteria: dict | None = None) -> DataFrame:
    """One row: how many points match; the filter reaches the scan, and no other column is read."""
    where = match_filter(**(criteria or {}))
    return (points if where is None else points.filter(where)).agg(F.count(F.lit(1)).alias("point_count"))


def scroll(points: DataFrame, criteria: dict, limit: int) -> DataFrame:
    """Points that match, in the order of their ids, up to the limit that a scroll has."""
    where = match_filter(**criteria)
    return (points if where is None else points.filter(where)).orderBy("point_id").limit(limit)


def retrieve(points: DataFrame, queries: DataFrame, initial: int, final: int, threshold: float, criteria: dict | None = None, lexical: int = 32) -> DataFrame:
    """``points``: point_id, embedding, text, source, place and payload; ``queries``: query_id, query, vector. The first ``initial`` of each query by
    cosine, and, only where criteria select a document (source_path), fused with its lexical hits and their neighbours; ``accepted`` marks the
    ``final`` that reach the threshold."""
    if initial <= 0 or final <= 0 or final > initial:
        raise ValueError("1 <= final <= initial must hold")
    if not -1 <= threshold <= 1:
        raise ValueError("a threshold is a cosine")
    if not queries.filter(F.coalesce(T.strip(F.col("query")), F.lit("")) == "").isEmpty():
        raise ValueError("a query must not be empty")
    dense = dense_search(points, queries, initial, criteria=criteria)
    if not (criteria or {}).get("source_path"):
        return accept(dense.withColumns({"match_type": F.lit(None).cast("string"), "rrf": F.lit(None).cast("double")}), threshold, final)
    where = match_filter(**criteria)
    chunks = points.filter(where)
    found = with_neighbours(lexical_search(chunks, queries.select("query_id", "query"), lexical), chunks.select("point_id", "source", "place"), lexical)
    return accept(fuse(dense, found, initial), threshold, final)


def similarities(points: DataFrame) -> DataFrame:
    """(a, b, score) of every pair of points, each with itself: a matrix, so as many rows as the square of the points, worked out in blocks
    of bounded size."""
    own = points.select(F.col("point_id").alias("query_id"), F.col("embedding").alias("vector")).filter(F.size("vector") > 0)
    blocks = query_blocks(own, row_bytes=_row_bytes(own))
    return reduce(DataFrame.unionByName, [_scores(points, block, None, None) for block in blocks]).select(F.col("query_id").alias("a"), F.col("point_id").alias("b"), "score")


def phrase_weights(x: Column) -> Column:
    """Phrases of a query with what each adds where a text holds it: 0.65 or 0.45 for an exact phrase, and 0.10 for every time that a technical token is
    given."""
    exact = F.transform(T.phrases(x), lambda p: F.struct(p.alias("phrase"), F.when(p.rlike(r"^--|[_/.()]|^[0-9]+$"), 0.65).otherwise(0.45).alias("weight")))
    technical = F.filter(T.tokens(x), lambda t: t.rlike(r"[./]|^--") & (F.length(t) >= 2))
    return F.concat(exact, F.transform(technical, lambda t: F.struct(t.alias("phrase"), F.lit(0.10).alias("weight"))))


#: Queries of a block of a lexical search.
LEXICAL_QUERIES = 500


def lexical_search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``chunks``: point_id, text; ``queries``: query_id, query. (query_id, point_id, score, matched, rank); rows that score 0 are dropped.

    The texts are read and cut once for a block. The terms of a text meet the queries' terms in an equi-join with a broadcast, the phrases that it holds those of the
    queries in the same join, so that a pair of a text and a query exists only where they share one of these, and is summed up before the shuffle. A block's distinct phrases
    are looked for in each text: those of one token (with a mark: . _ / : or --) among the text's tokens with a mark, since a token is a maximal run of its characters,
    the others in the whole text."""
    parts = F.struct(T.tokens(T.lexical_norm(F.col("text"))).alias("own"), T.lexical_norm(F.coalesce("text", F.lit(""))).alias("norm"))
    chunks = chunks.select("point_id", F.inline(F.array(parts)))  # a barrier: what follows does not cut the text again
    marked = F.array_join(F.array_distinct(F.filter("own", lambda t: t.rlike("[._/:]|--"))), " ")
    cut = F.struct(T.contentful(F.coalesce("own", F.array().cast("array<string>"))).alias("terms"), marked.alias("marked"), F.col("norm"))
    chunks = chunks.select("point_id", F.inline(F.array(cut)))
    queries = queries.select("query_id", T.contentful(T.tokens(T.lexical_norm(F.col("query")))).alias("q_terms"), phrase_weights(F.col("query")).alias("q_phrases"))

    def found(block: DataFrame) -> DataFrame:
        block = F.broadcast(written(block, "queries"))  # its phrases are worked out once
        terms = block.select("query_id", F.lit(False).alias("is_phrase"), F.explode("q_terms").alias("said"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("weight"))
        weights = block.select("query_id", F.explode("q_phrases").alias("p")).select("query_id", "p.phrase", "p.weight").groupBy("query_id", "phrase").agg(F.sum("weight").alias("weight"))
        known = [r[0] for r in weights.select("phrase").distinct().collect()]  # of a block of queries
        said = F.transform("terms", lambda t: F.struct(F.lit(False).alias("is_phrase"), t.alias("said")))
        if known:
            one = F.from_json(F.lit(json.dumps([p for p in known if _ONE_TOKEN.fullmatch(p)])), "array<string>")
            more = F.from_json(F.lit(json.dumps([p for p in known if not _ONE_TOKEN.fullmatch(p)])), "array<string>")
            held = F.concat(F.filter(one, lambda p: F.contains(F.col("marked"), p)), F.filter(more, lambda p: F.contains(F.col("norm"), p)))
            said = F.concat(said, F.transform(held, lambda p: F.struct(F.lit(True).alias("is_phrase"), p.alias("said"))))
            terms = terms.unionByName(weights.select("query_id", F.lit(True).alias("is_phrase"), F.col("phrase").alias("said"), F.lit(0).cast("long").alias("n"), "weight"))
        shared = chunks.select("point_id", F.size("terms").alias("size"), F.inline(said)).join(F.broadcast(written(terms, "query-terms")), ["is_phrase", "said"])
        sizes = F.broadcast(block.select("query_id", F.size("q_terms").alias("q_size")))
        pairs = shared.groupBy("query_id", "point_id").agg(F.max("size").alias("size"), F.sum("n").alias("matched"), F.sum("weight").alias("weight")).join(sizes, "query_id")
        n = F.col("matched").cast("double")
        overlap = F.when(F.col("q_size") == 0, 0.0).otherwise(0.45 * n / F.greatest("q_size", F.lit(1)) + 0.10 * n / F.sqrt((F.col("q_size") * F.greatest("size", F.lit(1))).cast("double")))
        hits = pairs.select("query_id", "point_id", F.round(F.least(F.lit(1.0), overlap + F.col("weight")), 9).alias("score"), "matched").filter("score > 0")
        return ranked(hits, k, F.desc("score"), F.desc("matched"), F.asc("point_id"))

    return reduce(DataFrame.unionByName, map(found, query_blocks(queries, LEXICAL_QUERIES)))


#: A phrase that can only stand inside one token with a mark.
_ONE_TOKEN = re.compile(r"[A-Za-z0-9_./:-]*(?:[._/:]|--)[A-Za-z0-9_./:-]*")


def with_neighbours(hits: DataFrame, chunks: DataFrame, k: int, window: int = 1, score: float = 0.30) -> DataFrame:
    """Adds chunks within ``window`` places of a hit in the same source. ``chunks``: point_id, source, place. The chunks of sources with hits
    are numbered by place and point_id, by ranges, so a large source is the work of many tasks; then this is an equi-join on (source, number)."""
    hits = written(hits, "hits")  # of a batch of queries, k for each
    own = chunks.select("point_id", "source", "place")
    sources = own.join(F.broadcast(hits.select("point_id").distinct()) if hits.count() <= QUERIES else hits.select("point_id").distinct(), "point_id", "left_semi").select("source").distinct()
    chunks = number_rows(own.join(sources, "source", "left_semi"), ["source"], ["place", "point_id"], "at")
    steps = F.array(*[F.lit(i) for i in range(-window, window + 1) if i])
    near = hits.join(chunks, "point_id").select("query_id", "source", "at", F.explode(steps).alias("step")).select("query_id", "source", (F.col("at") + F.col("step")).alias("at")).join(chunks, ["source", "at"]).select("query_id", "point_id").distinct()
    near = near.join(hits.select("query_id", "point_id"), ["query_id", "point_id"], "left_anti")
    both = hits.select("query_id", "point_id", "score", "matched").unionByName(near.select("query_id", "point_id", F.lit(score).alias("score"), F.lit(0).cast("long").alias("matched")))
    return ranked(both, k, F.desc("score"), F.desc("matched"), F.asc("point_id"))


def fuse(dense: DataFrame, lexical: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: score, match_type and order of the chunks of both lists."""
    lex = lexical.select("query_id", "point_id", F.greatest(F.lit(0.30), F.least(F.lit(0.99), 0.35 + F.col("score"))).alias("ls"), F.col("rank").alias("lr"))
    both = dense.select("query_id", "point_id", F.col("score").alias("ds"), F.col("rank").alias("dr")).join(lex, ["query_id", "point_id"], "full")
    raised = F.col("ls").isNotNull() & (F.col("ds").isNull() | (F.col("ls") > F.col("ds")))
    rrf = F.coalesce(1.0 / (constant + F.col("dr")), F.lit(0.0)) + F.coalesce(1.0 / (constant + F.col("lr")), F.lit(0.0))
    fused = both.select("query_id", "point_id", F.when(raised, F.col("ls")).otherwise(F.col("ds")).alias("score"), F.when(F.col("ds").isNull(), "lexical").when(raised, "hybrid").alias("match_type"), F.round(rrf, 12).alias("rrf"))
    return ranked(fused, k, F.desc("rrf"), F.desc("score"), F.asc("point_id"))


def accept(hits: DataFrame, threshold: float, k: int) -> DataFrame:
    """``accepted``: reaches the threshold and is among the first k that do, in the order of ranks."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    good = F.col("score") >= threshold
    return hits.withColumn("accepted", good & (F.sum(good.cast("int")).over(w) <= k))


def pack_context(hits: DataFrame, budget: int, overhead: Column, block: int = 250, part: int = 150, margin: int = 30) -> DataFrame:
    """Whole blocks in order of rank while they fit; the first that does not is cut if enough is left.
    ``hits``: query_id, rank, text; ``overhead``: characters of a block without its text. Adds source_id, block_text, truncated."""
    if budget < 500:
        raise ValueError("the budget is 500 characters at least")
    w = Window.partitionBy("query_id").orderBy("rank")
    sized = hits.withColumn("head", overhead).withColumn("size", F.col("head") + F.length("text"))
    left = budget - F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sized.withColumn("left", left).withColumn("stop", (F.col("left") < block) | (F.col("size") > F.col("left")))
    sized = sized.withColumn("stops", F.sum(F.col("stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    room = F.greatest(F.lit(0), F.col("left") - F.col("head") - margin)
    cut = F.col("stop") & (F.col("stops") == 1) & (F.col("left") >= block) & (room >= part)
    kept = sized.filter((F.col("stops") == 0) | cut)
    shown = F.when(cut, F.concat(F.regexp_replace(F.substring("text", F.lit(1), room.cast("int")), r"(?U)\s+\z", ""), F.lit("\n...[truncated]"))).otherwise(F.col("text"))
    return kept.select("query_id", "rank", F.concat(F.lit("S"), F.row_number().over(w)).alias("source_id"), "point_id", shown.alias("block_text"), cut.alias("truncated"))


def log_sources(hits: DataFrame, packed: DataFrame, cited: DataFrame) -> DataFrame:
    """Log rows of a batch. ``hits``: query_id, rank, point_id, score, accepted; ``packed``: query_id, point_id, source_id of
    the context; ``cited``: query_id, source_id. Each hit with its source_rank, source_id (null: not shown) and ``cited``."""
    shown = packed.select("query_id", "point_id", "source_id")
    used = cited.select("query_id", "source_id").distinct().withColumn("cited", F.lit(True))
    logged = hits.join(shown, ["query_id", "point_id"], "left").join(used, ["query_id", "source_id"], "left")
    return logged.select("query_id", F.col("rank").alias("source_rank"), "source_id", "point_id", "accepted", F.coalesce("cited", F.lit(False)).alias("cited"), "score")
