"""A stored index of vectors in clusters, and exact top-k that leaves out clusters and shells by the triangle inequality.

Unit vectors lie in directories by their nearest centre, sorted by their distance from it; a table keeps each centre with the least and greatest
distance of its vectors. For a query at distance d of a centre, and a distance t within which the k best are known to lie, only vectors whose
own distance from the centre is within [d - t, d + t] can be among them: whole clusters are left out, of the others Parquet's
statistics leave out row groups. t comes from a first look at the nearest clusters, so results are those of comparing with all vectors.

How much is left out depends on the data: of vectors in clumps most, of vectors that point anywhere evenly nothing, and then the index
costs its first look. :meth:`DenseIndex.reads` tells the share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import SCORES, _matrix, match_filter, query_blocks, ranked
from corpusloom.sources.scratch import written

#: Vectors that centres are fitted on, at most (the least by a hash of their id), and rounds of the fit; every vector is put in the index.
SAMPLE, ROUNDS = 20_000, 8
#: Centres: the root of the number of vectors, and at most so many.
CENTRES = 4096
#: Queries of a block, so that their distances from all centres are a small matrix.
BLOCK = 1000
_SLACK = 1e-6


def fit_centres(sample: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit vectors, from ``count`` of them on, by the usual rounds."""
    centres = sample[:: max(1, len(sample) // max(1, count))][:count].copy()
    for _ in range(rounds if len(centres) else 0):
        own = _nearest(sample, centres)[0]
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (rows * rows).sum(1)[:, None] + (centres * centres).sum(1) - 2 * rows @ centres.T
    own = square.argmin(1)
    return own, np.sqrt(((rows - centres[own]) ** 2).sum(1))


def _read(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/empty").schema
    return spark.read.schema(schema).parquet(f"{path}/vectors")


def build_dense_index(points: DataFrame, path: str, centres: int | None = None, sample: int = SAMPLE) -> None:
    """``points``: point_id, embedding and payload. Vectors of length 0 are left out, as they are in no result."""
    spark = points.sparkSession
    points = points.filter(F.size("embedding") > 0)
    count = centres or min(CENTRES, max(1, int(points.count() ** 0.5)))
    some = points.select("point_id", "embedding").orderBy(F.xxhash64("point_id"), "point_id").limit(sample)  # Spark keeps the least of each task
    vectors = some.select("embedding").toArrow()["embedding"].combine_chunks()
    shared = spark.sparkContext.broadcast(fit_centres(_matrix(vectors), count))
    at = points.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(at))
            own, away = _nearest(rows, shared.value)
            own = np.where((rows == 0).all(1), -1, own)  # zero vectors have no direction: they are always looked at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "cluster", "away"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    placed = points.mapInArrow(run, f"{kinds}, cluster int, away double")
    placed.limit(0).write.parquet(f"{path}/empty")  # has the columns, if there are no vectors
    placed.repartitionByRange("cluster", "away").sortWithinPartitions("cluster", "away").write.partitionBy("cluster").parquet(f"{path}/vectors")
    stats = _read(spark, path).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).toArrow().to_pylist()
    where = shared.value.tolist()
    rows = [(int(r["cluster"]), r["n"], r["low"], r["high"], where[r["cluster"]] if r["cluster"] >= 0 else []) for r in stats]
    spark.createDataFrame(rows, "cluster int, n long, low double, high double, centre array<double>").coalesce(1).write.parquet(f"{path}/clusters")


class DenseIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.vectors = spark, _read(spark, path)
        known = spark.read.parquet(f"{path}/clusters").orderBy("cluster").toArrow()  # CENTRES + 1 rows at most
        self.cluster = known["cluster"].to_numpy()
        self.n, self.low, self.high = (known[c].to_numpy() for c in ("n", "low", "high"))
        self.zero = self.cluster < 0
        self.centres = np.array([c for c in known["centre"].to_pylist() if c], np.float64)

    def _far(self, queries: np.ndarray) -> np.ndarray:
        """Distances of queries from the centres; 0 from the zero vectors' cluster."""
        out = np.zeros((len(queries), len(self.cluster)))
        for k, c in zip(np.flatnonzero(~self.zero), self.centres, strict=True):
            out[:, k] = np.sqrt(((queries - c) ** 2).sum(1))
        return out

    def _best(self, asked: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which pairs of a query and a cluster can hold a vector within ``near`` of the query."""
        band = (far - near[:, None] <= self.high + _SLACK) & (far + near[:, None] >= self.low - _SLACK)
        band = np.where(self.zero, near[:, None] >= 2**0.5 - _SLACK, band)  # their score is 0, as that of vectors at right angles
        return band | (asked == 0).all(1)[:, None]

    def _scored(self, ids: pa.Array, asked: np.ndarray, pairs: np.ndarray, near: np.ndarray, far: np.ndarray, k: int, threshold: float | None, where) -> DataFrame:
        """(query_id, point_id, score) of the pairs of queries and clusters, the best of each Arrow batch."""
        used = np.flatnonzero(pairs.any(0))
        points = self.vectors.filter(F.col("cluster").isin([int(c) for c in self.cluster[used]]))
        if where is not None:
            points = points.filter(where)
        if not (asked == 0).all(1).any() and not self.zero[used].any() and len(used):  # the shells that any query needs
            low, high = np.where(pairs, far - near[:, None], np.inf).min(), np.where(pairs, far + near[:, None], -np.inf).max()
            points = points.filter((F.col("away") >= float(low) - _SLACK) & (F.col("away") <= float(high) + _SLACK))
        place = np.full(int(self.cluster.max(initial=0)) + 2, -1)
        place[self.cluster] = np.arange(len(self.cluster))  # -1 is the last
        shared = self.spark.sparkContext.broadcast((ids, asked, pairs, place))
        kinds = f"query_id {self.kind}, point_id {self.vectors.schema['point_id'].dataType.simpleString()}, score double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked, pairs, place = shared.value
            step = max(1, SCORES // max(1, len(ids)))
            for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
                own = pairs[:, place[batch.column(2).to_numpy()]].T
                some = np.flatnonzero(own.any(0))
                if not len(some):
                    continue
                score = np.where(own[:, some], np.round(_matrix(batch.column(1)) @ asked[some].T, 9) + 0.0, -np.inf)
                keep = score > -np.inf
                if len(score) > k:
                    keep &= score >= np.partition(score, len(score) - k, axis=0)[len(score) - k]
                if threshold is not None:
                    keep &= score >= threshold
                point, query = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some[query])), batch.column(0).take(pa.array(point)), pa.array(score[point, query])], names=["query_id", "point_id", "score"])

        return points.select("point_id", "embedding", "cluster").mapInArrow(run, kinds)

    def _block(self, block: DataFrame, k: int, threshold: float | None, where):
        """Ids and vectors of a block of queries, their distances from the centres, and the distance within which the k best lie."""
        table = block.select("query_id", "vector").toArrow()  # BLOCK rows at most
        ids, asked = table["query_id"].combine_chunks(), _matrix(table["vector"].combine_chunks())
        far = self._far(asked) if len(ids) else np.zeros((0, len(self.cluster)))
        order = np.argsort(far, 1)
        counted = np.cumsum(self.n[order], 1) - self.n[order] < k  # clusters, nearest first, until they hold k vectors
        first = np.zeros(far.shape, bool)
        np.put_along_axis(first, order, counted, 1)
        everywhere = np.full(len(ids), np.inf)
        looked = ranked(self._scored(ids, asked, first, everywhere, far, k, None, where), k, F.desc("score"), F.asc("point_id"))
        least = dict(looked.filter(F.col("rank") == k).select("query_id", "score").toArrow().to_pandas().itertuples(index=False, name=None))
        reach = np.array([max(least.get(i, -1.0), -1.0 if threshold is None else threshold) for i in ids.to_pylist()])
        return ids, asked, far, np.sqrt(np.maximum(0, 2 - 2 * reach) + 1e-8)

    def search(self, queries: DataFrame, k: int, threshold: float | None = None, criteria: dict | None = None) -> DataFrame:
        """``queries``: query_id, vector. The rows that :func:`retrieval.dense_search` over all vectors gives."""
        self.kind, where = queries.schema["query_id"].dataType.simpleString(), match_filter(**(criteria or {}))
        found = []
        for block in query_blocks(queries.filter(F.size("vector") > 0), BLOCK):
            ids, asked, far, near = self._block(block, k, threshold, where)
            found.append(ranked(self._scored(ids, asked, self._best(asked, near, far), near, far, k, threshold, where), k, F.desc("score"), F.asc("point_id")))
        return reduce(DataFrame.unionByName, found)

    def reads(self, queries: DataFrame, k: int) -> DataFrame:
        """For each query: clusters and vectors that its search looks at, and the share of all vectors."""
        self.kind, rows = queries.schema["query_id"].dataType.simpleString(), []
        for block in query_blocks(queries.filter(F.size("vector") > 0), BLOCK):
            ids, asked, far, near = self._block(block, k, None, None)
            used = self._best(asked, near, far)
            rows += [(i, int(u.sum()), int(self.n[u].sum()), float(self.n[u].sum() / self.n.sum())) for i, u in zip(ids.to_pylist(), used, strict=True)]
        return written(self.spark.createDataFrame(rows, f"query_id {self.kind}, clusters long, vectors long, share double"), "reads")
