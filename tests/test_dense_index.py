"""The clustered index gives what comparing with all vectors gives, and reads a part of vectors in clumps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.operators.dense_index import DenseIndex, build_dense_index

R = np.random.default_rng(5)
CLUMPS = R.normal(size=(12, 16))
VECTORS = np.concatenate([c + 0.15 * R.normal(size=(40, 16)) for c in CLUMPS] + [R.normal(size=(20, 16))])
ROWS = [(k, v.tolist(), k % 3) for k, v in enumerate(VECTORS)] + [(900, [0.0] * 16, 1), (901, [], 1), (902, None, 1), (903, VECTORS[0].tolist(), 0), (904, VECTORS[0].tolist(), 0), (905, (3 * VECTORS[0]).tolist(), 2)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(ROWS, "point_id long, embedding array<double>, label int").repartition(3)


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dense")) + "/index"
    build_dense_index(points, path, centres=12)
    return DenseIndex(spark, path)


@pytest.mark.parametrize(("k", "threshold", "criteria"), [(1, None, None), (5, None, None), (8, 0.5, None), (6, None, {"label": [1, 2]}), (1000, None, None)])
def test_same_rows_as_all_vectors(spark, points, index, k, threshold, criteria):
    asked = points.filter("point_id % 20 = 0 or point_id >= 900").select(F.col("point_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = sorted(map(tuple, retrieval.dense_search(points, asked, k, threshold, criteria).collect()))
    assert sorted(map(tuple, index.search(asked, k, threshold, criteria).collect())) == want and want


def test_reads_a_part(points, index):
    asked = points.filter("point_id % 40 = 7 and point_id < 480").select(F.col("point_id").alias("query_id"), F.col("embedding").alias("vector"))
    shares = [r.share for r in index.reads(asked, 5).collect()]
    assert len(shares) == 12 and np.mean(shares) < 0.4
    plan = index.search(asked, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(away" in plan


def test_empty_tables(spark, points, tmp_path):
    build_dense_index(points.limit(0), str(tmp_path / "none"))
    none = DenseIndex(spark, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert none.search(asked, 3).collect() == [] and none.search(asked.limit(0), 3).collect() == []
