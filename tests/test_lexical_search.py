"""A lexical search reads the texts once, and builds no index for the sake of one search."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom import catalogue
from corpusloom.operators import retrieval

DATA = "/root/testdata/sf0.001"


def test_texts_are_read_once(spark, tmp_path):
    rows = [(i, f"term{i % 5} other src/app_{i % 3}.py here " + 'a "quoted span" too' * (i % 2)) for i in range(40)]
    spark.createDataFrame(rows, "point_id long, text string").write.parquet(str(tmp_path / "chunks"))
    queries = spark.createDataFrame([(1, "term1 src/app_1.py"), (2, 'find "quoted span"'), (3, None)], "query_id long, query string")
    found = retrieval.lexical_search(spark.read.parquet(str(tmp_path / "chunks")), queries, 40)
    got = {(r.query_id, r.point_id): (r.matched, r.score) for r in found.collect()}
    assert {p for q, p in got if q == 1} == {i for i in range(40) if i % 5 == 1 or i % 3 == 1} and {p for q, p in got if q == 2} == set(range(1, 40, 2))
    assert got[(1, 1)] > got[(1, 6)] and sorted(r.rank for r in found.filter("query_id = 2").collect()) == list(range(1, 21))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [point_id") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_queries_write_no_texts(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    found = catalogue.QUERIES["lexical_with_neighbours"](spark, DATA)
    assert found.count() and found.filter(F.col("rank") > 32).isEmpty()
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("terms-")]
