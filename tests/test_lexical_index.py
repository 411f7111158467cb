"""The stored index gives what the search over texts gives, and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.operators.lexical_index import LexicalIndex, anchor, build_lexical_index

R = random.Random(6)
COMMON = [f"common{k}" for k in range(12)]
RARE = [f"rare{k}" for k in range(400)]


def text():
    own = [w for w in COMMON if R.random() < 0.7] + R.sample(RARE, R.randrange(0, 8)) + R.sample(["src/app_main.py", "--fast-mode", "v1.2", "the", "and", "โมเดล", "x"], R.randrange(0, 4))
    R.shuffle(own)
    return " ".join(own)


CHUNKS = [(k, text()) for k in range(600)] + [(900, None), (901, ""), (902, "The AND of"), (903, "a `quoted span` here"), (904, "a quoted span there, quoted spans"), (905, CHUNKS_TEXT := text()), (906, CHUNKS_TEXT)]
QUERIES = [(1, " ".join(COMMON[:6] + RARE[:3])), (2, "src/app_main.py --fast-mode"), (3, 'find "quoted span"'), (4, "the"), (5, None), (6, '"an"'), (7, '"e an"'), (8, "โมเดล rare7"), (9, CHUNKS_TEXT), (10, " ".join(RARE[10:60])), (11, "unknownword"), (12, "`--fast`"), (13, "")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    chunks = spark.createDataFrame(CHUNKS, "point_id long, text string").repartition(3)
    path = str(tmp_path_factory.mktemp("index")) + "/terms"
    build_lexical_index(chunks, path, buckets=8)
    return chunks, spark.createDataFrame(QUERIES, "query_id long, query string"), path


@pytest.mark.parametrize("k", [1, 5, 40])
def test_same_rows_as_without_index(spark, tables, k):
    chunks, queries, path = tables
    want = sorted(map(tuple, retrieval.lexical_search(chunks, queries, k).collect()))
    assert sorted(map(tuple, LexicalIndex(spark, path, 8).search(queries, k).collect())) == want and want
    some = chunks.filter("point_id % 3 = 0")
    want = sorted(map(tuple, retrieval.lexical_search(some, queries, k).collect()))
    assert sorted(map(tuple, LexicalIndex(spark, path, 8, among=some).search(queries, k).collect())) == want


def test_reads_less(spark, tables):
    _, queries, path = tables
    index = LexicalIndex(spark, path, 8)
    asked = queries.filter("query_id = 1").select("query_id", F.split("query", " ").alias("q_terms"), F.array().cast("array<struct<phrase:string,weight:double>>").alias("q_phrases"))
    terms, known = index.plan_terms(asked, 3, None)
    n = {r.term: (r.n, r.needed) for r in terms.collect()}
    assert not all(need for _, need in n.values()) and all(need for t, (_, need) in n.items() if t.startswith("rare"))
    assert max(c for c, need in n.values() if need) <= min((c for c, need in n.values() if not need))
    one = index.of_terms(asked.select("query_id", F.lit(RARE[0]).alias("term"), F.lit(known[0]).alias("bucket")), known[:1])
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_anchor_of_phrases():
    assert anchor("a quoted-span here") == "quoted-span" and anchor("the") is None and anchor("x") is None and anchor("ร้าน โมเดล")


def test_empty_tables(spark, tables, tmp_path):
    chunks, queries, path = tables
    build_lexical_index(chunks.limit(0), str(tmp_path / "none"))
    assert LexicalIndex(spark, str(tmp_path / "none")).search(queries, 3).collect() == []
    assert LexicalIndex(spark, path, 8).search(queries.limit(0), 3).collect() == []
