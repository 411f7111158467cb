"""What promotions and upserts move: contents are copied once, and not shuffled to be compared by key."""

import os

from pyspark.sql import functions as F

from corpusloom.sources import sinks


def test_contents_are_not_shuffled_by_key(spark, tmp_path, monkeypatch):
    plans, real = [], sinks._write_buckets

    def write(merged, *rest):
        plans.append(merged._jdf.queryExecution().executedPlan().toString())
        return real(merged, *rest)

    monkeypatch.setattr(sinks, "_write_buckets", write)
    before, folder = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.checkpoint.dir")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    there = set(os.listdir(folder))
    try:
        stage, docs = str(tmp_path / "stage"), str(tmp_path / "docs")
        for tag, rows in (("x", spark.range(30)), ("y", spark.range(0, 40, 3).union(spark.range(0, 40, 9)))):
            own = rows.select(F.concat(F.lit("f"), "id").alias("path"), F.concat(F.lit(tag), F.spark_partition_id()).cast("binary").alias("content"))
            sinks.stage(own, stage)
            sinks.promote(spark, stage, docs)
        got = {r.path: bytes(r.content)[:1].decode() for r in sinks.read_index(spark, docs).collect()}
        assert got == {f"f{i}": "y" if i % 3 == 0 else "x" for i in [*range(30), 30, 33, 36, 39]} and sinks.staged(spark, stage).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and "SortMergeJoin" not in plans[1] and "Exchange hashpartitioning" not in plans[1]
    assert not [x for x in set(os.listdir(folder)) - there if x.startswith("promoted-")]
