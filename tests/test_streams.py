"""Event-time operators on streams: order does not matter, late rows and idle users are defined."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from corpusloom.streaming import events

SCHEMA = "user_id long, event_id long, event_type string, ts timestamp"


def table(spark, rows):
    rows = [(u, e, kind, float(at)) for u, e, kind, at in rows]
    return spark.createDataFrame(rows, "user_id long, event_id long, event_type string, at double").select("user_id", "event_id", "event_type", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"))


def run(spark, tmp_path, batches, name, **how):
    """Each batch a file, one a trigger."""
    for k, rows in enumerate(batches):
        table(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / f"b{k:02d}"))
    source = tmp_path / "in"
    source.mkdir()
    for k in range(len(batches)):
        (next((tmp_path / f"b{k:02d}").glob("part-*"))).rename(source / f"{k:02d}.parquet")
    stream = events.keyed_streaks(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)), **how)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("memory").queryName(name).start()
    query.awaitTermination(200)
    assert query.exception() is None
    return {r.event_id: (r.user_id, r.event_type, r.streak, r.since_change) for r in spark.table(name).collect()}, query


def test_shuffled_rows_give_the_streaks_of_the_table(spark, tmp_path):
    r = random.Random(1)
    rows = [(k % 3, k, r.choice("aab"), 1_700_000_000 + 5 * k + r.choice([0, 0.25])) for k in range(60)] + [(7, 100, "a", 1_700_000_010), (7, 101, "a", 1_700_000_010)]
    r.shuffle(rows)
    # nothing is later than the allowed delay; the last batch's event lets all others out
    got, query = run(spark, tmp_path, [rows[:20], rows[20:40], rows[40:], [(99, 999, "end", 1_700_100_000)]], "shuffled", late="1 hour")
    assert got == {x.event_id: (x.user_id, x.event_type, x.streak, x.since_change) for x in events.streaks(table(spark, rows)).collect()}


def test_late_rows_and_idle_users(spark, tmp_path):
    t = 1_700_000_000
    batches = [[(1, 1, "a", t), (2, 2, "a", t)], [(1, 3, "a", t + 100)], [(9, 8, "x", t + 110)], [(1, 4, "a", t + 20), (9, 5, "x", t + 4000)], [(1, 6, "a", t + 90_000)], [(9, 7, "x", t + 200_000)]]
    got, query = run(spark, tmp_path, batches, "idle", late="50 seconds", idle=timedelta(hours=2))
    # 4 comes behind the watermark; 6 comes after two hours of silence
    assert {k: v[2] for k, v in got.items()} == {1: 1, 2: 1, 3: 2, 8: 1, 5: 2, 6: 1}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8  # of user 9 alone
