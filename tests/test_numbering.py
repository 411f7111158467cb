"""Row numbers of groups that span many ranges, against Python's sort."""

import random

from corpusloom.operators.numbering import number_rows


def test_numbers(spark):
    r = random.Random(3)
    hot = [("big", r.choice([None, *range(40)]), r.choice([None, "", "é", "x" * 40 + r.choice("abc")])) for _ in range(3000)]
    rows = hot + [(g, k, "t") for g in ("a", "b", None) for k in (3, 1, 2)] + [("dup", 1, "t")] * 5
    df = spark.createDataFrame(rows, "grp string, turn int, text string").repartition(5)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = number_rows(df, ["grp"], ["turn", "text"], "n")
        parts = got.select("n", "grp").filter("grp = 'big'").rdd.getNumPartitions()
        out = got.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert parts > 1 and len(out) == len(rows)
    key = lambda x: ((x[1] is not None, x[1] or 0), (x[2] is not None, (x[2] or "").encode()))
    for g in {x[0] for x in rows}:
        mine = sorted((x for x in out if x.grp == g), key=lambda x: x.n)
        assert [x.n for x in mine] == list(range(len(mine)))
        assert [key(x) for x in mine] == sorted(key(x) for x in rows if x[0] == g)
    assert number_rows(df.limit(0), ["grp"], ["turn"]).collect() == []
