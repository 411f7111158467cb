"""Repeated byte windows against a plain version, with hot passages, copies, periodic and odd texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import suffixes

W = suffixes.WINDOW


def plain(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + W] for t in texts for k in range(len(t) - W + 1))
    out = []
    for (id_, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        reach = 0
        for k in range(len(t)):
            if k + W <= len(t) and seen[t[k : k + W]] > 1:
                reach = k + W
            gone[k] = k < reach
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((id_, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def letters(r, n, chars="abcdefghij é漢🙂"):
    return "".join(r.choice(chars) for _ in range(n))


def cases():
    r = random.Random(5)
    passage, other = letters(r, 400), letters(r, 1500)
    rows = [(i, letters(r, r.randrange(0, 900))) for i in range(30)]
    rows += [(100 + i, letters(r, r.randrange(0, 90)) + passage[r.randrange(0, 60) : 400 - r.randrange(0, 60)] + letters(r, r.randrange(0, 90))) for i in range(60)]  # a hot passage with cut edges
    rows += [(200 + i, other[: 700 + i] + "#" + other[700 + i :]) for i in range(4)]
    rows += [(300, other), (301, other), (302, None), (303, ""), (304, "x" * 199), (305, "x" * 199), (306, "y" * 200), (307, "z" * 201)]
    rows += [(308, "ab" * 400), (309, "ab" * 99 + "c" + "ab" * 150), (None, letters(r, 300) + other[:250]), (None, letters(r, 250)), (310, rows[3][1]), (310, rows[3][1])]
    rows += [(311, letters(r, 100) + passage[:W] + letters(r, 50)), (312, letters(r, 30) + other[100 : 100 + W]), (313, passage[50 : 50 + W - 1])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, monkeypatch, small):
    rows = cases()
    if small:  # rows in many parts, frequent cores, and joins without a broadcast
        monkeypatch.setattr(suffixes, "BUFFER", 200)
        monkeypatch.setattr(suffixes, "BLOCK", 256)
        monkeypatch.setattr(suffixes, "small", lambda df: df)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, spans string, id string").repartition(3)
    found = suffixes.remove_repeats(docs)
    assert sorted(map(tuple, suffixes.digest(found).collect()), key=str) == plain(rows)
    for x in found.filter("kept is not null and doc_id < 300").collect():
        t = dict(rows)[x.doc_id].encode()
        bounds = [0, *(y for s in x.spans for y in (s.start, s.end)), len(t)]
        assert bytes(x.kept) == b"".join(t[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def test_drawn_texts(spark):
    r = random.Random(11)
    pieces = [letters(r, n, "ab") for n in (50, 120, 180, 230, 300)]
    rows = [(i, "".join(r.choice(pieces)[r.randrange(0, 20) :] for _ in range(r.randrange(1, 7)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, suffixes.digest(suffixes.remove_repeats(docs)).collect()), key=str) == plain(rows)


def test_judging_does_not_depend_on_batches():
    r = np.random.default_rng(3)
    rows = np.stack([r.integers(0, 6, 300), r.integers(0, 3, 300), r.integers(0, 2, 300), np.arange(300), (np.arange(300) << 16) | np.where(r.random(300) < 0.1, suffixes.TWICE, 0)])
    rows = rows[:, np.lexsort(rows[2::-1])]

    def run(step):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in rows[:, k : k + step]], names=list("abcde")) for k in range(0, 300, step)]
        out = [x for b in suffixes._refine(batches) for x in b.to_pylist()]
        return {x["id"] for x in out if x["settled"]}, {x["id"] for x in out if x["further"] and not x["settled"]}, {x["id"] for x in out if x["further"]}

    whole = run(300)
    for step in (1, 2, 7, 50):
        assert run(step)[:2] == whole[:2] and run(step)[2] >= whole[2]


def test_tables_without_rows_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert suffixes.digest(suffixes.remove_repeats(empty)).collect() == []
    r = random.Random(2)
    long = letters(r, 600_000)
    rows = [("a", long), ("b", long[:300_000] + "!" + long[300_000:]), ("c", "q" * 100_000)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffixes.digest(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"))).collect()}
    n = len(long.encode())
    assert got == {"a": (n, n, 1), "b": (n + 1, n, 2), "c": (100_000, 100_000, 1)}
