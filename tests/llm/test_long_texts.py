"""Texts with very many matches: results, and time that does not grow as a square."""

import time

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import arrays, decontamination, merkle, pii

N = 100_000


def test_running_totals_and_cuts(spark):
    xs = [(i * 7919) % 23 for i in range(1000)]
    text = "aé漢🙂\n" * 3000
    own = spark.createDataFrame([(xs, text)], "xs array<int>, text string")
    sums = arrays.running(F.col("xs"), F.lit(0), lambda a, x: a + x, lambda first: F.transform(arrays.numbers(F.lit(1001), 0), first))
    most = arrays.running(F.col("xs"), F.lit(0), lambda a, x: F.greatest(a, x), lambda first: F.transform(arrays.numbers(F.lit(1001), 0), first))
    spans = [(0, 0), (0, 5), (4090, 4100), (4096, 8192), (1, 15000), (14999, 15000), (8192, 8192)]
    cuts = arrays.cutter(F.col("text"), lambda cut: F.array(*[cut(F.lit(a), F.lit(b)) for a, b in spans]))
    keys = [(k * k) % 977 - 400 for k in range(300)]
    among = arrays.sorted_members(F.array(*[F.lit(x).cast("long") for x in keys]), lambda has: F.transform(F.sequence(F.lit(-500).cast("long"), F.lit(700).cast("long")), has))
    assert own.select(among.alias("k"), arrays.sorted_members(F.array().cast("array<bigint>"), lambda has: has(F.lit(3).cast("long"))).alias("none")).first() == ([x in keys for x in range(-500, 701)], False)
    known = arrays.members(F.array(*[F.lit(x).cast("long") for x in (5, -3, 2**62, 11)]), lambda has: F.array(*[has(F.lit(x).cast("long")) for x in (5, -3, 2**62, 11, 6, 0)]))
    r = own.select(sums.alias("s"), most.alias("m"), cuts.alias("c"), known.alias("k")).first()
    assert r.s == [sum(xs[:n]) for n in range(1001)] and r.m == [max(xs[:n], default=0) for n in range(1001)]
    assert r.c == [text[a:b] for a, b in spans] and r.k == [True] * 4 + [False] * 2


def test_personal_data_of_a_text_with_many_matches(spark):
    text = " ".join(f"m{i}@x.org" for i in range(N))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    found = pii.find_personal_data(docs)
    r = found.select("entities", pii.sanitise(F.lit(text), F.col("entities"), F.col("terms")).alias("clean")).first()
    assert time.perf_counter() - began < 60
    assert len(r.entities) == N and all(text[s.start : s.end] == s.value for s in r.entities[:: N // 50])
    assert r.clean == " ".join(["[EMAIL]"] * N)


@pytest.mark.parametrize("short", [False, True])
def test_passages_of_a_text_with_many_hits(spark, short):
    words = [f"w{i}" for i in range(N)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words[: N // 2])), (2, " ".join(words[N // 2 :])), (3, "w1 w2")][0 if not short else 2 :], "item_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.digest(decontamination.find_passages(docs, items)).collect()}
    assert time.perf_counter() - began < 60
    assert got == ({1: (N, 2, 1), 2: (2, 2, 1)} if short else {1: (N, N, 3), 2: (2, 2, 1)})


@pytest.mark.parametrize(("gap", "n"), [("\n", 2 * N), ("\n\n", N // 2)])
def test_fingerprints_of_a_text_of_many_lines(spark, gap, n):
    docs = spark.createDataFrame([(1, gap.join(f"line {i} ends here" for i in range(n))), (2, gap.join(f"other {i} ends too" for i in range(n)))], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in merkle.fingerprint_edits(docs).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].near_next < 0.001 and 0.4 < got[1].near_edited < 0.6 and n // 2 - 10 < got[1].n_edited < n // 2 + 10
