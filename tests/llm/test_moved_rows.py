"""What the steps of the joins move and make, beside their results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import jaccard, substrings

PASSAGE = " ".join(f"p{i}" for i in range(80))


def kept(monkeypatch, module):
    """Tables that a module writes, by name, with the plans that made them."""
    tables, real = {}, module.materialize

    def write(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        table = real(df, name)
        tables.setdefault(name, (table, plan))  # the first of the name
        return table

    monkeypatch.setattr(module, "materialize", write)
    return tables


def test_windows_of_hot_names_make_no_rows_of_a_join(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SAMPLE", 1)
    monkeypatch.setattr(substrings, "HOT_LEAST", 20)
    monkeypatch.setattr(substrings, "HOT", 10**9)
    rows = [(i, " ".join(f"a{i}.{k}" for k in range(i % 7)) + f" {PASSAGE} b{i}") for i in range(40)] + [(50, None), (None, PASSAGE + " x")]
    tables = kept(monkeypatch, substrings)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: 80 * (i in range(1, 40)) for i, _ in rows}
    stretches, plan = tables["repeats-stretches"]
    assert "Join" not in plan and stretches.count() == 39


@pytest.mark.parametrize("least", [20, 10**9])  # with hot names, and without
def test_repeats_within_a_passage_make_few_stretches(spark, monkeypatch, least):
    monkeypatch.setattr(substrings, "SAMPLE", 1)
    monkeypatch.setattr(substrings, "HOT_LEAST", least)
    monkeypatch.setattr(substrings, "HOT", 10**9)
    rows = [(i, " ".join(f"a{i}.{k}" for k in range(i % 7)) + " one two" * 300 + f" b{i} " + PASSAGE + f" c{i}") for i in range(40)]
    tables = kept(monkeypatch, substrings)
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    left = {i: " ".join([*(f"a{i}.{k}" for k in range(i % 7)), f"b{i}", f"c{i}"]) for i in range(1, 40)}
    assert got == {0: (0, None)} | {i: (680, t) for i, t in left.items()}
    words = 680 * 39
    stretches, _ = tables["repeats-stretches"]
    assert stretches.count() < words // 20 and stretches.agg(F.sum("size")).first()[0] <= 2.1 * words


def test_needed_stretches_cover_what_all_cover():
    rng = np.random.default_rng(5)
    for _ in range(200):
        at = [np.flatnonzero(rng.random(60) < rng.choice([0.05, 0.3, 0.9])) for _ in range(3)]
        place = [np.where(rng.random(len(a)) < 0.7, a, rng.integers(0, 9, len(a))) for a in at]
        ids = np.repeat([7, 3, 5], [len(a) for a in at])
        out = substrings._as_stretches(ids, np.concatenate(at).astype(np.int64), np.zeros(len(ids), np.int64), np.concatenate(place), 5).to_pylist()
        windows = {(i, a, p) for i, a_, p_ in zip((7, 3, 5), at, place, strict=True) for a, p in zip(a_.tolist(), p_.tolist(), strict=True)}
        told = [(r["id"], r["at"] + k) for r in out for k in range(r["size"])]
        assert set(told) == {(i, a + k) for i, a, _ in windows for k in range(5)} and max((told.count(t) for t in set(told)), default=0) <= 2
        assert all((r["id"], r["at"] + k, r["source_at"] + k) in windows for r in out for k in range(r["size"] - 4))


def test_prefixes_are_compared_without_shingles_of_one_group(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"new{i}.{k // 5}" if k in (20 * (i % 9) + 3, 20 * (i % 9) + 9) else w for k, w in enumerate(base))) for i in range(12)]
    tables = kept(monkeypatch, jaccard)
    got = {r.doc_id: r.component_id for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = {k: min(label[a], label[b]) if v in (label[a], label[b]) else v for k, v in label.items()}
    assert got == label and len(set(label.values())) < 12
    own = tables["jaccard-prefixes"][0].select(F.explode("prefix")).count()
    compared, _ = tables["jaccard-compared"]
    assert 0 < compared.select(F.explode("prefix")).count() <= tables["jaccard-lists"][0].count() < own
