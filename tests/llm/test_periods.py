"""Periodic runs against a plain version, on drawn and made-up texts."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from corpusloom.llm import op_queries, periods
from corpusloom.llm.words import Lexicon, numbered


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        s = 0
        for i in range(len(words) - q + 1):
            if i == len(words) - q or words[i] != words[i + q]:
                if i - s + q >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(s, i + q - d)) for d in range(1, q)):
                    out.append((s, i - s + q, q))
                s = i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha256(lines.encode()).hexdigest(), sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def found(texts):
    words, names, begins = numbered([t.encode().split() for t in texts], Lexicon())
    return periods.find_runs(words, names[0], begins)


def drawn(r):
    """Texts with runs of many periods, inside each other and side by side."""
    vocab = [f"w{k}" for k in range(r.choice([2, 3, 5, 50]))]
    out = []
    while len(out) < r.randrange(1, 400):
        kind = r.random()
        if kind < 0.4:
            out += [r.choice(vocab) for _ in range(r.randrange(1, 30))]
        else:
            root = [r.choice(vocab) for _ in range(r.randrange(1, 40))]
            if kind > 0.8:
                root = root[: r.randrange(1, 6)] * r.randrange(1, 8) + root  # periodic inside
            out += (root * r.randrange(1, 9))[: r.randrange(1, len(root) * 9)]
    return " ".join(out)


def test_drawn_texts():
    r = random.Random(1)
    for _ in range(25):
        texts = [drawn(r) for _ in range(8)]
        assert found(texts) == [plain_runs(t.split()) for t in texts]


def test_regular_texts():
    a, b = "a", "b"
    words = ["a", "ab"]
    while len(words[-1]) < 600:
        words.append(words[-1] + words[-2])  # Fibonacci
    morse = "".join(a if bin(k).count("1") % 2 else b for k in range(512))
    texts = [" ".join(x) for x in (words[-1], morse, a * 300, (a * 7 + b) * 40, "abc" * 100 + "abd" * 100, ((a * 20 + b) * 8 + "c") * 6, "")]
    assert found(texts) == [plain_runs(t.split()) for t in texts]


def test_long_texts():
    n = 300_000
    root = [f"w{k}" for k in range(n // 5)]
    assert found([" ".join(root * 5), " ".join(["x"] * n), " ".join((["x"] * 999 + ["y"]) * 300)]) == [[(0, n, n // 5)], [(0, n, 1)], sorted([(0, n, 1000)] + [(k * 1000, 999, 1) for k in range(300)], key=lambda r: (r[0], r[2]))]


@pytest.mark.parametrize("parts", [1, 4])
def test_query(spark, tmp_path, parts):
    r = random.Random(4)
    docs = [(k, drawn(r)) for k in range(80)] + [(80, None), (81, ""), (82, " \n "), (83, "a a a a a a"), (83, "a a a a a"), (84, "a\ta\na  a\x0ba\x0ca"), (None, "b " * 9), (85, "é é é é " * 8), (12, "x"), (86, "漢 " * 5 + "字")]
    spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, runs string, n_words int").repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = op_queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain(i, t) for i, t in docs), key=str)
    assert np.sum([zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs if i is not None]) > 3


def test_tables_without_rows(spark):
    assert periods.digest(periods.detect_runs(spark.createDataFrame([], "doc_id string, text string"))).collect() == []
