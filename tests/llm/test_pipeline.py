"""The pipeline against a brute-force version of its five stages."""

import base64
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline

R = random.Random(11)
VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mé", "ru", "TI") for b in ("n", "s", "t", "ven", "x.")]


def text(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


CLEAN = [text(40) for _ in range(400)]
TOXIC = [text(20) + " scoundrel villain " + text(20) for _ in range(100)]
PASSAGE = text(30)
KEY = "AKIA" + "Q7" * 10
DOCS = list(enumerate(CLEAN + TOXIC))
DOCS += [(1000, CLEAN[0]), (1001, CLEAN[1] + " more"), (1002, f"{text(20)} {PASSAGE} {text(20)}"), (1003, f"{text(20)} {KEY} {text(9)}"), (1004, None), (1005, "")]
DOCS += [(1006, "same words again and again " * 8)] * 2  # a repeated row
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, id string"


def write(spark, folder, docs, benchmark, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "t", "i") for i, t in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def sha(x):
    return hashlib.sha256(x).hexdigest()


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute():
    docs = {i: t for i, t in DOCS if "scoundrel" not in (t or "")}
    sets = {i: shingles(t) for i, t in docs.items()}
    label = {i: i for i in docs}
    for a in docs:
        for b in docs:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    docs = {i: t for i, t in docs.items() if label[i] == i}

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def windows(t):
        w = cut(t)
        return {tuple(w[k : k + 10]) for k in range(len(w) - 9)}

    docs = {i: t for i, t in docs.items() if not windows(t) & windows(PASSAGE)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in docs.items():
        t = (t or "").replace(KEY, "[SECRET:access]")
        ids = own.encode_ordinary(t)
        out.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())))
    return sorted(out)


def test_pipeline(spark, tmp_path):
    folder = write(spark, str(tmp_path), DOCS, [(1, PASSAGE)], [(i, 1, int("scoundrel" in t)) for i, t in DOCS[:500]])
    got = sorted(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, folder).collect())
    want = brute()
    assert got == want
    gone = {i for i, _ in DOCS} - {x[0] for x in want}
    assert {*range(400, 500), 1000, 1001, 1002} <= gone and {1003, 1004, 1005, 1006}.isdisjoint(gone)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, tmp_path, stage):
    folder = write(spark, str(tmp_path), [], [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = stage(spark, docs, folder)
    assert kept.columns == list(corpus_pipeline.COLUMNS) and kept.count() == 0


MIXED = [(1, CLEAN[0]), (7, CLEAN[0]), (7, CLEAN[1]), (7, CLEAN[1]), (None, CLEAN[0]), (None, f"{text(20)} {PASSAGE} {text(20)}"), (8, f"{text(9)} {PASSAGE}"), (8, CLEAN[2]), (9, None), (9, None), (None, ""), (2**62, CLEAN[3]), (-(2**62), CLEAN[3] + " more")]


def kept(spark, tmp_path, stage):
    folder = write(spark, str(tmp_path), MIXED, [(1, PASSAGE)], [])
    return sorted(((r.doc_id, r.text) for r in stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()), key=str)


def test_near_duplicates_of_repeated_and_null_ids(spark, tmp_path):
    gone = [(7, CLEAN[0]), (7, CLEAN[1]), (2**62, CLEAN[3])]  # a copy, one of two equal rows, a near copy of a smaller id
    want = list(MIXED)
    for x in gone:
        want.remove(x)
    assert kept(spark, tmp_path, corpus_pipeline.drop_near_duplicates) == sorted(want, key=str)


def test_contamination_of_repeated_and_null_ids(spark, tmp_path):
    assert kept(spark, tmp_path, corpus_pipeline.drop_contaminated) == sorted((x for x in MIXED if PASSAGE not in (x[1] or "")), key=str)


def test_other_stages_keep_every_row(spark, tmp_path):
    folder = write(spark, str(tmp_path), MIXED, [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = sorted((x[0] for x in MIXED), key=str)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.redact_secrets, corpus_pipeline.tokenize):
        assert sorted((r.doc_id for r in stage(spark, docs, folder).collect()), key=str) == ids
