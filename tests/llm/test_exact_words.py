"""Words of special forms, and ids at the ends of their range, in the operators that compare words."""

import numpy as np

from corpusloom.llm import jaccard, substrings, words

A, B = "a", "b"
for _ in range(10):
    A, B = A + B, B + A  # a word of 1,024 letters and its complement: equal under any polynomial of an odd base modulo 2 ** 64


def test_names_of_words_and_sequences_differ():
    lexicon = words.Lexicon()
    assert words.shingles([[A.encode()]], lexicon)[0].name() != words.shingles([[B.encode()]], lexicon)[0].name()
    one, two = ([c.encode() for c in x] for x in (A, B))
    names = [words.numbered([x], lexicon)[1] for x in (one, two)]
    assert (words.window_names(names[0], 1024) != words.window_names(names[1], 1024)).any()


def test_names_without_numbers_are_equal_for_equal_words():
    rng = np.random.default_rng(3)
    own = [bytes(rng.choice([0, 1, 255], k).astype(np.uint8)) for k in rng.integers(1, 20, 4000)] + [A.encode(), B.encode(), A.encode(), b"a", b"a\0", b"a\0\0", b"b" * 15, b"b" * 16, b"b" * 17, b"b" * 255, b"b" * 256]
    names, begins = words.word_names([own[:7], [], own[7:], []])
    assert begins.tolist() == [0, 7, 7, len(own), len(own)]
    named = {}
    for w, name in zip(own, names.T.tolist(), strict=True):
        named.setdefault(w, set()).add(tuple(name))
    assert all(len(v) == 1 for v in named.values()) and len({n for v in named.values() for n in v}) == len(named)
    assert len({n[0] for v in named.values() for n in v}) == len(named)
    assert words.word_names([[]])[0].shape == (2, 0) and words.word_names([])[1].tolist() == [0]


def test_shingles_that_share_a_first_lane(monkeypatch):
    """Names cut to few bits: sizes and overlaps stay exact."""
    whole = words.window_names
    monkeypatch.setattr(words, "window_names", lambda names, size: whole(names, size) * [[words.np.uint64(0)], [words.np.uint64(1)]] + [[words.np.uint64(3)], [words.np.uint64(0)]])
    x, y = "a b c d e f a b c d e g".encode().split(), "b c d e f z z z z z".encode().split()
    lexicon = words.Lexicon()
    a, b = words.shingles([x, y], lexicon)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x, y)]
    assert (len(a), len(b), words.overlap(a, b)) == (*map(len, sets), len(sets[0] & sets[1]))


def test_texts_with_such_words_are_not_linked(spark):
    docs = spark.createDataFrame([(1, f"{A} b c d e"), (2, f"{B} b c d e"), (3, f"{B} b  c d e")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.link_documents(docs).drop("component").collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 2)]


def test_links_of_large_ids_beside_a_null_id(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(2**60 + 1, text), (2**60 + 301, text + " more"), (None, "some other text of five words")]
    got = {tuple(r) for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).drop("component").collect()}
    assert got == {(2**60 + 1, 96, 2**60 + 1), (2**60 + 301, 97, 2**60 + 1), (None, 2, None)}


def test_repeats_keep_such_words(spark):
    rest = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{A} {rest}"), (2, f"{B} {rest}"), (None, rest)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: (61, 0), 2: (61, 60), None: (60, 0)}
