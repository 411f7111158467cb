"""Properties of what runs inside tasks, over drawn inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import substrings, toxicity, words

TEXTS = st.lists(st.sampled_from([b"a", b"b", b"aa", b"c" * 20, "é".encode()]), max_size=40)


@settings(max_examples=150, deadline=None)
@given(TEXTS, TEXTS)
def test_overlap_is_that_of_the_sets(x, y):
    def plain(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    a, b = words.shingles([x, y], words.Lexicon())
    assert (len(a), len(b), words.overlap(a, b)) == (len(plain(x)), len(plain(y)), len(plain(x) & plain(y)))
    assert (a.name() == b.name()) == (plain(x) == plain(y))


@settings(max_examples=150, deadline=None)
@given(TEXTS, TEXTS, st.integers(3, 12))
def test_windows_are_named_alike_where_they_are_alike(x, y, window):
    """Names by symbols agree exactly where the words do, within a text and across texts parsed together."""
    _, names, begins = words.numbered([x, y], words.Lexicon())
    p = substrings.recompress(names, begins)
    symbols = np.searchsorted(p.doc, np.arange(3))
    named = {}
    for k, own in enumerate((x, y)):
        starts = int(begins[k]) + np.arange(max(0, len(own) - window + 1))
        i, j = substrings.interior(p, int(symbols[k]), int(symbols[k + 1]), starts, window)
        for s, name in zip(range(len(starts)), substrings.named_by_symbols(starts, i, j, names, p, window).T.tolist(), strict=True):
            named.setdefault(tuple(own[s : s + window]), set()).add(tuple(name))
    assert all(len(v) == 1 for v in named.values())
    assert len({v for n in named.values() for v in n}) == len(named)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=30))
def test_segments_are_apart_and_positive(xs):
    found = toxicity.segments([(i, i + 1, float(x)) for i, x in enumerate(xs)])
    assert all(a < b and s == sum(xs[a:b]) > 0 for a, b, s in found)
    assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:], strict=False))
    best = max((sum(xs[a:b]) for a in range(len(xs)) for b in range(a + 1, len(xs) + 1)), default=0)
    assert max((s for _, _, s in found), default=0) == max(best, 0)
