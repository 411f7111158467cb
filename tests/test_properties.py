"""Properties of the small functions that run inside tasks."""

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import chunking
from corpusloom.sources import files

WORDS = st.lists(st.sampled_from(["# Head", "## Sub", "word", "| a | b |", "| --- | --- |", "| 1 | 2 |", "```", "code();", "", "- item", "漢字", "x" * 300]), max_size=60)


@settings(max_examples=60, deadline=None)
@given(WORDS)
def test_chunks_keep_their_size_and_ids(lines):
    text = "\n".join(lines)
    config = chunking.Config(max_chars=800)
    got = chunking.chunk_unit("u", text, config)
    assert got == chunking.chunk_unit("u", text, config)
    assert len({c["chunk_id"] for c in got}) == len(got) and [c["chunk_index"] for c in got] == list(range(len(got)))
    assert all(c["character_count"] == len(c["text"]) and c["oversized"] == (len(c["text"]) > 800) and c["text"] == c["text"].strip() for c in got)
    assert chunking.normalise(chunking.normalise(text)) == chunking.normalise(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab|\n,é", max_size=5), max_size=4), max_size=130))
def test_tables_pad_their_rows(rows):
    units = files.table_units(["k", "v"], rows, "t")
    assert sum(u["row_end"] - u["row_start"] + 1 for u in units) == len(rows)
    for u in units:
        lines = u["text"].split("\n")[2:]
        assert len(lines) == 2 + u["row_end"] - u["row_start"] + 1
        assert len({line.replace("\\|", "").count("|") for line in lines}) == 1


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_texts_are_decoded(x):
    assert files.decode(x.encode("utf-8", "ignore"))[0] in (x, x.removeprefix("﻿")) or any(0xD800 <= ord(c) < 0xE000 for c in x)
