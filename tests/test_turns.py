"""Turns of many sessions, model calls and suites, with stub models, beside a plain run of one turn after another."""

import json
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import payload as P
from corpusloom.operators import evaluation, model_calls, turns

NOW = "2024-05-06 07:08:09"


def stub(path):
    def reply_of(prompt, schema):
        if "standalone_query" in schema:
            last = prompt.split("Latest user message:\n")[1].split("\n\n")[0]
            said = prompt.split("Recent conversation:\n")[1].split("\n\nLatest user message")[0]
            return {"is_followup": True, "standalone_query": f"{last} after {said.count('USER: ')} turns", "confidence": 0.5, "reason": "stub"}
        question = prompt.split("User question:\n")[1].split("\n\n")[0]
        return {"answer": f"All that is known about {question} is written there [S1].", "answerable": True, "cited_source_ids": ["S1"], "limitations": []}

    def make():
        class Model:
            def chat_json(self, prompt, schema):
                with open(path, "a") as f:
                    f.write(json.dumps(prompt) + "\n")
                return reply_of(prompt, schema)

        return Model()

    return make


@pytest.fixture
def store(spark, tmp_path):
    def run(df):
        path = str(tmp_path / uuid.uuid4().hex)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return run


def search(asked):
    """One source for each query, but for those about nothing."""
    block = F.concat(F.lit("[S1]\ncontent:\n"), F.col("query"))
    return asked.filter(~F.contains("query", F.lit("nothing"))).select("query_id", F.lit(1).alias("rank"), F.lit("S1").alias("source_id"), F.lit(7).alias("point_id"), F.lit(0.9).alias("score"), block.alias("block"))


TURNS = [("a", 1, "hello there"), ("a", 2, "and it?"), ("a", 5, "about nothing"), ("b", 1, "hello there"), ("b", 2, " which projects use kafka? "), ("b", 3, "and it?"), ("c", 1, "  "), ("c", 2, "x" * 120), ("c", 3, "y" * 120), ("d", 9, "about nothing")]


def plain():
    out = {}
    for session in "abcd":
        log = []
        for _, _, message in sorted(t for t in TURNS if t[0] == session and t[2].strip()):
            message = message.strip()
            broad = message.startswith("which projects")
            if not log or broad or len(message) > 100:
                standalone = message
            else:
                standalone = f"{message} after {sum(r == 'user' for r, _ in log[-8:])} turns"
            found = "nothing" not in standalone
            answer = f"All that is known about {standalone} is written there [S1]." if found else None
            log += [("user", message), ("assistant", answer)]
        out[session] = log
    return out


def test_turns(spark, tmp_path, store):
    asked = tmp_path / "asked"
    table = spark.createDataFrame(TURNS, "session_id string, turn int, message string").repartition(3)
    log, sources = turns.answer_turns(table, stub(str(asked)), search, store, now=F.lit(NOW).cast("timestamp"))
    rows = log.orderBy("session_id", "message_id").collect()
    want = plain()
    fallback = spark.range(1).select(P.fallback_answer(F.lit("en"), F.lit(turns.NO_EVIDENCE))).first()[0]
    for session in "abcd":
        own = [r for r in rows if r.session_id == session]
        assert [r.message_id for r in own] == list(range(len(own)))
        assert [(r.role, r.content) for r in own] == [(role, fallback if text is None else text) for role, text in want[session]]
    assert all(r.answerable == (r.content != fallback) for r in rows if r.role == "assistant")
    assert {(r.query_id, r.cited) for r in sources.collect()} == {(r.query_id, True) for r in rows if r.role == "assistant" and r.answerable}
    counts = Counter(json.loads(x) for x in asked.read_text().splitlines())
    assert max(counts.values()) == 1  # "hello there" of two sessions is one call


def test_no_turns(spark, store, tmp_path):
    log, sources = turns.answer_turns(spark.createDataFrame([], "session_id string, turn int, message string"), stub(str(tmp_path / "x")), search, store)
    assert log.collect() == [] and sources.collect() == []


def test_prompts(spark):
    now = F.lit(NOW).cast("timestamp")
    got = spark.range(1).select(turns.followup_prompt(now, F.lit(None), F.lit("USER: a"), F.lit("b")).alias("f"), turns.grounded_prompt(now, F.lit("en"), F.lit("q?"), F.lit("[S1]")).alias("g")).first()
    assert got.f.startswith("Runtime context:\n- Current local date: 2024-05-06") and got.f.endswith("Stored session summary:\n(none)\n\nRecent conversation:\nUSER: a\n\nLatest user message:\nb\n\nDetermine whether the latest user message is context-dependent.\nReturn a standalone retrieval query.")
    assert got.g.endswith("User-language hint:\nen\n\nUser question:\nq?\n\nInternal knowledge-base sources:\n[S1]\n\nReturn a grounded answer.")


def test_source_references(spark):
    packed = spark.createDataFrame([(1, 1, "S1", 5, 0.5, "text", False), (1, 2, "S2", 6, 0.4, "more", True)], "query_id long, rank int, source_id string, point_id long, score double, block_text string, truncated boolean")
    points = spark.createDataFrame([(5, "a/b.md", "a", "3", ["H", "I"]), (6, "c.csv", None, "x", None)], "point_id long, source_path string, category string, page_number string, heading_path array<string>")
    got = turns.source_references(packed, points).orderBy("rank").collect()
    assert got[0].block == "[S1]\nsource_path: a/b.md\ncategory: a\nlocation: page 3; H > I\ncontent:\ntext" and got[0].heading_path == ["H", "I"]
    assert got[1].block == "[S2]\nsource_path: c.csv\ncategory: None\nlocation: document\ncontent:\nmore" and got[1].page_number is None
    row = turns.contexts(turns.source_references(packed, points)).first()
    assert row.allowed == ["S1", "S2"] and row.context.split(turns.BETWEEN) == [got[0].block, got[1].block]


def test_calls_are_retried_checked_and_given_up(spark, tmp_path, store):
    def make():
        import time

        class Model:
            seen = {}  # noqa: RUF012

            def chat_json(self, prompt, schema):
                self.seen[prompt] = self.seen.get(prompt, 0) + 1
                if prompt == "slow":
                    time.sleep(30)
                if prompt == "twice" and self.seen[prompt] < 3 or prompt == "never":
                    raise RuntimeError("busy")
                return {"n": True} if prompt == "wrong" else [] if prompt == "list" else {"n": 1.5, "s": None}

        return Model()

    prompts = spark.createDataFrame([(k, p) for k, p in enumerate(["good", "good", "twice", "never", "wrong", "list", "slow", None])], "id int, prompt string").coalesce(1)
    began = time.monotonic()
    got = {r.id: r for r in model_calls.call_model(prompts, make, {"n": "number", "s": "string"}, store, optional=("s",), attempts=3, pause=0.01, deadline=3.0).collect()}
    assert time.monotonic() - began < 25
    assert json.loads(got[0].reply) == json.loads(got[1].reply) == {"n": 1.5, "s": None} and got[2].attempts == 3 and got[2].error is None
    assert [got[k].error for k in (3, 4, 5, 6, 7)] == ["RuntimeError: busy", "n is no number", "the reply is no object", "no reply within 3 seconds", None]


def test_suites_over_a_model(spark, tmp_path, store):
    cases = [{"id": "one", "question": "hello there", "expected_fragments": ["hello"], "tags": []}, {"id": "two", "question": "and it?", "expected_fragments": ["after 1 turns"]}, {"id": "three", "question": "about nothing", "expected_answerable": False, "require_sources": False}, {"id": "four", "question": "x", "skip": True}, {"question": "no id"}]
    suites = [{"name": "s", "defaults": {"session_mode": "shared"}, "cases": cases}, {"name": "t", "cases": cases}]
    parsed = evaluation.parse_suites(spark.createDataFrame([(json.dumps(s),) for s in suites], "json string"))
    results, total = turns.run_suites(parsed, stub(str(tmp_path / "asked")), search, store)
    got = {(r.suite, r.case_id): r.failures for r in results.collect()}
    # in a session of its own the second question is no follow-up
    assert got == {
        ("s", "one"): [], ("s", "two"): [], ("s", "three"): [], ("s", "four"): [], ("s", None): ["a case needs an id and a question"],
        ("t", "one"): [], ("t", "two"): ["missing expected fragment: after 1 turns"], ("t", "three"): [], ("t", "four"): [], ("t", None): ["a case needs an id and a question"],
    }
    row = total.first()
    assert (row.total, row.passed, row.failed, row.skipped) == (10, 5, 3, 2)
    first, _ = turns.run_suites(parsed, stub(str(tmp_path / "again")), search, store, fail_fast=True)
    assert sorted((r.suite, r.place) for r in first.collect()) == [("s", k) for k in range(5)] + [("t", 0), ("t", 1)]
