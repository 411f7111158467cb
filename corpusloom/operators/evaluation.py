"""Evaluation suites: cases with expectations against answers, and the totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers

COUNTS = ("raw_hit_count", "accepted_hit_count")
_RETRIEVAL = "struct<" + ",".join(f"{p}{c}:int" for c in COUNTS for p in ("", "min_", "max_")) + ",similarity_threshold:double,selected_source_path:string,diagnostics_contains:array<string>>"
_CASE = f"id string, question string, description string, tags array<string>, skip boolean, expected_answerable boolean, expected_route string, expected_fragments array<string>, expected_any_fragments array<string>, forbidden_fragments array<string>, min_answer_chars int, max_latency_seconds double, require_valid_markdown boolean, require_sources boolean, expected_retrieval {_RETRIEVAL}"
#: Fields of a case that a suite has defaults for.
DEFAULTS = ("selected_document", "document_behavior", "session_mode")


def read_suites(spark: SparkSession, folder: str) -> DataFrame:
    """(path, json) of each suite of a folder, by path."""
    from corpusloom.operators.diagnostics import read_json_files

    return read_json_files(spark, folder).select("path", "json").orderBy("path")


def parse_suites(suites: DataFrame) -> DataFrame:
    """``suites``: json. A row per case: suite, version, place, the case's fields, its defaults merged in (what a case names, null too, holds over
    them), groups of alternatives (a string is a group of one), and ``invalid``, why a case cannot run."""
    get = lambda p: F.get_json_object("json", f"$.{p}")
    isolate = F.coalesce(get("defaults.isolate_cases"), get("isolate_cases"), F.lit("true")) == "true"
    head = suites.select(
        get("name").alias("suite"), F.coalesce(get("version"), F.lit("1")).alias("version"), isolate.alias("isolate_cases"), *[get(f"defaults.{d}").alias(f"default_{d}") for d in DEFAULTS],
        F.posexplode(F.from_json(get("cases"), "array<string>")).alias("place", "case"),
    )
    known = F.coalesce(F.json_object_keys("case"), F.array().cast("array<string>"))
    merged = {d: F.when(F.array_contains(known, d), F.get_json_object("case", f"$.{d}")).otherwise(F.col(f"default_{d}")) for d in DEFAULTS}
    isolated = F.when(F.col("isolate_cases"), "isolated").otherwise("shared")
    merged["session_mode"] = F.lower(F.trim(F.when(F.array_contains(known, "session_mode"), F.get_json_object("case", "$.session_mode")).otherwise(F.coalesce("default_session_mode", isolated))))
    c = head.withColumn("c", F.from_json("case", _CASE)).withColumns(merged)
    groups = F.transform(F.coalesce("c.expected_any_fragments", F.array().cast("array<string>")), lambda g: F.coalesce(F.when(g.startswith("["), F.from_json(g, "array<string>")), F.array(g)))
    none = F.array().cast("array<string>")
    kept = {"tags": none, "expected_fragments": none, "forbidden_fragments": none, "skip": F.lit(False), "require_valid_markdown": F.lit(True), "require_sources": F.lit(True)}
    wrong = F.when(F.col("c.id").isNull() | F.col("c.question").isNull(), "a case needs an id and a question").when(~F.col("session_mode").isin("isolated", "shared"), F.concat(F.lit("invalid session_mode: "), "session_mode"))
    return c.select(
        "suite", "version", "place", F.col("c.id").alias("case_id"), "c.question", *DEFAULTS, *[F.coalesce(f"c.{n}", d).alias(n) for n, d in kept.items()], groups.alias("expected_any_fragments"),
        *[F.col(f"c.{n}") for n in ("expected_answerable", "expected_route", "min_answer_chars", "max_latency_seconds", "expected_retrieval")], wrong.alias("invalid"),
    )


def selected(cases: DataFrame, ids: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """Cases of the given ids (none: all) that have one of the given tags (none: any)."""
    cases = cases.filter(F.col("case_id").isin(ids)) if ids else cases
    return cases.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else cases


def until_first_failure(results: DataFrame) -> DataFrame:
    """``results``: suite, place, skip, failures. Each suite's cases up to and including the first that failed."""
    w = Window.partitionBy("suite").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    failed = (~F.col("skip") & (F.size("failures") > 0)).cast("int")
    return results.withColumn("before", F.coalesce(F.sum(failed).over(w), F.lit(0))).filter("before = 0").drop("before")


def _holds(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b))


def count_issue(name: str, actual: Column, exact: Column, least: Column, most: Column) -> Column:
    """array<string>: how a count (a string or number, as it was reported) misses what is expected; an exact number leaves the bounds unread."""
    n = actual.cast("string").try_cast("int")
    said = F.coalesce(actual.cast("string"), F.lit("None"))
    bounds = F.array_compact(F.array(F.when(n < least, F.concat(F.lit(f"expected {name}>="), least, F.lit(", got "), n)), F.when(n > most, F.concat(F.lit(f"expected {name}<="), most, F.lit(", got "), n))))
    none = F.array().cast("array<string>")
    absent = F.when(least.isNotNull() | most.isNotNull(), F.array(F.lit(f"missing retrieval count for {name}"))).otherwise(none)
    wrong = F.when(n.eqNullSafe(exact), none).otherwise(F.array(F.concat(F.lit(f"expected {name}="), exact, F.lit(", got "), said)))
    return F.when(exact.isNotNull(), wrong).when(n.isNull(), absent).otherwise(bounds)


def retrieval_issues(summary: Column, expected: Column) -> Column:
    """array<string>: how a retrieval summary (JSON; null: none was made, and nothing is asked of it) misses the expectations."""
    none = F.array().cast("array<string>")
    get = lambda k: F.get_json_object(summary, f"$.{k}")
    counts = [count_issue(c, get(c), expected[c], expected[f"min_{c}"], expected[f"max_{c}"]) for c in COUNTS]
    t, path = get("similarity_threshold"), expected["selected_source_path"]
    off = F.when(F.abs(t.try_cast("double") - expected["similarity_threshold"]) > 1e-6, F.concat(F.lit("expected similarity_threshold="), expected["similarity_threshold"], F.lit(", got "), t))
    lost = F.when((F.coalesce(path, F.lit("")) != "") & ~F.contains(summary, path), F.concat(F.lit("expected selected source path in retrieval summary: "), path))
    absent = F.transform(F.filter(F.coalesce(expected["diagnostics_contains"], none), lambda f: ~F.contains(summary, f)), lambda f: F.concat(F.lit("expected retrieval diagnostics to contain: "), f))
    return F.when(summary.isNull(), none).otherwise(F.concat(*counts, F.array_compact(F.array(off, lost)), absent))


def failures(cases: DataFrame) -> DataFrame:
    """``cases``: answer, answerable, route, latency_seconds, the expectations (null: none), and retrieval_summary with expected_retrieval if
    searches are checked. Adds ``failures``, an array of
    strings. A missing answerable or route passes; latency and length compare strictly."""
    a = F.coalesce("answer", F.lit(""))
    size = F.length(T.strip(a))
    wrong = F.array(
        F.when(F.col("expected_answerable") != F.col("answerable"), F.concat(F.lit("expected answerable="), F.col("expected_answerable"), F.lit(", got "), F.col("answerable"))),
        F.when(F.col("expected_route") != F.col("route"), F.concat(F.lit("expected route="), F.col("expected_route"), F.lit(", got "), F.col("route"))),
        F.when(size < F.col("min_answer_chars"), F.concat(F.lit("answer too short: "), size, F.lit(" < "), F.col("min_answer_chars"), F.lit(" chars"))),
        F.when(F.col("latency_seconds") > F.col("max_latency_seconds"), F.lit("latency too high")),
        F.when(F.col("require_sources") & ~a.rlike(r"\[S\d+"), F.lit("answer does not contain a valid [S#] citation")),
        F.when(F.col("require_valid_markdown") & (answers.markdown_issue(a) != "ok"), F.concat(F.lit("invalid or incomplete markdown: "), answers.markdown_issue(a))),
    )
    none = F.array().cast("array<string>")
    missing = F.transform(F.filter(F.coalesce("expected_fragments", none), lambda f: ~_holds(a, f)), lambda f: F.concat(F.lit("missing expected fragment: "), f))
    forbidden = F.transform(F.filter(F.coalesce("forbidden_fragments", none), lambda f: _holds(a, f)), lambda f: F.concat(F.lit("forbidden fragment present: "), f))
    groups = F.filter(F.coalesce("expected_any_fragments", F.array().cast("array<array<string>>")), lambda g: (F.size(g) > 0) & ~F.exists(g, lambda f: _holds(a, f)))
    searched = retrieval_issues(F.col("retrieval_summary"), F.col("expected_retrieval")) if {"retrieval_summary", "expected_retrieval"} <= set(cases.columns) else F.array().cast("array<string>")
    return cases.withColumn("failures", F.concat(F.array_compact(wrong), missing, F.transform(groups, lambda g: F.concat(F.lit("missing one of expected alternatives: "), F.array_join(g, " | "))), forbidden, searched))


def totals(results: DataFrame) -> DataFrame:
    """One row; skipped cases neither pass nor count in the rate."""
    ran = ~F.col("skip")
    passed = F.count_if(ran & (F.size("failures") == 0))
    skipped = F.count_if(F.col("skip"))
    return results.agg(F.count("*").alias("total"), passed.alias("passed"), F.count_if(ran & (F.size("failures") > 0)).alias("failed"), skipped.alias("skipped"), (passed / F.greatest(F.lit(1), F.count("*") - skipped)).alias("pass_rate"))
