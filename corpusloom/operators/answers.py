"""Checks of answers: quality, completeness, Markdown, citations, evaluation cases, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import patterns, rules
from corpusloom.functions import text as T

_WORDCHAR = r"[\p{L}\p{N}_.:/-]"
CONJUNCTION = rf"(?i)\b(?:and|or|including|such as)\s+`?{_WORDCHAR}*:?\s*$"
FIELD = r"`?[\p{L}\p{N}_.-]+:\s*$"


def _odd(x: Column, mark: str) -> Column:
    return T.count_of(x, mark) % 2 != 0


def quality_issue(answer: Column, question: Column) -> Column:
    """The first rule that fails, or ok."""
    a, q, low = T.strip(F.coalesce(answer, F.lit(""))), F.lower(question), F.lower(T.strip(F.coalesce(answer, F.lit(""))))
    both = lambda x: F.contains(x, F.lit("live")) & F.contains(x, F.lit("replay"))
    asked = F.coalesce(F.contains(q, F.lit("respectively")), F.lit(False))
    return (
        F.when(a == "", "empty answer").when(F.length(a) < 20, "suspiciously short answer").when(_odd(a, "**"), "unmatched bold markdown marker").when(_odd(a, "`"), "unmatched inline-code marker").when(_odd(a, "```"), "unclosed code fence")
        .when(a.rlike(rules.DANGLING), "answer ends with dangling punctuation").when(asked & both(q) & ~both(low), "multi-part live/replay answer appears incomplete").when(asked & (F.size(F.split(a, r"(?U)\s+")) < 12), "multi-part answer too short")
        .when(a.rlike(CONJUNCTION), "answer appears truncated after conjunction or field name").when(a.rlike(FIELD), "answer ends with unfinished technical field").otherwise("ok")
    )


def looks_incomplete(answer: Column) -> Column:
    a = T.strip(answer)
    a = T.strip(F.regexp_replace(a, r"(?is)\n\n(?:Sources|แหล่งข้อมูล):.*$", ""))
    a = T.strip(F.regexp_replace(a, r"(?i)\s*\[S\d+(?:\s*,\s*S\d+)*\]\s*$", ""))
    last = F.try_element_at(F.regexp_extract_all(F.lower(a), F.lit("[a-z]+"), F.lit(0)), F.lit(-1))
    return (F.length(a) < 24) | a.rlike("[:;,\\-—(]$") | F.coalesce(last.isin(*rules.TRAILING_WORDS), F.lit(False))


def markdown_issue(answer: Column) -> Column:
    a = T.strip(answer)
    bare = F.regexp_replace(a, "(?s)```.*?```", "")
    return (
        F.when(_odd(a, "```"), "unclosed code fence").when(_odd(bare, "`"), "unmatched inline-code marker").when(_odd(bare, "**"), "unmatched bold marker").when(a.rlike("[:,;\\-—(]$"), "answer ends with dangling punctuation")
        .when(a.rlike(CONJUNCTION), "answer appears truncated after conjunction or field name").when(a.rlike(FIELD), "answer ends with unfinished technical field").otherwise("ok")
    )


def cited_ids(answer: Column) -> Column:
    """S numbers inside [S1, S2] groups, each once, in order."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(S\d+(?:\s*,\s*S\d+)*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"S\d+"), F.lit(0)))))


def keep_citations(answer: Column, allowed: Column) -> Column:
    """Citation groups keep only allowed ids and go if none is left: split at the groups and joined again."""
    pattern = r"\[(S\d+(?:\s*,\s*S\d+)*)\]"
    groups = F.regexp_extract_all(answer, F.lit(pattern), F.lit(1))

    def kept(g):
        ids = F.filter(F.regexp_extract_all(g, F.lit(r"S\d+"), F.lit(0)), lambda x: F.array_contains(allowed, x))
        return F.when(F.size(ids) > 0, F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]"))).otherwise("")

    pieces = F.zip_with(F.split(answer, pattern, -1), F.transform(groups, kept), lambda t, g: F.concat(t, F.coalesce(g, F.lit(""))))
    return T.strip(F.array_join(pieces, ""))


def route(message: Column, has_history: Column, scope: Column) -> Column:
    """struct(route, confidence) by the ordered rules; route is null where a model must decide."""
    out = None
    for name, confidence, pattern in rules.ROUTES:
        found = message.rlike(patterns.java(pattern, True))
        answer = F.struct(F.lit(name).alias("route"), F.lit(confidence).alias("confidence"))
        if name == "follow_up":
            found = found & has_history
        out = F.when(found, answer) if out is None else out.when(found, answer)
        if name == "unsupported":
            out = out.when(scope == "strict_selected", F.struct(F.lit("document_qa").alias("route"), F.lit(1.0).alias("confidence")))
    out = out.when(scope == "prefer_selected", F.struct(F.lit("document_qa").alias("route"), F.lit(0.86).alias("confidence")))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("route"), F.lit(None).cast("double").alias("confidence")))


def default_categories(route_: Column) -> Column:
    """The categories that a route searches; null: all."""
    out = F.lit(None).cast("array<string>")
    for name, categories in rules.ROUTE_CATEGORIES.items():
        out = F.when(route_ == name, F.array(*map(F.lit, categories))).otherwise(out)
    return out


def thinking(message: Column, route_: Column) -> Column:
    return F.coalesce(route_.isin(*rules.THINKING_ROUTES), F.lit(False)) & ((F.length(message) >= 180) | message.rlike(patterns.java(rules.COMPLEX, True)))


def followup(message: Column, has_history: Column) -> Column:
    """standalone, broad, independent, or null where a model must decide."""
    hint = message.rlike(patterns.java(rules.CONTEXT_HINT, True))
    return F.when(~has_history, "standalone").when(message.rlike(patterns.java(rules.BROAD, True)) & ~message.rlike(patterns.java(rules.PRONOUN, True)), "broad").when((F.length(message) > 100) & ~hint, "independent")
