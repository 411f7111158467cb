"""What follows a route: the search's filter and limits, carry-over of a document, canned replies, and answers that are checked,
repaired once and replaced if they do not hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import payload as P
from corpusloom.functions import text as T
from corpusloom.operators import answers
from corpusloom.operators.model_calls import ChatModel, call_model

# Routes that search, and those that carry a document on.
RAG_ROUTES = ("document_qa", "company_info", "admin_support", "developer_support", "technical_troubleshooting", "kafka_iot_support", "follow_up")
SCOPED_ROUTES = ("document_qa", "follow_up")


def node(route: Column) -> Column:
    """The step that a route leads to: rag for routes that search, general without a route, else the route's own reply."""
    return F.when(route.isin(*RAG_ROUTES), "rag").otherwise(F.coalesce(route, F.lit("general_chat")))


def carries_scope(turns: DataFrame) -> DataFrame:
    """``turns``: session_id, message_id, role, route, scope. Each with ``carries``: whether the last assistant turn before it
    was about a document and had the same scope."""
    w = Window.partitionBy("session_id").orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "assistant", F.struct("route", "scope")), ignorenulls=True).over(w)
    return turns.withColumn("last", last).withColumn("carries", F.coalesce(F.col("last.route").isin(*SCOPED_ROUTES) & F.col("last.scope").eqNullSafe(F.col("scope")), F.lit(False))).drop("last")


def scope_used(route: Column, scope: Column, behavior: Column, carries: Column) -> Column:
    """Whether the search is held to the selected document."""
    some = F.coalesce(scope, F.lit("")) != ""
    return some & F.coalesce((route == "document_qa") | ((route == "follow_up") & carries) | (behavior == "strict_selected"), F.lit(False))


def effective_filter(route: Column, scope: Column, used: Column, given: Column) -> Column:
    """map<string, array<string>>: the route's categories, then the document, then what the caller gives, the later ones first."""
    none = F.create_map().cast("map<string,array<string>>")
    categories = answers.default_categories(route)
    base = F.when(categories.isNotNull(), F.create_map(F.lit("category"), categories)).otherwise(none)
    path = F.when(used, F.create_map(F.lit("source_path"), F.array(scope))).otherwise(none)
    given = F.coalesce(given, none)
    path = F.map_filter(path, lambda k, v: ~F.map_contains_key(given, k))
    base = F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k) & ~F.map_contains_key(path, k))
    return F.map_concat(base, path, given)


def canned(route: Column, message: Column, session: Column, texts: dict[tuple[str, bool], list[str]]) -> Column:
    """The reply of a route that does not search, by the language of the message; of several, one that the session and
    message always get. ``texts``: (route, whether Thai) to variations. Null for other routes."""
    thai = P.is_thai(T.detect_language(message))
    out = F.lit(None).cast("string")
    for (name, in_thai), variations in texts.items():
        pick = F.element_at(F.array(*map(F.lit, variations)), (T.stable_variation(session, message, len(variations)) + 1).cast("int")) if len(variations) > 1 else F.lit(variations[0])
        out = F.when((route == name) & (thai == in_thai), pick).otherwise(out)
    return out


def quality_reason(answer: Column, question: Column) -> Column:
    """The first check that an answer fails, or null."""
    issue = answers.quality_issue(answer, question)
    return F.when(issue != "ok", issue).when(answers.looks_incomplete(answer), "visibly incomplete or truncated answer")


def valid_ids(cited: Column, answer: Column, allowed: Column) -> tuple[Column, Column]:
    """Ids that a payload cites or its answer names, each once: those that are allowed, and the others."""
    said = F.array_distinct(F.concat(F.coalesce(cited, F.array().cast("array<string>")), answers.cited_ids(answer)))
    return F.filter(said, lambda x: F.array_contains(allowed, x)), F.filter(said, lambda x: ~F.array_contains(allowed, x))


def repair_reasons(answer: Column, question: Column, answerable: Column, valid: Column) -> Column:
    """Why an answer is asked for once more; empty if it holds."""
    found = F.array_compact(F.array(quality_reason(answer, question), F.when(F.size(valid) == 0, "missing valid internal citation")))
    return F.when(answerable, found).otherwise(F.array().cast("array<string>"))


def settled(payloads: DataFrame) -> DataFrame:
    """``payloads``: question, language, answer, answerable, cited, allowed, limitations. The answer as it may be shown: of allowed
    citations only, replaced by a fallback where it has none or is malformed, with its sources. Adds cited_ids."""
    none = F.array().cast("array<string>")
    valid, invalid = valid_ids(F.col("cited"), F.col("answer"), F.col("allowed"))
    rows = payloads.withColumn("valid", valid).withColumn("invalid", invalid).withColumn("safe", answers.keep_citations(F.col("answer"), F.col("allowed")))
    uncited = F.col("answerable") & (F.size("valid") == 0)
    rows = rows.withColumn("uncited", uncited).withColumn("broken", F.when(F.col("answerable") & ~uncited, quality_reason(F.col("safe"), F.col("question"))))
    limits = F.concat(
        F.coalesce("limitations", none),
        F.when(F.size("invalid") > 0, F.array(F.concat(F.lit("Removed invalid source IDs returned by the model: "), F.array_join("invalid", ", ")))).otherwise(none),
        F.when(F.col("uncited"), F.array(F.lit("The model attempted to answer without a valid internal citation."))).otherwise(none),
        F.when(F.col("broken").isNotNull(), F.array(F.concat(F.lit("The generated answer appeared visibly incomplete or malformed: "), F.col("broken")))).otherwise(none),
    )
    shown = (
        F.when(F.col("uncited"), P.fallback_answer(F.col("language"), F.lit("The generated response did not contain a valid internal citation.")))
        .when(F.col("broken").isNotNull(), P.fallback_answer(F.col("language"), F.lit("The generated answer was incomplete or malformed after validation.")))
        .when(F.col("answerable"), P.with_sources(F.col("safe"), answers.cited_ids(F.col("safe")), F.col("valid"), F.col("language")))
        .otherwise(F.col("safe"))
    )
    kept = [c for c in payloads.columns if c not in ("answer", "answerable", "limitations")]
    return rows.select(*kept, shown.alias("answer"), (F.col("answerable") & ~F.col("uncited") & F.col("broken").isNull()).alias("answerable"), limits.alias("limitations"), F.col("valid").alias("cited_ids"))


#: What a model is asked to return.
ANSWER_SCHEMA = {"answer": "string", "answerable": "boolean", "cited_source_ids": "array", "limitations": "array"}


def ask(prompts: DataFrame, model: Callable[[], ChatModel], store: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
    """``prompts``: query_id, prompt. (query_id, answer, answerable, cited, limitations) by :func:`model_calls.call_model`, equal prompts once;
    where no reply fits, nulls and the error in ``limitations``."""
    told = call_model(prompts.select("query_id", "prompt"), model, ANSWER_SCHEMA, store, optional=("cited_source_ids", "limitations"), **how)
    r = told.withColumn("r", F.from_json("reply", "answer string, answerable boolean, cited_source_ids array<string>, limitations array<string>"))
    none = F.array().cast("array<string>")
    limits = F.when(F.col("reply").isNull(), F.array("error")).otherwise(F.coalesce("r.limitations", none))
    return r.select("query_id", "r.answer", "r.answerable", F.when(F.col("reply").isNotNull(), F.coalesce("r.cited_source_ids", none)).alias("cited"), limits.alias("limitations"))


def answer(questions: DataFrame, model: Callable[[], ChatModel], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``questions``: query_id, question, language, prompt, allowed. Asks, checks, asks once more with the reasons where a check
    fails, and settles what is shown. ``store`` writes a table and reads it back, so that no model is asked twice."""
    first = store(questions.join(ask(questions, model, store), "query_id"))
    safe = answers.keep_citations(F.col("answer"), F.col("allowed"))
    valid, _ = valid_ids(F.col("cited"), F.col("answer"), F.col("allowed"))
    first = first.withColumn("reasons", F.coalesce(repair_reasons(safe, F.col("question"), F.col("answerable"), valid), F.array().cast("array<string>")))
    again = first.filter(F.size("reasons") > 0)
    retry = again.select("query_id", F.concat("prompt", F.lit("\n\nThe previous structured answer failed validation:\n"), F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("- "), r)), "\n"), F.lit("\n\nPrevious answer:\n"), "answer").alias("prompt"))
    second = store(ask(retry, model, store)).select("query_id", *[F.col(c).alias(f"new_{c}") for c in ("answer", "answerable", "cited", "limitations")])
    both = first.join(second, "query_id", "left")
    new = F.col("new_answer").isNotNull()
    rows = both.select("query_id", "question", "language", "allowed", *[F.when(new, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("answer", "answerable", "cited", "limitations")])
    return settled(rows.withColumns({"answer": F.coalesce("answer", F.lit("")), "answerable": F.coalesce("answerable", F.lit(False))}))


def cited_sources(answered: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources of each answer's ids, in the order of the ids; ids without a source go. ``answered``: query_id, cited_ids;
    ``sources``: query_id, source_id, ..."""
    ids = answered.select("query_id", F.posexplode("cited_ids").alias("place", "source_id"))
    return ids.join(sources, ["query_id", "source_id"])
