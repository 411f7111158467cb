"""Turns of many sessions: from a message to an answer in the log.

Sessions are independent, the turns of one are not: round n answers the n-th message of every session that has one, and each round
sees the log of the rounds before it. A round is one plan over all sessions: what a message refers to, the search, the prompt, the answer, the
log; its tables are written, so the driver's loop is over rounds alone, as many as the longest session has messages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import payload as P
from corpusloom.functions import text as T
from corpusloom.operators import answers, conversations, scope
from corpusloom.operators.evaluation import failures, totals, until_first_failure
from corpusloom.operators.model_calls import ChatModel, call_model
from corpusloom.operators.numbering import number_rows

#: What stands between the blocks of a context.
BETWEEN = "\n\n" + "=" * 40 + "\n\n"
NO_EVIDENCE = "No retrieved source exceeded the configured similarity threshold."
FOLLOWUP_SCHEMA = {"is_followup": "boolean", "standalone_query": "string", "confidence": "number", "reason": "string"}


@dataclass(frozen=True)
class Wording:
    """What a deployment says to its model, besides the parts that a prompt is made of."""

    followup: str = "Determine whether the latest user message is context-dependent.\nReturn a standalone retrieval query."
    grounded: str = "Return a grounded answer."


def _parts(now: Column, *parts: tuple[str, Column], last: str) -> Column:
    rows = [P.runtime_context(now), *[F.concat(F.lit(f"{head}:\n"), body) for head, body in parts], F.lit(last)]
    return T.strip(F.concat_ws("\n\n", *rows))


def followup_prompt(now: Column, summary: Column, history: Column, message: Column, wording: Wording = Wording()) -> Column:  # noqa: B008
    """What a model is asked where rules can't tell whether a message refers to earlier ones."""
    summary = F.when(F.coalesce(summary, F.lit("")) == "", "(none)").otherwise(summary)
    return _parts(now, ("Stored session summary", summary), ("Recent conversation", history), ("Latest user message", message), last=wording.followup)


def grounded_prompt(now: Column, language: Column, question: Column, context: Column, wording: Wording = Wording()) -> Column:  # noqa: B008
    """What a model is asked for an answer from sources."""
    return _parts(now, ("User-language hint", language), ("User question", question), ("Internal knowledge-base sources", context), last=wording.grounded)


def source_references(packed: DataFrame, points: DataFrame) -> DataFrame:
    """A record for each source of a context. ``packed``: query_id, rank, source_id, point_id, score, block_text, truncated; ``points``: point_id and payload (source_path, category,
    page_number, sheet_name, row_start, row_end, heading_path; missing columns are null). Adds location and the block that a model is shown."""
    kinds = {"source_path": "string", "category": "string", "page_number": "long", "sheet_name": "string", "row_start": "long", "row_end": "long", "heading_path": "array<string>"}
    for name, kind in kinds.items():
        points = points.withColumn(name, F.col(name).try_cast(kind) if name in points.columns else F.lit(None).cast(kind))
    own = points.select("point_id", *kinds)
    rows = packed.join(own, "point_id").withColumns({"source_path": F.coalesce("source_path", F.lit("")), "heading_path": F.coalesce("heading_path", F.array().cast("array<string>"))})
    numbers = [F.col(c).cast("string") for c in ("page_number", "sheet_name", "row_start", "row_end")]
    rows = rows.withColumn("location", T.location_label(*numbers, F.col("heading_path")))
    return rows.withColumn("block", P.source_block(F.col("source_id"), F.col("source_path"), F.col("category"), F.col("location"), F.col("block_text")))


def contexts(references: DataFrame) -> DataFrame:
    """(query_id, context, allowed): the blocks of each query by rank, and the ids of its sources."""
    rows = references.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", "block"))).alias("rows"))  # of one query's context budget
    return rows.select("query_id", F.array_join("rows.block", BETWEEN).alias("context"), F.col("rows.source_id").alias("allowed"))


def resolve_followups(asked: DataFrame, model: Callable[[], ChatModel], store: Callable[[DataFrame], DataFrame], now: Column, wording: Wording) -> DataFrame:
    """``asked``: query_id, message, history (text), has_history, summary. Adds standalone_query, is_followup, confidence and reason: by rules where they
    decide, by the model where they don't; where it fails the message stands for itself."""
    message = T.strip(F.col("message"))
    rows = asked.withColumns({"message": message}).withColumn("kind", answers.followup(F.col("message"), F.col("has_history")))
    prompts = rows.withColumn("prompt", F.when(F.col("kind").isNull(), followup_prompt(now, F.col("summary"), F.col("history"), F.col("message"), wording)))
    told = call_model(prompts, model, FOLLOWUP_SCHEMA, store).withColumn("r", F.from_json("reply", "is_followup boolean, standalone_query string, confidence double, reason string"))
    by_rule = {"standalone": (1.0, "No prior conversation history exists."), "broad": (0.9, "Preserved a broad standalone query."), "independent": (0.95, "Message appears standalone.")}
    confidence, reason = F.col("r.confidence"), F.coalesce("r.reason", F.concat(F.lit("The resolver failed: "), "error"))
    for kind, (sure, why) in by_rule.items():
        confidence, reason = F.when(F.col("kind") == kind, sure).otherwise(confidence), F.when(F.col("kind") == kind, why).otherwise(reason)
    rewritten = T.strip(F.coalesce("r.standalone_query", F.lit("")))
    return told.select(
        *asked.columns, F.when(F.col("kind").isNull() & (rewritten != ""), rewritten).otherwise(F.col("message")).alias("standalone_query"),
        F.coalesce("r.is_followup", F.lit(False)).alias("is_followup"), confidence.alias("confidence"), reason.alias("reason"), F.col("kind").isNull().alias("resolver_called"),
    )


_LOG = "session_id string, message_id long, role string, content string, language string, original_query string, standalone_query string, answerable boolean, limitations array<string>, query_id long"


def _round(todo: DataFrame, log: DataFrame, model, search, store, now: Column, history: int, wording: Wording) -> tuple[DataFrame, DataFrame]:
    """The rows that a round adds to the log, and the sources that it showed. ``todo``: query_id, session_id, message, summary, first (the id of its message)."""
    recent = conversations.recent_messages(log, history).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("message_id", "role", "content"))).alias("said"))  # ``history`` rows
    said = F.coalesce("said", F.array().cast("array<struct<message_id:bigint,role:string,content:string>>"))
    asked = todo.join(recent, "session_id", "left").withColumn("said", said).withColumns({"history": P.history_text(F.col("said"), history), "has_history": F.size("said") > 0})
    asked = store(resolve_followups(asked.drop("said"), model, store, now, wording).withColumn("language", T.detect_language(F.col("message"))))
    references = store(search(asked.select("query_id", "session_id", F.col("standalone_query").alias("query"))))
    shown = asked.join(contexts(references), "query_id", "left")
    found = shown.filter("context is not null")
    questions = found.select("query_id", F.col("standalone_query").alias("question"), "language", grounded_prompt(now, F.col("language"), F.col("standalone_query"), F.col("context"), wording).alias("prompt"), "allowed")
    answered = scope.answer(questions, model, store).select("query_id", "answer", "answerable", "limitations", "cited_ids")
    none = F.array().cast("array<string>")
    empty = shown.filter("context is null").select("query_id", P.fallback_answer(F.col("language"), F.lit(NO_EVIDENCE)).alias("answer"), F.lit(False).alias("answerable"), F.array(F.lit(NO_EVIDENCE)).alias("limitations"), none.alias("cited_ids"))
    replies = store(answered.unionByName(empty))
    user = asked.select("session_id", F.col("first").alias("message_id"), F.lit("user").alias("role"), F.col("message").alias("content"), "language", F.col("message").alias("original_query"), "standalone_query", F.lit(None).cast("boolean").alias("answerable"), none.alias("limitations"), "query_id")
    reply = asked.join(replies, "query_id").select(
        "session_id", (F.col("first") + 1).alias("message_id"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), "language", F.col("message").alias("original_query"), "standalone_query", "answerable", "limitations", "query_id"
    )
    cited = replies.select("query_id", F.explode("cited_ids").alias("source_id")).withColumn("cited", F.lit(True))
    sources = references.join(cited, ["query_id", "source_id"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    return store(user.unionByName(reply)), store(sources)


def answer_turns(turns: DataFrame, model: Callable[[], ChatModel], search: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], DataFrame], now: Column | None = None, history: int = 8, wording: Wording = Wording()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """``turns``: session_id (string), turn, message, and summary if sessions have one. The log (two messages a turn, with language, queries, answerable and limitations)
    and the sources that were shown (query_id joins them), with ``cited``.

    ``search`` gives, for (query_id, session_id, query), the rows of :func:`source_references`; ``store`` writes a table and reads it back. Blank messages are left
    out. Equal prompts of a round are asked once."""
    spark = turns.sparkSession
    own = turns.filter(T.strip(F.coalesce("message", F.lit(""))) != "").withColumn("session_id", F.col("session_id").cast("string"))
    own = own.select("session_id", "turn", "message", (F.col("summary") if "summary" in turns.columns else F.lit(None).cast("string")).alias("summary"))
    own = store(number_rows(store(number_rows(own, ["session_id"], ["turn", "message"], "round")), [], ["session_id", "round"], "query_id").withColumn("first", 2 * F.col("round")))
    rounds = own.agg(F.max("round")).first()[0]
    now = F.lit(spark.sql("SELECT current_timestamp()").first()[0]) if now is None else now  # one time for all rounds
    log, shown = spark.createDataFrame([], _LOG), None
    for n in range(0 if rounds is None else rounds + 1):
        added, sources = _round(own.filter(F.col("round") == n).drop("round"), log, model, search, store, now, history, wording)
        log, shown = log.unionByName(added), sources if shown is None else shown.unionByName(sources)
    return log, shown if shown is not None else spark.createDataFrame([], "query_id long, source_id string, cited boolean")


def run_suites(cases: DataFrame, model, search, store, fail_fast: bool = False, **how) -> tuple[DataFrame, DataFrame]:
    """Suites over a model. ``cases``: as :func:`evaluation.parse_suites` gives them. (results, totals): a shared session has its suite's cases in their order, an
    isolated case one of its own; skipped and invalid cases are not asked."""
    session = F.when(F.col("session_mode") == "shared", F.col("suite")).otherwise(F.concat_ws(":", "suite", "case_id"))
    cases = store(cases.withColumn("session_id", session).withColumn("runs", ~F.col("skip") & F.col("invalid").isNull()))
    log, sources = answer_turns(cases.filter("runs").select("session_id", F.col("place").alias("turn"), F.col("question").alias("message")), model, search, store, **how)
    asked = number_rows(cases.filter("runs"), ["session_id"], ["place", "question"], "round").select("suite", "place", F.col("session_id"), (2 * F.col("round") + 1).alias("message_id"))
    said = asked.join(log.filter("role = 'assistant'"), ["session_id", "message_id"]).select("suite", "place", F.col("content").alias("answer"), "answerable", "query_id")
    counts = sources.groupBy("query_id").agg(F.count("*").alias("raw_hit_count"), F.count_if("cited").alias("cited_count"))
    counts = counts.select("query_id", F.to_json(F.struct("raw_hit_count", F.col("raw_hit_count").alias("accepted_hit_count"), "cited_count")).alias("retrieval_summary"))
    rows = cases.join(said, ["suite", "place"], "left").join(counts, "query_id", "left").withColumns({"route": F.lit(None).cast("string"), "latency_seconds": F.lit(None).cast("double")})
    invalid = F.when(F.col("invalid").isNotNull(), F.array("invalid")).otherwise(F.array().cast("array<string>"))
    results = failures(rows).withColumn("failures", F.when(F.col("runs"), F.col("failures")).otherwise(invalid))
    results = store((until_first_failure(results) if fail_fast else results).drop("runs", "query_id"))
    return results, totals(results)
