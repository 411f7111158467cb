"""Conversation and retrieval-log tables: appends, latest-wins updates, cascades and the queries on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("user", "assistant", "system")


def recent_messages(messages: DataFrame, limit: int = 8, order: str = "message_id") -> DataFrame:
    """The last ``limit`` (0: 8) messages of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc(order))
    return messages.withColumn("back", F.row_number().over(w).cast("long")).filter(F.col("back") <= (limit or 8)).drop("back")


def list_sessions(sessions: DataFrame, limit: int) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), "session_id").limit(limit)


def sessions_of(messages: DataFrame, at: str = "created_at") -> DataFrame:
    """A row per session: counts and when it was last written."""
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.min(at).alias("created_at"), F.max(at).alias("updated_at"))


def count_messages(messages: DataFrame) -> DataFrame:
    """Messages of each session, and by role."""
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), *[F.count_if(F.col("role") == r).alias(f"{r}_messages") for r in ROLES])


def summary_needed(messages: DataFrame, marks: DataFrame, trigger: int = 20) -> DataFrame:
    """Sessions with ``trigger`` or more messages after the one up to which they are summarised."""
    after = messages.join(marks, "session_id", "left").filter(F.col("message_id") > F.coalesce("summarized_until", F.lit(-1)))
    return after.groupBy("session_id").agg(F.count("*").alias("unsummarized")).filter(F.col("unsummarized") >= trigger)


def latest(versions: DataFrame, key: str, at: str) -> DataFrame:
    """Updates as appended versions: the newest row of each key; of several as new as it, one by a hash of the row, always the same."""
    order = [F.desc(at), F.xxhash64(*versions.columns)]
    return versions.withColumn("v", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("v = 1").drop("v")


def delete_cascade(gone: DataFrame, tables: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """``tables``: (table, key, foreign key), parents first. Each without the rows whose parent is gone."""
    out = []
    for table, key, foreign in tables:
        gone_keys = gone.withColumnRenamed(gone.columns[0], foreign)
        out.append(table.join(gone_keys, foreign, "left_anti"))
        gone = table.join(gone_keys, foreign, "left_semi").select(key)
    return out


def before(messages: DataFrame, role: str) -> DataFrame:
    """Each message with the text of the last earlier message of that role in its session."""
    w = Window.partitionBy("session_id").orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("previous", F.last(F.when(F.col("role") == role, F.col("content")), ignorenulls=True).over(w))


def valid_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be saved (known role, content that is not blank), and the others."""
    good = F.col("role").isin(*ROLES) & (F.coalesce(F.regexp_replace("content", r"(?U)^\s+|\s+\z", ""), F.lit("")) != "")
    good = F.coalesce(good, F.lit(False))
    return messages.filter(good), messages.filter(~good)


def gates(checks: list[tuple[str, Column]], table: DataFrame) -> DataFrame:
    """(check, ok) rows of aggregate conditions over a table, in one pass."""
    rows = [F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"ok_{i}"), F.lit(False)).alias("ok")) for i, (n, _) in enumerate(checks)]
    return table.agg(*[c.alias(f"ok_{i}") for i, (_, c) in enumerate(checks)]).select(F.inline(F.array(*rows)))


# --- sessions and messages as appended tables ---------------------------------------------------


def require_parents(rows: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent is there, and the others (a null key has none)."""
    known = parents.select(key).distinct()
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")


def create_sessions(sessions: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``sessions`` with those of ``new`` (session_id or null, user_id, title) whose id is not there yet; a null id gets a new one, and of rows
    of ``new`` with one id one stays."""
    made = new.select(F.coalesce("session_id", F.uuid()).alias("session_id"), "user_id", "title")
    made = made.groupBy("session_id").agg(F.min(F.struct("user_id", "title")).alias("s")).select("session_id", "s.user_id", "s.title")
    made = made.join(sessions.select("session_id"), "session_id", "left_anti").select("*", now.alias("created_at"), now.alias("updated_at"))
    return sessions.unionByName(made, allowMissingColumns=True)


def append_messages(sessions: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after the valid rows of ``new`` (session_id, role, content, created_at) of known sessions are appended: message ids go on
    within each session in the order of created_at, and a session's updated_at is its last message's."""
    good, _ = valid_messages(new)
    good, _ = require_parents(good, sessions, "session_id")
    last = messages.groupBy("session_id").agg(F.max("message_id").alias("last"))
    w = Window.partitionBy("session_id").orderBy("created_at", "role", "content")
    added = good.withColumn("n", F.row_number().over(w)).join(last, "session_id", "left").select("session_id", (F.coalesce("last", F.lit(-1)) + F.col("n")).cast("long").alias("message_id"), "role", "content", "created_at")
    touched = added.groupBy("session_id").agg(F.max("created_at").alias("touched"))
    after = sessions.join(touched, "session_id", "left").withColumn("updated_at", F.greatest("updated_at", "touched")).drop("touched")
    return after, messages.unionByName(added, allowMissingColumns=True)


def search_sessions(sessions: DataFrame, user: str, search: str, limit: int) -> DataFrame:
    """The newest sessions of a user whose title or id holds the text, among the newest max(5 * limit, 100) of all."""
    wanted = search.strip().lower()
    newest = list_sessions(sessions, max(5 * limit, 100)).filter(F.col("user_id") == user)
    if wanted:
        newest = newest.filter(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(wanted)) | F.contains(F.lower("session_id"), F.lit(wanted)))
    return list_sessions(newest, limit)


def active_session(sessions: DataFrame, current: DataFrame) -> DataFrame:
    """``current``: user_id, session_id. The session that each user goes on with: the current one if it is theirs, else their newest;
    null: one must be made."""
    own = sessions.select("user_id", "session_id", "updated_at")
    newest = own.groupBy("user_id").agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("newest"))
    theirs = own.select("user_id", "session_id", F.lit(True).alias("theirs"))
    return current.join(theirs, ["user_id", "session_id"], "left").join(newest, "user_id", "left").select("user_id", F.when(F.col("theirs"), F.col("session_id")).otherwise(F.col("newest")).alias("session_id"))


def turn_settings(turns: DataFrame, title: Column, derived: Column) -> DataFrame:
    """Before a turn: without a document the behaviour is auto, and a session without a title, or named New chat, gets one."""
    scope = F.coalesce("document_scope", F.lit(""))
    behavior = F.when(scope == "", "auto").otherwise(F.coalesce("document_behavior", F.lit("auto")))
    return turns.select("*", behavior.alias("behavior"), F.when(F.coalesce(title, F.lit("")).isin("", "New chat"), derived).otherwise(title).alias("new_title"))


# --- retrieval runs and their sources -----------------------------------------------------------


def retrieval_runs(logged: DataFrame, threshold: float) -> DataFrame:
    """A run for each query of a log of hits (query_id, source_rank, point_id, accepted, cited, score): counts, the score of the first hit, and
    whether there is evidence."""
    first = F.min_by("score", F.struct("source_rank", "point_id", "score"))
    return logged.groupBy("query_id").agg(
        F.count("*").alias("raw_hit_count"), F.count_if("accepted").alias("accepted_hit_count"), F.count_if("cited").alias("cited_count"), first.alias("top_score"), (F.count_if("accepted") > 0).alias("has_evidence")
    ).withColumn("similarity_threshold", F.lit(threshold))


def list_runs(runs: DataFrame, session: Column | None = None, newest: int | None = None) -> DataFrame:
    """Runs in order of their ids, or the newest of each session; of one session if asked for."""
    runs = runs if session is None else runs.filter(F.col("session_id") == session)
    if newest is None:
        return runs.orderBy("retrieval_run_id")
    w = Window.partitionBy("session_id").orderBy(F.desc("retrieval_run_id"))
    return runs.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= newest).drop("back")


def decoded_runs(runs: DataFrame) -> DataFrame:
    """Rows of the log with their JSON columns as maps and arrays; what is no JSON is null."""
    return runs.withColumns({"filter_criteria": F.from_json("filter_criteria_json", "map<string,string>"), "limitations": F.from_json("limitations_json", "array<string>")}).drop("filter_criteria_json", "limitations_json")


def list_sources(logged: DataFrame, runs: DataFrame | None = None, cited_only: bool = False) -> DataFrame:
    """Logged sources by run and rank; of some runs, or those that were cited, if asked for."""
    logged = logged if runs is None else logged.join(runs.select("query_id").distinct(), "query_id", "left_semi")
    return (logged.filter("cited") if cited_only else logged).orderBy("query_id", "source_rank")


def ensure_column(table: DataFrame, name: str, kind: str, default) -> DataFrame:
    """The table with the column, filled with the default where it had none."""
    return table if name in table.columns else table.withColumn(name, F.lit(default).cast(kind))


def with_sources(messages: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Each assistant message with its run and that run's sources: two left joins on ids. ``messages``: message_id, role; ``runs``: retrieval_run_id,
    message_id; ``sources``: retrieval_run_id, ..."""
    said = messages.filter(F.col("role") == "assistant")
    return said.join(runs.select("retrieval_run_id", "message_id"), "message_id", "left").join(sources, "retrieval_run_id", "left")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each session."""
    return runs.groupBy("session_id").agg(F.max("retrieval_run_id").alias("retrieval_run_id"))
