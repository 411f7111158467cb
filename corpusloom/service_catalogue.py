"""More queries over the driver's tables, with SQL: logs and sessions, payloads, scopes, suites, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalogue import _ANSWERS, _PATH_SQL, _QUALITY, _RUNTIME, _TRIMMED, _WORDS24, _answered, _messages, _path, _read, query
from corpusloom.functions import payload as P
from corpusloom.operators import conversations as C
from corpusloom.operators import diagnostics as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import retrieval as R
from corpusloom.operators import scope as S
from corpusloom.streaming import events as events_

# --- sessions and messages --------------------------------------------------------------------

def _sessions(spark, d):
    m = _read(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t"))
    return m.select(F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("u"), F.col("conv_id") % 3).alias("user_id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Chat "), F.col("conv_id") % 7)).alias("title"), F.col("t").alias("updated_at"))


_SESSIONS = "(SELECT conv_id::VARCHAR AS session_id, 'u' || conv_id % 3 AS user_id, CASE WHEN conv_id % 2 = 0 THEN 'Chat ' || conv_id % 7 END AS title, max(turn) AS updated_at FROM conversations GROUP BY conv_id)"


@query(f"SELECT session_id, CASE WHEN session_id::BIGINT % 2 = 0 THEN user_id ELSE 'new' END AS user_id, title FROM {_SESSIONS} UNION ALL SELECT 'fresh', 'new', 'New chat'")
def create_sessions(spark, d):
    own = _sessions(spark, d)
    new = own.select("session_id", F.lit("new").alias("user_id"), F.lit(None).cast("string").alias("title"))
    new = new.unionByName(new.limit(1).select(F.lit("fresh").alias("session_id"), "user_id", F.lit("New chat").alias("title")))
    return C.create_sessions(own.filter("cast(session_id as long) % 2 = 0"), new, F.lit(0).cast("long")).select("session_id", "user_id", "title")


@query(f"SELECT * FROM {_SESSIONS} WHERE session_id = (SELECT min(session_id) FROM {_SESSIONS})")
def get_session(spark, d):
    own = _sessions(spark, d)
    return own.filter(F.col("session_id") == own.agg(F.min("session_id")).first()[0])


_OLD, _NEW = "turn < 2", "turn >= 2 AND conv_id % 5 <> 1 AND role IN ('user', 'assistant', 'system') AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''"


@query(f"SELECT conv_id AS session_id, turn AS message_id, role FROM conversations WHERE {_OLD} UNION ALL SELECT n.conv_id, coalesce(o.last, -1) + row_number() OVER (PARTITION BY n.conv_id ORDER BY n.turn, n.role, n.text), n.role FROM (SELECT * FROM conversations WHERE {_NEW}) n LEFT JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE {_OLD} GROUP BY 1) o USING (conv_id)")
def append_messages(spark, d):
    m = _messages(spark, d).withColumn("created_at", F.col("message_id"))
    sessions = m.filter("session_id % 5 <> 1").groupBy("session_id").agg(F.min("created_at").alias("updated_at"))
    return C.append_messages(sessions, m.filter("message_id < 2"), m.filter("message_id >= 2").drop("message_id"))[1].select("session_id", "message_id", "role")


@query("SELECT conv_id AS session_id, turn AS message_id, role, 'r' || turn % 3 AS route, turn AS n FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) AND turn = 1")
def get_message(spark, d):
    m = _messages(spark, d)
    low = m.agg(F.min("session_id")).first()[0]
    one = m.filter((F.col("session_id") == low) & (F.col("message_id") == 1)).withColumn("metadata_json", F.concat(F.lit('{"graph_route": "r'), F.col("message_id") % 3, F.lit('", "n": '), "message_id", F.lit("}")))
    return one.withColumn("m", F.from_json("metadata_json", "graph_route string, n long")).select("session_id", "message_id", "role", F.col("m.graph_route").alias("route"), "m.n")


@query("SELECT conv_id AS session_id, turn AS message_id, role, length(text) AS n_chars FROM conversations ORDER BY 1, 2")
def list_messages(spark, d):
    return _messages(spark, d).select("session_id", "message_id", "role", F.length("content").cast("long").alias("n_chars")).orderBy("session_id", "message_id")


@query("SELECT doc_id, doc_id % 3 = 0 AS kept FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def known_parents(spark, d):
    labels, docs = _read(spark, d, "labels").select("doc_id"), _read(spark, d, "documents").filter("doc_id % 3 = 0")
    known, others = C.require_parents(labels, docs, "doc_id")
    return known.withColumn("kept", F.lit(True)).unionByName(others.withColumn("kept", F.lit(False)))


@query(f"SELECT session_id, title FROM (SELECT * FROM (SELECT * FROM {_SESSIONS} ORDER BY updated_at DESC, session_id LIMIT 100) WHERE user_id = 'u1' AND (contains(lower(coalesce(title, '')), 'chat 1') OR contains(session_id, 'chat 1')) ORDER BY updated_at DESC, session_id LIMIT 10)")
def search_sessions(spark, d):
    return C.search_sessions(_sessions(spark, d), "u1", " Chat 1 ", 10).select("session_id", "title")


@query(f"SELECT user_id, CASE WHEN user_id = 'u0' THEN (SELECT min(session_id) FROM {_SESSIONS} WHERE user_id = 'u0') ELSE (SELECT arg_max(session_id, (updated_at, session_id)) FROM {_SESSIONS} s WHERE s.user_id = c.user_id) END AS session_id FROM (SELECT DISTINCT user_id FROM {_SESSIONS}) c")
def active_sessions(spark, d):
    own = _sessions(spark, d)
    low = own.filter("user_id = 'u0'").agg(F.min("session_id")).first()[0]
    return C.active_session(own, own.select("user_id").distinct().withColumn("session_id", F.lit(low)))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'auto' ELSE 'strict_selected' END AS behavior, CASE turn % 3 WHEN 0 THEN substr(text, 1, 9) WHEN 1 THEN substr(text, 1, 9) ELSE 'Own title' END AS new_title FROM conversations")
def turn_settings(spark, d):
    t = F.col("turn")
    turns = _read(spark, d, "conversations").select("conv_id", "turn", F.when(t % 2 == 1, "a.md").alias("document_scope"), F.lit("strict_selected").alias("document_behavior"), F.when(t % 3 == 1, "New chat").when(t % 3 == 2, "Own title").alias("title"), F.substring("text", 1, 9).alias("made"))
    return C.turn_settings(turns, F.col("title"), F.col("made")).select("conv_id", "turn", "behavior", "new_title")


# --- retrieval runs -----------------------------------------------------------------------------


def _log(spark, d):
    """Order lines as logged hits: an order is a run, a line a source."""
    return _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("source_rank"), F.col("l_partkey").alias("point_id"), (F.col("l_quantity") > 25).alias("accepted"), (F.col("l_tax") > 0.05).alias("cited"), F.col("l_discount").cast("double").alias("score"))


_LOG = "(SELECT l_orderkey AS query_id, l_linenumber AS source_rank, l_partkey AS point_id, l_quantity > 25 AS accepted, l_tax > 0.05 AS cited, l_discount::DOUBLE AS score FROM lineitem)"


@query(f"SELECT query_id, count(*) AS raw_hit_count, count_if(accepted) AS accepted_hit_count, count_if(cited) AS cited_count, arg_min(score, (source_rank, point_id, score)) AS top_score, bool_or(accepted) AS has_evidence FROM {_LOG} GROUP BY 1")
def retrieval_runs(spark, d):
    return C.retrieval_runs(_log(spark, d), 0.58).drop("similarity_threshold")


@query("SELECT session_id, retrieval_run_id, status FROM (SELECT o_custkey AS session_id, o_orderkey AS retrieval_run_id, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS b FROM orders) WHERE b <= 2")
def newest_runs(spark, d):
    runs = _read(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("retrieval_run_id"), F.concat(F.lit('{"status": "'), "o_orderstatus", F.lit('"}')).alias("filter_criteria_json"), F.lit("[]").alias("limitations_json"))
    return C.decoded_runs(C.list_runs(runs, newest=2)).select("session_id", "retrieval_run_id", F.col("filter_criteria")["status"].alias("status"))


@query(f"SELECT query_id, source_rank, point_id, score FROM {_LOG} WHERE cited AND query_id % 7 = 3 ORDER BY 1, 2")
def cited_log(spark, d):
    log = _log(spark, d)
    return C.list_sources(log, log.filter("query_id % 7 = 3"), cited_only=True).select("query_id", "source_rank", "point_id", "score")


@query("SELECT conv_id AS query_id, place, 'S' || turn AS source_id, length(text) AS n_chars FROM conversations JOIN (VALUES (0, 3), (1, 1), (2, 9)) v(place, turn) USING (turn)")
def cited_sources(spark, d):
    c = _read(spark, d, "conversations")
    answered = c.select(F.col("conv_id").alias("query_id")).distinct().withColumn("cited_ids", F.array(*map(F.lit, ("S3", "S1", "S9"))))
    sources = c.select(F.col("conv_id").alias("query_id"), F.concat(F.lit("S"), "turn").alias("source_id"), F.length("text").cast("long").alias("n_chars"))
    return S.cited_sources(answered, sources).select("query_id", "place", "source_id", "n_chars")


# --- payloads and blocks ------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE substr(html, 1, 20) END AS text, CASE WHEN page_id % 3 = 0 THEN page_id ELSE 7 END AS place, CASE WHEN page_id % 2 = 0 THEN 5 ELSE 4 END AS kept FROM pages")
def payload_fields(spark, d):
    i = F.col("page_id")
    payload = F.create_map(F.lit("text"), F.lit("  \n"), F.lit("chunk_text"), F.when(i % 2 == 0, F.col("url")), F.lit("content"), F.substring("html", 1, 20), F.lit("page_content"), F.lit("x"), F.lit("chunk_index"), F.when(i % 3 == 0, i.cast("string")).otherwise("1.5"), F.lit("unit_index"), F.lit(" 7 "))
    p = _read(spark, d, "pages").select("page_id", payload.alias("p"))
    kept = F.size(P.without_nulls(F.map_filter("p", lambda k, v: k != "page_content")))
    return p.select("page_id", P.first_text(F.col("p")).alias("text"), P.first_int(F.col("p")).alias("place"), kept.cast("long").alias("kept"))


@query(f"SELECT doc_id, sha256('[S1]' || chr(10) || 'source_path: ' || p || chr(10) || 'category: ' || CASE WHEN doc_id % 4 = 0 THEN 'None' ELSE source END || chr(10) || 'location: page 3' || chr(10) || 'content:' || chr(10) || text) AS block, p || ' (page 3)' AS label FROM (SELECT *, {_PATH_SQL} AS p FROM documents)")
def source_blocks(spark, d):
    s = _read(spark, d, "documents").select("doc_id", _path().alias("p"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("c"), "text")
    block = P.source_block(F.lit("S1"), F.col("p"), F.col("c"), F.lit("page 3"), F.col("text"))
    return s.select("doc_id", F.sha2(block.cast("binary"), 256).alias("block"), P.display_label(F.col("p"), F.lit("page 3")).alias("label"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN NULL ELSE role END AS route FROM conversations")
def result_paths(spark, d):
    """Results of which some have a route, some a null one, and some one further inside."""
    t, inner = F.col("turn") % 3, F.struct(F.col("role").alias("route"), "conv_id")
    keep = {"ignoreNullFields": "false"}
    json = F.when(t == 0, F.to_json(F.struct(F.col("text").alias("route"), inner.alias("debug")))).when(t == 1, F.to_json(F.struct(F.lit(None).cast("string").alias("route"), inner.alias("debug")), keep)).otherwise(F.to_json(F.struct(F.struct("text").alias("metadata"), inner.alias("debug"))))
    return _read(spark, d, "conversations").select("conv_id", "turn", P.first_present(json, "route", "selected_route", "metadata.route", "debug.route").alias("route"))


@query(r"SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS ids FROM (SELECT doc_id, regexp_extract_all('S' || (doc_id % 7) || ' ' || text || ' AWS3 S1 [S' || n_chars || ']', 'S\d+', 0) AS l FROM documents)")
def loose_citations(spark, d):
    said = F.concat(F.lit("S"), (F.col("doc_id") % 7).cast("string"), F.lit(" "), "text", F.lit(" AWS3 S1 [S"), F.col("n_chars").cast("string"), F.lit("]"))
    return _read(spark, d, "documents").select("doc_id", F.array_join(P.any_cited_ids(said), ",").alias("ids"))


@query("""SELECT 'C_' || o_custkey AS key, arg_max(o_orderpriority, o_orderkey) AS value, false AS is_true FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1
UNION ALL SELECT 'ON_' || n_nationkey, n_regionkey::VARCHAR, n_regionkey = 1 FROM nation""")
def settings_lines(spark, d):
    """Orders as lines of a settings file: those that are finished are comments, and of a customer's the last holds."""
    o = _read(spark, d, "orders")
    own = F.concat(F.lit("C_"), F.col("o_custkey").cast("string"))
    line = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("# "), own, F.lit("=1"))).when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("  "), own, F.lit(' = "'), "o_orderpriority", F.lit('" '))).otherwise(F.concat(own, F.lit("="), "o_orderpriority"))
    n = _read(spark, d, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("place"), F.concat(F.lit("ON_"), "n_nationkey", F.lit("='"), "n_regionkey", F.lit("'")).alias("value"))
    return D.parse_settings(o.select(F.col("o_orderkey").alias("place"), line.alias("value")).unionByName(n)).select("key", "value", P.is_true(F.col("value")).alias("is_true"))


@query("SELECT conv_id, sha256(string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 4 GROUP BY 1")
def history_blocks(spark, d):
    recent = C.recent_messages(_messages(spark, d), 4)
    h = recent.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("message_id", "role", "content"))).alias("m"))
    return h.select(F.col("session_id").alias("conv_id"), F.sha2(P.history_text(F.col("m"), 4).cast("binary"), 256).alias("history"))


@query(f"SELECT event_id, md5({_RUNTIME.replace('2024-05-06', chr(39) + ' || strftime(ts + INTERVAL 7 HOUR, ' + chr(39) + '%Y-%m-%d' + chr(39) + ') || ' + chr(39)).replace('14:08:09', chr(39) + ' || strftime(ts + INTERVAL 7 HOUR, ' + chr(39) + '%H:%M:%S' + chr(39) + ') || ' + chr(39))}) AS block_md5 FROM events")
def runtime_contexts(spark, d):
    """The whole block, for the time of every event."""
    utc = F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    block = P.runtime_context(F.to_utc_timestamp(F.from_utc_timestamp(utc, F.current_timezone()), F.lit("UTC")))
    return _read(spark, d, "events").select("event_id", F.md5(block.cast("binary")).alias("block_md5"))


@query(f"SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN regexp_replace(name, '\\.[a-z]+$', '') || '_' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y%m%dT%H%M%SZ') || regexp_extract(name, '\\.[a-z]+$') ELSE name END AS name FROM (SELECT *, split_part({_PATH_SQL}, '/', -1) AS name FROM documents)")
def unique_names(spark, d):
    """File names of all documents, where every other one is taken."""
    name = F.substring_index(_path(), "/", -1)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("doc_id").cast("decimal(18,6)"))
    return _read(spark, d, "documents").select("doc_id", P.unique_name(name, F.col("n_chars") % 2 == 0, now).alias("name"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN round(l_quantity / (l_linenumber - 1), 6) END AS rate FROM lineitem")
def rates(spark, d):
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.per_second(F.col("l_quantity").cast("double"), F.col("l_linenumber") - 1), 6).alias("rate"))


# --- routes, scopes and answers -----------------------------------------------------------------

_ROUTES = ("document_qa", "follow_up", "admin_support", "greeting", "identity")
_TURNS = "(SELECT conv_id, turn, role, CASE (conv_id + turn) % 6 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_ROUTES)) + " END AS route, CASE WHEN turn % 4 < 2 THEN 'a.md' END AS scope, CASE WHEN conv_id % 5 = 0 THEN 'strict_selected' ELSE 'auto' END AS behavior, text FROM conversations)"


def _turns(spark, d):
    r = F.get(F.array(*map(F.lit, _ROUTES)), ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    c = _read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "role", r.alias("route"), F.when(F.col("turn") % 4 < 2, "a.md").alias("scope"), F.when(F.col("conv_id") % 5 == 0, "strict_selected").otherwise("auto").alias("behavior"), "text")


@query(f"SELECT coalesce(route, 'none') AS route, CASE WHEN route IN ('document_qa', 'follow_up', 'admin_support') THEN 'rag' ELSE coalesce(route, 'general_chat') END AS node, count(*) AS n FROM {_TURNS} GROUP BY ALL")
def route_nodes(spark, d):
    return _turns(spark, d).groupBy(F.coalesce("route", F.lit("none")).alias("route"), S.node(F.col("route")).alias("node")).agg(F.count("*").alias("n"))


_CARRIED = f"(SELECT *, coalesce(lr IN ('document_qa', 'follow_up') AND ls IS NOT DISTINCT FROM scope, false) AS carries FROM (SELECT *, last_value(CASE WHEN role = 'assistant' THEN coalesce(route, '-') END IGNORE NULLS) OVER w AS lr, nullif(last_value(CASE WHEN role = 'assistant' THEN coalesce(scope, '-') END IGNORE NULLS) OVER w, '-') AS ls FROM {_TURNS} WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"


@query(f"""SELECT session_id, message_id, carries, used, CASE WHEN message_id % 7 = 0 THEN 'own' WHEN route = 'admin_support' THEN 'admin_support' ELSE '' END AS category, CASE WHEN used THEN 'a.md' ELSE '' END AS source_path
FROM (SELECT conv_id AS session_id, turn AS message_id, route, carries, scope IS NOT NULL AND coalesce(route = 'document_qa' OR (route = 'follow_up' AND carries) OR behavior = 'strict_selected', behavior = 'strict_selected') AS used FROM {_CARRIED})""")
def search_scopes(spark, d):
    t = S.carries_scope(_turns(spark, d))
    used = S.scope_used(F.col("route"), F.col("scope"), F.col("behavior"), F.col("carries"))
    given = F.when(F.col("message_id") % 7 == 0, F.create_map(F.lit("category"), F.array(F.lit("own"))))
    f = S.effective_filter(F.col("route"), F.col("scope"), F.col("used"), given)
    part = lambda k: F.coalesce(F.array_join(F.col("f")[k], ","), F.lit("")).alias(k)
    return t.withColumn("used", F.coalesce(used, F.lit(False))).withColumn("f", f).select("session_id", "message_id", "carries", "used", part("category"), part("source_path"))


#: Replies of a deployment, by route and whether the language is Thai.
REPLIES = {("greeting", False): ["Hello. How can I help?"], ("greeting", True): ["สวัสดีครับ"], ("identity", False): ["I am a support assistant.", "I help with internal documents.", "I am an assistant."], ("identity", True): ["ผมคือผู้ช่วย"]}


@query(f"SELECT conv_id, turn, CASE route WHEN 'greeting' THEN 'Hello. How can I help?' WHEN 'identity' THEN ['I am a support assistant.', 'I help with internal documents.', 'I am an assistant.'][CAST('0x' || substr(sha256(conv_id || '::hello'), 1, 2) AS BIGINT) % 3 + 1] END AS reply FROM {_TURNS}")
def canned_replies(spark, d):
    t = _turns(spark, d)
    return t.select(F.col("session_id").alias("conv_id"), F.col("message_id").alias("turn"), S.canned(F.col("route"), F.lit(" Hello "), F.col("session_id").cast("string"), REPLIES).alias("reply"))


_INCOMPLETE = f"(length(b) < 24 OR regexp_matches(b, '[:;,\\-—(]$') OR coalesce(regexp_extract_all(lower(b), '[a-z]+')[-1] IN ({_WORDS24}), false))"


@query(f"SELECT conv_id, turn, CASE WHEN q <> 'ok' THEN q WHEN {_INCOMPLETE} THEN 'visibly incomplete or truncated answer' END AS reason FROM (SELECT *, {_QUALITY} AS q, {_TRIMMED} AS b FROM {_ANSWERS})")
def quality_reasons(spark, d):
    return _answered(spark, d).select("conv_id", "turn", S.quality_reason(F.col("a"), F.lit("")).alias("reason"))


def _payloads(spark, d):
    """Payloads as a model might return them: good ones, some without citations, with invalid ones, or cut short."""
    n = F.col("turn") % 5
    said = F.when(n == 0, "All of the machines run on the same line [S1, S7].").when(n == 1, "All of the machines run on the same line.").when(n == 2, "All of the machines run on the same line and").when(n == 3, "I do not know that.").otherwise("All of the machines run on the same line.")
    ids = F.when(n == 4, F.array(F.lit("S2"))).when(n == 2, F.array(F.lit("S1"))).otherwise(F.array().cast("array<string>"))
    return _read(spark, d, "conversations").select("conv_id", "turn", F.lit("q").alias("question"), F.lit("en").alias("language"), said.alias("answer"), (n != 3).alias("answerable"), ids.alias("cited"), F.array(F.lit("S1"), F.lit("S2")).alias("allowed"), F.array().cast("array<string>").alias("limitations"))


_LINE = "All of the machines run on the same line"
_FALLBACK = "'I could not find sufficiently reliable internal documentation to confirm this answer, so I should not guess. Please check the relevant internal documentation or contact the responsible support team.' || chr(10) || chr(10) || 'Details: ' || "


@query(f"""SELECT conv_id, turn, turn % 5 IN (0, 4) AS answerable, CASE turn % 5 WHEN 0 THEN '{_LINE} [S1].' WHEN 1 THEN {_FALLBACK} 'The generated response did not contain a valid internal citation.'
 WHEN 2 THEN {_FALLBACK} 'The generated answer was incomplete or malformed after validation.' WHEN 3 THEN 'I do not know that.' ELSE '{_LINE}.' || chr(10) || chr(10) || 'Sources: [S2]' END AS answer,
 CASE turn % 5 WHEN 0 THEN 'Removed invalid source IDs returned by the model: S7' WHEN 1 THEN 'The model attempted to answer without a valid internal citation.' WHEN 2 THEN 'The generated answer appeared visibly incomplete or malformed: visibly incomplete or truncated answer' ELSE '' END AS limitations,
 CASE turn % 5 WHEN 0 THEN 'S1' WHEN 2 THEN 'S1' WHEN 4 THEN 'S2' ELSE '' END AS cited FROM conversations""")
def settled_answers(spark, d):
    return S.settled(_payloads(spark, d)).select("conv_id", "turn", "answerable", "answer", F.array_join("limitations", "; ").alias("limitations"), F.array_join("cited_ids", ",").alias("cited"))


# --- suites ---------------------------------------------------------------------------------------

def _suites(spark, d):
    """Suites of the benchmark's items: an item is a case whose question is its text; the fields that cases have differ."""
    i, t = F.col("item_id"), F.col("text")
    case = F.struct(
        F.concat(F.lit("c"), i.cast("string")).alias("id"), t.alias("question"), F.array(F.concat(F.lit("t"), (i % 3).cast("string")), F.substring(t, 1, 4)).alias("tags"),
        F.array(F.substring(t, 1, 5), F.to_json(F.array(F.substring(t, 2, 3), F.substring(t, 5, 3)))).alias("expected_any_fragments"),
        F.when(i % 3 == 1, F.concat(F.lit("d"), i.cast("string"))).alias("selected_document"), F.when(i % 5 == 0, "other").when(i % 5 == 1, " Isolated ").alias("session_mode"), F.when(i % 4 == 0, True).alias("skip"), F.when(i % 7 == 0, False).alias("require_sources"),
    )
    cases = _read(spark, d, "benchmark").groupBy((i % 4).alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", F.to_json(case).alias("case")))), lambda x: x["case"]).alias("cases"))
    name, defaults = F.concat(F.lit("suite "), F.col("s").cast("string")), '"defaults": {"selected_document": "d.md", "isolate_cases": false}'
    # a group that is an array stands in the JSON as one
    return cases.select(F.concat(F.lit('{"name": "'), name, F.lit(f'", {defaults}, "cases": ['), F.array_join("cases", ","), F.lit("]}")).alias("json"))


_ITEM_MODE = "CASE item_id % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'isolated' ELSE 'shared' END"
_CASES = f"""(SELECT 'suite ' || item_id % 4 AS suite, 'c' || item_id AS case_id, text AS question, CASE WHEN item_id % 3 = 1 THEN 'd' || item_id ELSE 'd.md' END AS selected_document, {_ITEM_MODE} AS session_mode, item_id % 4 = 0 AS skip, item_id % 7 <> 0 AS require_sources,
 substr(text, 1, 5) || ';' || substr(text, 2, 3) || '|' || substr(text, 5, 3) AS groups, 't' || item_id % 3 || ',' || substr(text, 1, 4) AS tags, CASE WHEN item_id % 5 = 0 THEN 'invalid session_mode: other' END AS invalid FROM benchmark)"""


def _cases(spark, d):
    c = E.parse_suites(_suites(spark, d))
    return c.select("suite", "case_id", "question", "selected_document", "session_mode", "skip", "require_sources", F.array_join(F.transform("expected_any_fragments", lambda g: F.array_join(g, "|")), ";").alias("groups"), F.array_join("tags", ",").alias("tags"), "invalid")


@query(f"SELECT * FROM {_CASES}")
def suite_cases(spark, d):
    return _cases(spark, d)


@query(f"SELECT suite, case_id FROM {_CASES} WHERE case_id <> 'c4' AND (tags LIKE 't1,%' OR tags LIKE 't2,%')")
def selected_cases(spark, d):
    ids = [f"c{r.item_id}" for r in _read(spark, d, "benchmark").select("item_id").collect() if r.item_id != 4]  # the items of the benchmark
    return E.selected(E.parse_suites(_suites(spark, d)), ids, ["t1", "t2"]).select("suite", "case_id")


_EXPECTED = "struct<raw_hit_count:int,accepted_hit_count:int,min_raw_hit_count:int,min_accepted_hit_count:int,max_raw_hit_count:int,max_accepted_hit_count:int,similarity_threshold:double,selected_source_path:string,diagnostics_contains:array<string>>"


@query("""SELECT o_orderkey, concat_ws('; ', CASE WHEN m = 0 THEN CASE WHEN n <> 3 THEN 'expected raw_hit_count=3, got ' || n END WHEN n < 2 THEN 'expected raw_hit_count>=2, got ' || n WHEN n > 4 THEN 'expected raw_hit_count<=4, got ' || n END,
 CASE WHEN m = 1 THEN 'missing retrieval count for accepted_hit_count' END, CASE WHEN m = 2 THEN 'expected selected source path in retrieval summary: a.md' END, 'expected retrieval diagnostics to contain: zzz') AS issues
FROM (SELECT o_orderkey, o_orderkey % 3 AS m, o_custkey % 6 AS n FROM orders)""")
def retrieval_checks(spark, d):
    m, n = F.col("o_orderkey") % 3, F.col("o_custkey") % 6
    summary = F.concat(F.lit('{"raw_hit_count": '), n, F.when(m != 1, ', "accepted_hit_count": 1').otherwise(""), F.when(m != 2, ', "path": "a.md"').otherwise(""), F.lit(', "similarity_threshold": 0.5}'))
    expected = F.struct(F.when(m == 0, 3), F.lit(None), F.lit(2), F.lit(1), F.lit(4), F.lit(None), F.lit(0.5), F.lit("a.md"), F.array(F.lit("raw"), F.lit("zzz"))).cast(_EXPECTED)
    o = _read(spark, d, "orders").select("o_orderkey", summary.alias("s"), expected.alias("e"))
    return o.select("o_orderkey", F.array_join(E.retrieval_issues(F.col("s"), F.col("e")), "; ").alias("issues"))


@query("SELECT suite, place FROM (SELECT conv_id AS suite, turn AS place, coalesce(sum((turn % 4 = 2)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE b = 0")
def fail_fast(spark, d):
    r = _read(spark, d, "conversations").select(F.col("conv_id").alias("suite"), F.col("turn").alias("place"), (F.col("turn") % 4 == 0).alias("skip"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("failures"))
    return E.until_first_failure(r).select("suite", "place")


# --- diagnostics ----------------------------------------------------------------------------------


@query("SELECT o_custkey AS suite, max(o_orderkey) AS report FROM orders WHERE o_orderkey % 4 <> 1 GROUP BY 1")
def latest_reports(spark, d):
    """The newest report of each suite that can be read."""
    json = F.when(F.col("o_orderkey") % 4 == 1, "{broken").otherwise('{"total": 1}')
    reports = _read(spark, d, "orders").select(F.col("o_custkey").alias("suite"), F.col("o_orderkey").alias("report"), json.alias("json")).filter(F.json_object_keys("json").isNotNull())
    return D.latest_per(reports, "suite", F.desc("report")).select("suite", "report")


def _manifests(spark, d):
    c = F.col("c_custkey")
    json = F.when(c % 5 == 0, "no json").otherwise(F.concat(F.lit('{"rebuild_id": "r'), c, F.lit('", "mode": "development", "qdrant": {"indexed_points": '), c * 3, F.lit('}, "document_safety": {"accepted_files": '), c % 9, F.lit('}, "snapshot": {"created": true}}')))
    return _read(spark, d, "customer").select(F.concat(F.lit("m"), c).alias("path"), json.alias("json"))


@query("SELECT 'm' || c_custkey AS manifest_path, CASE WHEN ok THEN 'r' || c_custkey END AS rebuild_id, CASE WHEN ok THEN c_custkey * 3 ELSE -1 END AS indexed_points, CASE WHEN ok THEN c_custkey % 9 ELSE -1 END AS accepted_files, ok AS snapshot_created, CASE WHEN NOT ok THEN 'not a JSON object' END AS error FROM (SELECT *, c_custkey % 5 <> 0 AS ok FROM customer)")
def manifest_summaries(spark, d):
    return D.summaries(_manifests(spark, d)).select("manifest_path", "rebuild_id", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("indexed_points", "accepted_files")], F.coalesce("snapshot_created", F.lit(False)).alias("snapshot_created"), "error")


@query(f"SELECT (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents) AS active_index_matches_latest_manifest, (SELECT count(*) FROM embeddings) AS active_point_count, (SELECT count(*) FROM documents) AS latest_manifest_indexed_points, (SELECT count(*) FROM (SELECT {_PATH_SQL} AS p FROM documents) WHERE p = 'none') > 0 AS selected_document_exists")
def index_consistency(spark, d):
    docs = _read(spark, d, "documents")
    return D.consistency(_read(spark, d, "embeddings").agg(F.count("*").alias("point_count")), docs.agg(F.count("*").alias("indexed_points")), docs.select(_path().alias("source_path")), "none")


# --- points and events ----------------------------------------------------------------------------


@query("SELECT vec_id AS point_id, label FROM embeddings WHERE label IN (1, 2) ORDER BY 1 LIMIT 5000")
def scroll_points(spark, d):
    """A scroll with its limit of 5000 points, in the order of their ids."""
    return R.scroll(_read(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), "label"), {"label": [1, 2]}, 5000)


@query("SELECT query_id, point_id, rank FROM (SELECT l_orderkey AS query_id, l_linenumber AS point_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def ranked_rows(spark, d):
    """The first three of each query by score, ties in the order given."""
    return R.ranked(_read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("point_id"), "l_extendedprice"), 3, F.desc("l_extendedprice"), F.asc("point_id")).select("query_id", "point_id", "rank")


@query("SELECT event_id, CASE WHEN value >= 0.6 THEN event_type END AS shown FROM events")
def suppressed_types(spark, d):
    return _read(spark, d, "events").select("event_id", events_.suppressed(F.col("event_type"), F.col("value")).alias("shown"))
