"""Repair of damaged conversations: the cheapest edits that give turns of the form ``(system? (user assistant)+)?``.

Faults are told first: a row is blank, a duplicate of an earlier one, or truncated. Edits are Keep (0), Rerole to user or
assistant (3), Delete (4; blank rows and duplicates must go) and Insert of an empty turn (3); a truncated row
that stays adds 3. Of all cheapest edits those with the ASCII-least audit string are taken.

* Rows are numbered within conversations by ranges (``number_rows``) and cut into segments of ``SEGMENT`` rows, so a conversation
  of any length is the work of many tasks. A node is a place between rows with a state: nothing yet, after system, after user,
  after assistant. The cost program runs over all segments of a batch side by side, from the last row to the first.
* For conversations of several segments, the costs between a segment's first and last states (16 numbers) are chained from the end, which
  gives each segment the cost that follows it.
* Prefix doubling ranks the nodes by their audits: an optimal arc's letter ranks paths of length one, and a pair of
  ranks, of a node and of the one that its pointer leads to, ranks paths of twice the length; pointers double with them. Of optimal
  arcs the one with the least letter, then the least rank of its target, is taken; doubled pointers give the letters at every place of the path.
* Then the rows of a conversation are read in order, as a stream, and edited."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from corpusloom.llm.store import materialize, only, tidy
from corpusloom.operators.numbering import number_rows

SEGMENT = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = "DIKR"
#: States: nothing yet, after system, after user, after assistant. The state after a user or assistant turn is put in, by state.
AFTER = np.array([2, 2, 3, 2])
#: The state after a row of role system, user, assistant, other is kept; -1 if it can't be.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: What is still to be paid, and put in, behind the last row.
END, ENDING = np.array([0, 6, 3, 0]), ("", "II", "I", "")
_FAR = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"


class Nodes:
    """Nodes of segments: four for each place before a row, then four behind the last. ``codes``: of each segment's rows, the role
    (0 to 3), plus 4 if the row must go, plus 8 if it is truncated."""

    def __init__(self, codes: list[np.ndarray]):
        self.lengths = np.array([len(c) for c in codes])
        self.first = np.cumsum(4 * (self.lengths + 1)) - 4 * (self.lengths + 1)
        self.total = int((4 * (self.lengths + 1)).sum())
        self.code = np.concatenate([x for c in codes for x in (np.asarray(c, np.int64), [0])])
        self.place = np.arange(self.total) // 4
        self.state = np.arange(self.total) % 4
        behind = self.first // 4 + self.lengths
        self.exit = np.zeros(self.total, bool)
        self.exit[(4 * behind[:, None] + np.arange(4)).ravel()] = True

    def _row_arcs(self, node: np.ndarray):
        """(letter, cost, target) of the arcs of the nodes that pass a row; the cost is far where there is none."""
        code, state, after = self.code[self.place[node]], self.state[node], 4 * (self.place[node] + 1)
        stays = np.where(code & 4, _FAR, np.where(code & 8, TRUNCATED, 0))
        kept = KEPT[state, code & 3]
        yield 0, np.full(len(node), DELETE), after + state
        yield 2, np.where(kept < 0, _FAR, KEEP + stays), after + np.maximum(kept, 0)
        yield 3, REROLE + stays, after + AFTER[state]

    def costs(self, behind: np.ndarray) -> np.ndarray:
        """The least cost from each node, if ``behind`` (four for each segment) follows the segments."""
        cost = np.full(self.total, _FAR, np.int64)
        cost[(self.first[:, None] + 4 * self.lengths[:, None] + np.arange(4)).ravel()] = behind.ravel()
        longest = np.argsort(-self.lengths, kind="stable")
        ordered = self.lengths[longest]
        for t in range(1, int(ordered[0]) + 1 if len(ordered) else 0):
            some = longest[: np.searchsorted(-ordered, -t, "right")]
            node = (self.first[some][:, None] + 4 * (self.lengths[some] - t)[:, None] + np.arange(4)).ravel()
            best = np.minimum.reduce([c + cost[to] for _, c, to in self._row_arcs(node)]).reshape(-1, 4)
            two, three = np.minimum(best[:, 2], INSERT + best[:, 3]), np.minimum(best[:, 3], INSERT + best[:, 2])
            cost[node] = np.stack([np.minimum(best[:, 0], INSERT + two), np.minimum(best[:, 1], INSERT + two), two, three], 1).ravel()
        return cost

    def arcs(self, cost: np.ndarray):
        """(letter, whether it is optimal, target) for each kind of arc, of all nodes but the last ones of segments."""
        node = np.flatnonzero(~self.exit)
        put_in = 4 * self.place[node] + AFTER[self.state[node]]
        for letter, c, to in [*self._row_arcs(node), (1, np.full(len(node), INSERT), put_in)]:
            yield letter, node, (c < _FAR) & (c + cost[to] == cost[node]), to


def rank_paths(nodes: Nodes, cost: np.ndarray):
    """Ranks of all nodes by their least audits, pointers to the nodes 1, 2, 4, ... letters on, letters of the arcs taken (-1 at
    the last nodes), and lengths of the audits."""
    letter, to = np.full(nodes.total, -1), np.arange(nodes.total)
    for kind, node, optimal, target in sorted(nodes.arcs(cost), key=lambda a: -a[0]):  # letters of a node's arcs differ: the least is written last
        letter[node[optimal]], to[node[optimal]] = kind, target[optimal]
    rank, length, pointers = letter + 1, (letter >= 0).astype(np.int64), [to]
    while True:
        to = pointers[-1]
        longer = length + length[to]
        if (longer == length).all():
            return rank, pointers, letter, length
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[to], return_inverse=True)
        length = longer
        pointers.append(to[to])


def audits(nodes: Nodes, cost: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """For each segment and each state before it: the least audit, and the state behind it."""
    _, pointers, letter, length = rank_paths(nodes, cost)
    start = (nodes.first[:, None] + np.arange(4)).ravel()
    size = length[start]
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    node, last = np.repeat(start, size), start
    for k, to in enumerate(pointers):
        node = np.where(step >> k & 1, to[node], node)
        last = np.where(size >> k & 1, to[last], last)
    text = np.frombuffer(LETTERS.encode(), np.uint8)[letter[node]].tobytes().decode()
    cuts = np.cumsum(size).tolist()
    out = [text[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
    return [out[k : k + 4] for k in range(0, len(out), 4)], nodes.state[last].reshape(-1, 4)


def _between(batches):
    """Segments: the costs from each state before to each state behind."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = Nodes([np.array(x, np.int64) for x in batch.column(2).to_pylist()])
        out = []
        for behind in range(4):
            only_one = np.where(np.arange(4) == behind, 0, _FAR)
            cost = nodes.costs(np.tile(only_one, (len(nodes.lengths), 1)))
            out.append(cost[nodes.first[:, None] + np.arange(4)])
        rows = np.stack(out, 2).reshape(len(nodes.lengths), 16)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows.tolist(), pa.list_(pa.int64()))], names=["conv_id", "segment", "between"])


def _following(batches):
    """Rows sorted by conversation, the last segment first: the cost that follows each segment, by the state behind it."""
    now, behind = object(), END
    for batch in batches:
        out = []
        for conv, between in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if conv != now:
                now, behind = conv, END
            out.append(behind.tolist())
            behind = (np.array(between).reshape(4, 4) + behind).min(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "segment", "following"])


def _solved(batches):
    """Segments with what follows: the audit for each state before, and the states behind."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = Nodes([np.array(x, np.int64) for x in batch.column(2).to_pylist()])
        texts, states = audits(nodes, nodes.costs(np.array([END if x is None else x for x in batch.column(3).to_pylist()])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.list_(pa.string())), pa.array(states.tolist(), pa.list_(pa.int32()))], names=["conv_id", "segment", "audits", "states"])


_EDITS = "step long, edit string, cost long, fault string, turn {turn}, old_role string, role string, text string"


def _edited(kinds: pa.Schema):
    """A stream by conversation and segment, the segment's audits before its rows: a row for each letter of the audit."""

    def run(batches):
        conv, state, said, letter, step, out = None, 0, "", 0, 0, []
        shown = {2: "user", 3: "assistant"}

        def put(edit, cost, fault, turn, old, role, text):
            nonlocal step
            out.append((conv, step, edit, cost, fault, turn, old, role, text))
            step += 1

        def insert():
            nonlocal state
            state = int(AFTER[state])
            put("I", INSERT, None, None, None, shown[state], "")

        def end():
            for _ in ENDING[state]:
                insert()

        def batch_of():
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

        started, after = False, 0
        for batch in batches:
            for id_, segment, place, audits_, states, code, fault, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place is None:
                    if segment == 0:
                        if started:
                            end()
                        conv, step, state, after, started = id_, 0, 0, 0, True
                    state = after
                    said, letter, after = audits_[state], 0, states[state]
                    continue
                while said[letter] == "I":
                    insert()
                    letter += 1
                edit, letter = said[letter], letter + 1
                more = TRUNCATED if code & 8 else 0
                if edit == "D":
                    put("D", DELETE, fault, turn, role, None, None)
                elif edit == "K":
                    state = int(KEPT[state, code & 3])
                    put("K", KEEP + more, fault, turn, role, role, text)
                else:
                    state = int(AFTER[state])
                    put("R", REROLE + more, fault, turn, role, shown[state], text)
            yield batch_of()
            out.clear()
        if started:
            end()
            yield batch_of()

    return run


def repair(conversations: DataFrame) -> DataFrame:
    """``conversations``: conv_id and turn (of any types that order), role, text. One row for each edit, by conv_id and step: edit (K, R, D or I), cost, fault
    (blank, duplicate, truncated or null) and old_role of the row that it is made on, with that row's turn, and role and text of
    the turn that stays or is put in (null if deleted). Rows of a conversation stand together, in the order of steps.

    Defined results: a null role or text is one space; rows are ordered by turn, nulls first, then role and text; equal rows are
    duplicates but for the first; a role counts by its first letter (s, u, a; others can't be kept); a null conv_id is a conversation; a
    conversation that needs nothing, or has nothing, gives its rows kept, or none; other columns are not looked at, whatever their names."""
    own = only(conversations, "conv_id", "turn", "role", "text").withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    rows = materialize(number_rows(own, ["conv_id"], ["turn", "role", "text"], "place").withColumn("segment", F.floor(F.col("place") / SEGMENT)), "repair-rows")
    body = F.rtrim(F.col("text"), F.lit(_SPACE))
    firsts = rows.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("place").alias("place")).select(F.col("conv_id").alias("c"), F.col("place").alias("p"), F.lit(True).alias("first"))
    role, last = F.substring("role", 1, 1), F.substring(body, -1, 1)
    fault = F.when(body == "", "blank").when(F.col("first").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    kind = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    code = kind + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)
    told = rows.join(firsts, rows["conv_id"].eqNullSafe(firsts["c"]) & (rows["place"] == firsts["p"]), "left").withColumn("fault", fault).withColumn("code", code)
    told = materialize(told.select("conv_id", "segment", "place", "code", "fault", "turn", "role", "text"), "repair-faults")

    segments = told.groupBy("conv_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]).alias("codes"))  # SEGMENT rows at most
    id_kind = conversations.schema["conv_id"].dataType.simpleString()
    key = f"conv_id {id_kind}, segment long"
    many = segments.groupBy(F.col("conv_id").alias("c")).agg(F.max("segment").alias("most")).filter("most > 0").select("c")
    long = segments.join(many, segments["conv_id"].eqNullSafe(many["c"]), "left_semi")
    between = long.mapInArrow(tidy(_between), f"{key}, between array<long>")
    following = between.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment")).mapInArrow(tidy(_following), f"{key}, following array<long>")
    following = following.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "following")
    joined = segments.join(following, segments["conv_id"].eqNullSafe(following["c"]) & (segments["segment"] == following["s"]), "left")
    solved = joined.select("conv_id", "segment", "codes", "following").mapInArrow(tidy(_solved), f"{key}, audits array<string>, states array<int>")
    stream = solved.unionByName(told, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "segment", F.asc_nulls_first("place"))
    stream = stream.select("conv_id", "segment", "place", "audits", "states", "code", "fault", "turn", "role", "text")
    schema = f"conv_id {id_kind}, " + _EDITS.format(turn=conversations.schema["turn"].dataType.simpleString())
    return stream.mapInArrow(tidy(_edited(to_arrow_schema(StructType.fromDDL(schema)))), schema)


_TOLD = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summaries(id_type: pa.DataType):
    """The edits of a conversation, one after another, folded into a row."""

    def run(batches):
        conv, said, open_ = None, None, False

        def fresh():
            return {"turns": 0, "low": None, "high": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "before": None, "audit": [], "hash": hashlib.sha256(), "lines": 0}

        def row():
            gaps = said["high"] - said["low"] + 1 - said["turns"] if said["turns"] else 0
            return (conv, gaps, *(said[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(said["audit"]), said["hash"].hexdigest())

        def batch_of(rows):
            kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for batch in batches:
            rows = []
            for id_, step, edit, cost, fault, turn, old, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step == 0:
                    if open_:
                        rows.append(row())
                    conv, said, open_ = id_, fresh(), True
                said["audit"].append(edit)
                said["cost"] += cost
                if edit != "I":
                    if fault:
                        said[fault] += 1
                    if turn is not None:
                        said["turns"] += turn != said["high"]
                        said["low"] = turn if said["low"] is None else said["low"]
                        said["high"] = turn
                    if said["before"] is not None:
                        said["illegal"] += said["before"][:1] + old[:1] not in ("su", "ua", "au")
                    said["before"] = old
                if edit != "D":
                    said["hash"].update((("\n" if said["lines"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    said["lines"] += 1
            yield batch_of(rows)
        if open_:
            yield batch_of([row()])

    return run


def summarise(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: gaps between turns (whole numbers), faults, illegal neighbours, cost, audit and repaired_sha256. ``edits``: as
    :func:`repair` gives them, the rows of a conversation together."""
    id_kind = edits.schema["conv_id"].dataType
    done = edits.mapInArrow(tidy(_summaries(to_arrow_type(id_kind))), f"conv_id {id_kind.simpleString()}, {_TOLD}").withColumnRenamed("conv_id", "c")
    all_ids = conversations.select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    rest = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256))}
    return all_ids.join(done, all_ids["conv_id"].eqNullSafe(done["c"]), "left").drop("c").withColumns(zero | rest)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that crc32 of ``conv_id:turn`` modulo 20 plants: 0 drops, 1 empties, 2 takes the marks ``.!?`` out, 3 repeats, 4 sets the role
    user. A null column counts as one space, but for the turn, which stays null."""
    own = only(conversations, "conv_id", "turn", "role", "text").withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    said: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    h = F.crc32(F.concat_ws(":", *said).cast("binary")) % 20
    times = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return own.withColumns({"text": text, "role": F.when(h == 4, "user").otherwise(F.col("role"))}).withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).drop("copy")
