"""Conversation repair against a plain search of all edits, over one and many segments."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from corpusloom.llm import op_queries, repair

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def best(codes):
    """(cost, audit) by memoised search: ``codes`` of (initial, must go, truncated)."""
    n = len(codes)
    best_of = {(n, 0): (0, ""), (n, 1): (6, "II"), (n, 2): (3, "I"), (n, 3): (0, "")}
    for i in range(n - 1, -1, -1):
        role, gone, cut = codes[i]
        row = {}
        for st in range(4):
            ways = [(4, "D", st)]
            if not gone:
                if (st, role) in KEEPS:
                    ways.append((3 * cut, "K", KEEPS[st, role]))
                ways.append((3 + 3 * cut, "R", NEXT[st]))
            row[st] = min((c + best_of[i + 1, to][0], a + best_of[i + 1, to][1]) for c, a, to in ways)
        now = dict(row)
        for _ in range(4):
            now = {st: min(now[st], (3 + now[NEXT[st]][0], "I" + now[NEXT[st]][1])) for st in range(4)}
        best_of.update({(i, st): now[st] for st in range(4)})
    return best_of[0, 0]


def plain(rows, damage=True):
    out, ids = [], {r[0] for r in rows}
    for conv in ids:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
            own += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = best(codes)
        lines, at, st = [], 0, 0
        for e in audit:
            if e == "I":
                st = NEXT[st]
                lines.append(("user:", "assistant:")[st - 2])
                continue
            role, text = own[at][1:]
            if e == "K":
                st = KEEPS[st, role[:1]]
                lines.append(f"{role}:{text}")
            elif e == "R":
                st = NEXT[st]
                lines.append(f"{('user', 'assistant')[st - 2]}:{text}")
            at += 1
        turns = [r[0] for r in own if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def drawn(r, convs, longest):
    rows = []
    for c in range(convs):
        n = r.randrange(0, longest)
        for t in range(n):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, r.choice([t, t, t, None, t + 3]), role, r.choice(["yes.", "no!", "cut", "", " \n", None, "é?", "same.", f"row {t}.", "x. \n"])))
    return rows


@pytest.mark.parametrize("segment", [1024, 3, 1])
def test_query(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    r = random.Random(segment)
    rows = drawn(r, 60, 14) + [(900 + k, t, "user", "hot text.") for k in range(30) for t in range(2)] + [(None, 0, "user", "a."), (None, None, "assistant", "b")]
    rows += [(7000, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(400)]
    spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, place int").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op_queries.QUERIES["op13_repair_conversations"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_costs_and_audits_of_drawn_codes():
    r = random.Random(8)
    cases = [[(r.choice("suaat"), r.random() < 0.3, r.random() < 0.3) for _ in range(r.randrange(0, 30))] for _ in range(400)]
    cases = [[(a, b, c and not b) for a, b, c in x] for x in cases]
    nodes = repair.Nodes([np.array(["sua".find(a) % 4 + 4 * b + 8 * c for a, b, c in x], np.int64) for x in cases])
    cost = nodes.costs(np.tile(repair.END, (len(cases), 1)))
    texts, states = repair.audits(nodes, cost)
    for k, x in enumerate(cases):
        assert (cost[nodes.first[k]], texts[k][0] + repair.ENDING[states[k][0]]) == best(x)


def test_ranks_are_the_order_of_audits():
    r = random.Random(9)
    nodes = repair.Nodes([np.array([r.randrange(4) + r.choice([0, 0, 4, 8]) for _ in range(n)]) for n in (0, 1, 5, 40)])
    cost = nodes.costs(np.tile(repair.END, (4, 1)))
    rank, pointers, letter, length = repair.rank_paths(nodes, cost)

    def audit(v):
        out = []
        while letter[v] >= 0:
            out.append(letter[v])
            v = pointers[0][v]
        return out

    told = [audit(v) for v in range(nodes.total)]
    assert [len(t) for t in told] == length.tolist()
    assert all((rank[a] < rank[b]) == (told[a] < told[b]) for a in range(nodes.total) for b in range(0, nodes.total, 7))


def test_edits_and_empty_tables(spark):
    rows = [("c", 1, "user", "hi."), ("c", 2, "user", "again."), ("d", 1, "system", "be good."), ("e", None, None, None)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = [tuple(x) for x in repair.repair(df).orderBy("conv_id", "step").select("conv_id", "edit", "role", "text").collect()]
    assert got == [("c", "K", "user", "hi."), ("c", "R", "assistant", "again."), ("d", "D", None, None), ("e", "D", None, None)]
    none = df.limit(0)
    assert repair.summarise(repair.repair(none), none).collect() == []
