"""Secrets in texts, by one combined automaton over all rules.

Each rule has a trigger (the least that a match must hold) and the full pattern. One pass over the
bytes of a text runs the combined automaton of all triggers; where it accepts, the reversed
trigger finds the start and the anchored full pattern the farthest end. Matches are leftmost and
non-overlapping within a rule; those that fail the rule's test are dropped without a retry.

Defined results: null is the empty text, without spans. Offsets are code points, ends exclusive.
Repeated rows each get their own result; extra columns are ignored unless named in ``keep``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.automata import compile_rules, longest, parse, reversed_tree
from corpusloom.llm.store import tidy


@dataclass(frozen=True)
class Rule:
    kind: str
    trigger: str
    full: str
    keep: Callable[[bytes, int], bool]  # of the match and the length of its trigger part
    fold: bool = False  # letters of the trigger in either case


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""

#: The first three are the base; the others are well-known public formats.
RULES = (
    Rule("assign", _ASSIGN, _ASSIGN + "+", lambda m, head: len(m) - head + 1 >= 8, True),
    Rule("access", r"AKIA[A-Z0-9]", r"AKIA[A-Z0-9]+", lambda m, head: len(m) >= 16),
    Rule("hex", r"[0-9a-f]{16}", r"[0-9a-f]+", lambda m, head: len(m) >= 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]", r"gh[pousr]_[A-Za-z0-9]+", lambda m, head: len(m) >= 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9]", r"xox[abprs]-[A-Za-z0-9-]+", lambda m, head: len(m) >= 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m, head: len(m) >= 40),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", lambda m, head: True),
)
BASE = ("assign", "access", "hex")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        triggers = [parse(r.trigger, r.fold) for r in rules]
        self.scan = compile_rules(triggers, search=True)
        self.back = [compile_rules([reversed_tree(t)], search=False) for t in triggers]
        self.full = [compile_rules([parse(r.full, r.fold)], search=False) for r in rules]

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """(place after the byte, state) wherever a trigger ends: the one pass over the bytes."""
        a = self.scan
        table, accepting, s, out = a.table, a.accepting, a.start, []
        for i, c in enumerate(data.translate(a.classes), 1):
            s = table[s + c]
            if s >= accepting:
                out.append((i, s))
        return out

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then rule order."""
        data = (text or "").encode("utf-8", "surrogatepass")
        done, found = [0] * len(self.rules), []
        for at, state in self.hits(data):
            for k in self.scan.rules[state]:
                if at <= done[k]:
                    continue
                start = longest(self.back[k], data, at, done[k], -1)
                if start < 0:
                    continue
                end = longest(self.full[k], data, start, len(data))
                if end < 0:
                    continue
                done[k] = end
                if self.rules[k].keep(data[start:end], at - start):
                    found.append((start, k, end))
        found.sort()
        if len(data) == len(text or ""):
            return [(self.rules[k].kind, a, b) for a, k, b in found]
        out, seen, chars = [], 0, 0
        for a, k, b in found:  # starts ascend; what is before a start is counted once
            chars += len(data[seen:a].decode("utf-8", "surrogatepass"))
            seen = a
            out.append((self.rules[k].kind, chars, chars + b - a))  # matches are ASCII
        return out


def redact(text: str | None, spans) -> str | None:
    """The text with each span (overlapping ones joined) replaced by ``[SECRET:kind]``."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[SECRET:{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, redacted: bool = False) -> DataFrame:
    """``keep`` columns, ``spans`` array<struct<kind,start,end>> and, if asked for, ``clean`` (the
    redacted text). Narrow: no shuffle."""
    source = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    fields = [*source.drop("__text").schema, T.StructField("spans", SPANS)] + [T.StructField("clean", T.StringType())] * redacted
    schema = T.StructType(fields)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        own = scanner(rules)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            spans = [own.spans(t) for t in texts]
            more = [pa.array([redact(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())] if redacted else []
            lists = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, *more], names=schema.names)

    return source.mapInArrow(tidy(run), schema)


_scanners: dict[tuple[str, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once per worker."""
    key = tuple(r.full for r in rules)
    if key not in _scanners:
        _scanners[key] = Scanner(rules)
    return _scanners[key]


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in BASE]
    return found.select("doc_id", *n, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
