"""Structure-aware chunks of text units: sections by heading, blocks of text, code and tables, packed
into a budget. Sequential per unit, so a Python function per unit inside ``mapInArrow``; narrow."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators of the text splitter, coarse to fine.
SEPARATORS = ["\n\n", "\n", " ", ".", ",", "\u200b", "\uff0c", "\u3001", "\uff0e", "\u3002", ""]
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
_RULE = re.compile(r"^\|(\s*:?-{3,}:?\s*\|)+$")


@dataclass(frozen=True)
class Config:
    max_chars: int = 1600
    overlap: int = 200
    min_warn: int = 80
    max_table_rows: int = 20

    def __post_init__(self):
        if self.max_chars < 200 or not 0 <= self.overlap < self.max_chars or self.min_warn < 0 or self.max_table_rows < 1:
            raise ValueError("chunks need max_chars >= 200, 0 <= overlap < max_chars, min_warn >= 0, max_table_rows >= 1")


def normalise(text: str) -> str:
    text = "\n".join(line.rstrip() for line in re.sub(r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n", text.replace("\x00", "")).split("\n"))
    return re.sub(r"\n{4,}", "\n\n\n", text).strip()


def sections(text: str) -> list[tuple[list[tuple[int, str]], str]]:
    """(path of (level, title), body) of each section with a body; all of it if there is none."""
    out, path, body = [], [], []

    def flush():
        if done := "\n".join(body).strip():
            out.append((list(path), done))
        body.clear()

    for line in text.split("\n"):
        if m := _HEADING.match(line.strip()):
            flush()
            path[:] = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), m[2])]
        else:
            body.append(line)
    flush()
    return out or [([], text)]


def blocks(body: str) -> list[tuple[str, str]]:
    """(text | code | table, content) in order."""
    lines, out, plain, i = body.split("\n"), [], [], 0
    row = lambda s: len(s := s.strip()) > 1 and s[0] == s[-1] == "|"

    def flush():
        if done := "\n".join(plain).strip():
            out.append(("text", done))
        plain.clear()

    while i < len(lines):
        if lines[i].lstrip().startswith("```"):
            flush()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith("```")), len(lines) - 1)
            out.append(("code", "\n".join(lines[i : end + 1])))
            i = end + 1
        elif i + 1 < len(lines) and row(lines[i]) and _RULE.match(lines[i + 1].strip()):
            flush()
            end = i + 2
            while end < len(lines) and row(lines[end]):
                end += 1
            out.append(("table", "\n".join(x.strip() for x in lines[i:end])))
            i = end
        else:
            plain.append(lines[i])
            i += 1
    flush()
    return out


def split_text(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Recursive splitting: the first separator that occurs cuts (and begins the following piece), small pieces are
    merged with an overlap, large ones cut by the finer separators."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    pieces = list(text) if mark == "" else [p for p in re.split(f"(?={re.escape(mark)})", text) if p]
    out: list[str] = []
    held: list[str] = []
    total = 0

    def emit():
        if done := "".join(held).strip():
            out.append(done)

    for piece in pieces:
        if len(piece) >= size:
            emit()
            held, total = [], 0
            out += split_text(piece, size, overlap, finer) if finer else [piece]
            continue
        if held and total + len(piece) > size:
            emit()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    emit()
    return out


def _table_parts(table: str, size: int, config: Config) -> Iterator[tuple[str, int, int]]:
    """(table with its header repeated, first row, last row), rows from 1."""
    head, rule, *rows = table.split("\n")
    start, held = 1, []
    for i, r in enumerate(rows, 1):
        if held and (len(held) >= config.max_table_rows or len("\n".join([head, rule, *held, r])) > size):
            yield "\n".join([head, rule, *held]), start, i - 1
            start, held = i, []
        held.append(r)
    yield "\n".join([head, rule, *held]), start, start + len(held) - 1


def fragments(kind: str, content: str, size: int, config: Config, row_start: int | None) -> Iterator[tuple[str, str, dict]]:
    if kind == "table":
        for part, a, b in _table_parts(content, size, config):
            base = (row_start or 1) - 1
            yield kind, part, {"row_start": base + a, "row_end": base + b} if b >= a else {}
    elif len(content) <= size:
        yield kind, content, {}
    elif kind == "code":
        lines = content.split("\n")
        first, last = lines[0], lines[-1] if len(lines) > 1 and lines[-1].strip().startswith("```") else "```"
        inner = "\n".join(lines[1:-1] if last == lines[-1] else lines[1:])
        for part in split_text(inner, max(120, size - len(first) - len(last) - 2), 0):
            yield kind, f"{first}\n{part}\n{last}", {}
    else:
        for part in split_text(content, size, min(config.overlap, size // 3)):
            yield kind, part, {}


def chunk_unit(unit_id: str, text: str, config: Config = Config(), row_start: int | None = None) -> list[dict]:
    """The chunks of a unit with ids that depend on content and place alone."""
    out: list[dict] = []
    for number, (path, body) in enumerate(sections(normalise(text or ""))):
        prefix = "\n".join(f"{'#' * level} {name}" for level, name in path)
        size = max(200, config.max_chars - len(prefix) - (2 if prefix else 0))
        packed: list[list[tuple[str, str, dict]]] = []
        for piece in (f for kind, content in blocks(body) for f in fragments(kind, content, size, config, row_start)):
            own = packed[-1] if packed else None
            fits = own and sum(len(p[1]) + 2 for p in own) + len(piece[1]) <= size
            if fits and not (piece[0] == "table" and any(p[0] == "table" for p in own)):
                own.append(piece)
            else:
                packed.append([piece])
        for own in packed:
            done = "\n\n".join([prefix] * bool(prefix) + [p[1] for p in own]).strip()
            if done:
                rows = {k: v for p in own for k, v in p[2].items()}
                out.append({"section": number, "heading_path": [name for _, name in path], "block_types": list(dict.fromkeys(p[0] for p in own)), "text": done, "row_start": rows.get("row_start"), "row_end": rows.get("row_end")})
    for i, c in enumerate(out):
        sha = hashlib.sha256(c["text"].encode()).hexdigest()
        key = json.dumps({"chunk_index_within_unit": i, "content_sha256": sha, "source_unit_id": unit_id}, sort_keys=True)
        c |= {"unit_id": unit_id, "chunk_id": hashlib.sha256(key.encode()).hexdigest(), "content_sha256": sha, "chunk_index": i, "chunk_count": len(out), "character_count": len(c["text"]), "oversized": len(c["text"]) > config.max_chars, "small": len(c["text"]) < config.min_warn}
    return out


SCHEMA = "unit_id string, chunk_id string, content_sha256 string, chunk_index long, chunk_count long, section long, heading_path array<string>, block_types array<string>, row_start long, row_end long, character_count long, oversized boolean, small boolean, text string"
_ARROW = pa.schema([("unit_id", pa.string()), ("chunk_id", pa.string()), ("content_sha256", pa.string()), ("chunk_index", pa.int64()), ("chunk_count", pa.int64()), ("section", pa.int64()), ("heading_path", pa.list_(pa.string())), ("block_types", pa.list_(pa.string())), ("row_start", pa.int64()), ("row_end", pa.int64()), ("character_count", pa.int64()), ("oversized", pa.bool_()), ("small", pa.bool_()), ("text", pa.string())])


def chunk_units(units: DataFrame, config: Config = Config()) -> DataFrame:
    """``units``: unit_id, text and, where units are row blocks, row_start."""
    has_rows = "row_start" in units.columns
    source = units.select(units["unit_id"].cast("string"), "text", *(["row_start"] if has_rows else []))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = part.column(2).to_pylist() if has_rows else [None] * part.num_rows
                yield pa.RecordBatch.from_pylist([c for u, t, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), rows, strict=True) for c in chunk_unit(u, t, config, r)], schema=_ARROW)

    return source.mapInArrow(run, SCHEMA)


def counters(chunks: DataFrame) -> DataFrame:
    """One row: units, chunks, their characters, and how many are oversized or small."""
    return chunks.agg(F.count_distinct("unit_id").alias("source_units"), F.count("*").alias("chunks"), F.sum("character_count").alias("chunk_characters_total"), F.count_if("oversized").alias("oversized_chunks"), F.count_if("small").alias("small_chunks"))


def warnings(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """(unit_id, warning): units that gave no chunk, and chunks that are over the limit."""
    none = units.select(units["unit_id"].cast("string").alias("unit_id")).join(chunks.select("unit_id").distinct(), "unit_id", "left_anti").select("unit_id", F.lit("no chunks were made").alias("warning"))
    return none.unionByName(chunks.filter("oversized").select("unit_id", F.concat(F.lit("chunk "), "chunk_index", F.lit(" is oversized: "), "character_count", F.lit(" characters")).alias("warning")))
