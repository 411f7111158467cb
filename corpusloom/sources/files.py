"""File sources: discovery, text units of heterogeneous files with a status per file, JSON manifests and
suites. Files are read by Spark (any store it knows) and parsed in ``mapInArrow``, one file at a time."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from collections.abc import Callable
from datetime import UTC, datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions import text as T
from corpusloom.operators.chunking import normalise

ROWS = 50
#: Names that are never loaded, and parts of a stem that mark a sensitive file.
SENSITIVE_NAMES = ("id_rsa", "id_ed25519", "credentials.json", "secrets.json", ".env")
SENSITIVE_PARTS = ("secret", "password", "passwd", "credential", "token", "private_key", "apikey", "api_key", "id_rsa", "id_ed25519")

Unit = dict
Loader = Callable[[bytes, str], tuple[list[Unit], list[str]]]


def _left_out(spark: SparkSession, root: str) -> list[tuple]:
    """Files that Spark's readers leave out, since a name on their path begins with a dot or an underscore: path, modified, size."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, found = fs.makeQualified(top).toString() + "/", []
    files = fs.listFiles(top, True)
    while files.hasNext():
        f = files.next()
        path = f.getPath().toString().removeprefix(base)
        if any(part[:1] in "._" for part in path.split("/")):
            found.append((path, datetime.fromtimestamp(f.getModificationTime() / 1000, UTC), f.getLen()))
    return found


def discover(spark: SparkSession, root: str, content: bool = True, left_out: bool = True) -> DataFrame:
    """path (relative, POSIX), modified, size and content of all files below ``root``; a missing folder has none. Files that Spark's
    readers leave out (with a dot or an underscore before a name) are rows without content, which costs a listing by the driver."""
    columns = "path string, modified timestamp, size long" + ", content binary" * content
    base = root.rstrip("/")
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    if not top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(top):
        return spark.createDataFrame([], columns)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.regexp_replace("path", "^.*?" + "\\Q" + base.split("://")[-1] + "\\E/", "")
    files = files.select(relative.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), *(["content"] if content else []))
    others = _left_out(spark, base) if left_out else []
    return files.unionByName(spark.createDataFrame([(*r, None)[: 3 + content] for r in others], columns)) if others else files


def list_documents(found: DataFrame, extensions: tuple[str, ...] = rules.LOADED_EXTENSIONS) -> DataFrame:
    """Paths of the files that can be loaded, in order; ``found``: path."""
    return found.filter(T.extension(F.col("path")).isin(*extensions)).select("path").orderBy("path")


def decode(data: bytes) -> tuple[str, str]:
    for name in ("utf-8-sig", "utf-8", "cp874"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1"), "latin-1"


def table_units(header: list[str], rows: list[list[str]], title: str, selector: str = "") -> list[Unit]:
    """Row blocks as Markdown tables; ragged rows are padded."""
    width = max([len(header), *map(len, rows)], default=0)
    cell = lambda x: str(x if x is not None else "").replace("\n", " ").replace("\r", " ").replace("|", "\\|").strip()
    line = lambda r: "| " + " | ".join(map(cell, [*r, *[""] * (width - len(r))])) + " |"
    out = []
    for i in range(0, len(rows), ROWS):
        part = rows[i : i + ROWS]
        first, last = i + 1, i + len(part)
        body = "\n".join([line(header), "| " + " | ".join(["---"] * width) + " |", *map(line, part)])
        out.append({"text": f"# {title} — Rows {first}-{last}\n\n{body}", "unit_type": "rows", "selector": f"{selector}rows:{first}-{last}", "row_start": first, "row_end": last})
    return out


def load_text(data: bytes, title: str) -> tuple[list[Unit], list[str]]:
    text = normalise(decode(data)[0])
    return ([{"text": text, "unit_type": "file", "selector": ""}] if text else []), []


def load_csv(data: bytes, title: str) -> tuple[list[Unit], list[str]]:
    rows = [r for r in csv.reader(io.StringIO(decode(data)[0])) if r]
    return (table_units(rows[0], rows[1:], title) if rows else []), []


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def load_docx(data: bytes, title: str) -> tuple[list[Unit], list[str]]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    parts = []
    for x in body if body is not None else ():
        if x.tag == f"{_W}p":
            style = x.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            level = int(name[7:]) if name.lower().startswith("heading") and name[7:].isdigit() else 0
            if text := "".join(t.text or "" for t in x.iter(f"{_W}t")).strip():
                parts.append("#" * min(level, 6) + " " * bool(level) + text)
        elif x.tag == f"{_W}tbl":
            rows = [["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.findall(f"{_W}tc")] for r in x.findall(f"{_W}tr")]
            if rows:
                parts.append("[Table]\n" + "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]]))
    text = normalise("\n\n".join(parts))
    return ([{"text": text, "unit_type": "file", "selector": ""}] if text else []), []


def load_xlsx(data: bytes, title: str) -> tuple[list[Unit], list[str]]:
    book = zipfile.ZipFile(io.BytesIO(data))
    strings = ["".join(t.text or "" for t in s.iter(f"{_X}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    targets = {r.get("Id"): r.get("Target", "").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), targets[s.get(_ID)]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_X}sheet")]
    out = []
    for name, target in sheets:
        rows = []
        for r in ElementTree.fromstring(book.read(f"xl/{target}")).iter(f"{_X}row"):
            cells = []
            for c in r.iter(f"{_X}c"):
                letters = "".join(filter(str.isalpha, c.get("r", "")))
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells))
                v = c.find(f"{_X}v")
                value = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{_X}t"))
                cells.append(strings[int(value)] if c.get("t") == "s" and value else value or "")
            rows.append(cells)
        if rows:
            out += [u | {"sheet_name": name} for u in table_units(rows[0], rows[1:], f"{title} — {name}", f"sheet:{name};")]
    return out, []


def load_pdf(data: bytes, title: str) -> tuple[list[Unit], list[str]]:
    """One unit per page; needs the optional pypdf."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf") from e
    reader = pypdf.PdfReader(io.BytesIO(data))
    if reader.is_encrypted:
        return [], ["encrypted"]
    texts = [normalise(p.extract_text() or "") for p in reader.pages]
    return [{"text": t, "unit_type": "page", "selector": f"page:{i}", "page_number": i} for i, t in enumerate(texts, 1) if t], [f"page {i} is empty" for i, t in enumerate(texts, 1) if not t]


LOADERS: dict[str, Loader] = {".txt": load_text, ".md": load_text, ".markdown": load_text, ".csv": load_csv, ".docx": load_docx, ".xlsx": load_xlsx, ".pdf": load_pdf}

_UNITS = "path string, status string, error string, warnings array<string>, unit_id string, unit_index long, unit_type string, selector string, text string, page_number long, sheet_name string, row_start long, row_end long, document_id string, source_sha256 string"
_ARROW = pa.schema([("path", pa.string()), ("status", pa.string()), ("error", pa.string()), ("warnings", pa.list_(pa.string())), ("unit_id", pa.string()), ("unit_index", pa.int64()), ("unit_type", pa.string()), ("selector", pa.string()), ("text", pa.string()), ("page_number", pa.int64()), ("sheet_name", pa.string()), ("row_start", pa.int64()), ("row_end", pa.int64()), ("document_id", pa.string()), ("source_sha256", pa.string())])


def file_rows(path: str, skipped: str | None, ext: str, title: str, data: bytes | None, loaders: dict[str, Loader]) -> list[dict]:
    """The rows of a file: its units, or one without text that tells what became of it."""
    base = {"path": path, "status": skipped, "error": None, "warnings": [], "document_id": hashlib.sha256(path.encode()).hexdigest()[:20]}
    units: list[Unit] = []
    if not skipped:
        try:
            if data is None:
                raise ValueError("Spark's readers leave this file out")
            base["source_sha256"] = hashlib.sha256(data).hexdigest()
            units, base["warnings"] = loaders[ext](data, title)
            base["status"] = "loaded" if units else "loaded_empty"
        except Exception as e:  # a file that cannot be read is a row, not a failed job
            base |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
    rows = []
    for i, u in enumerate(units):
        key = json.dumps({"selector": u["selector"], "source_path": path, "source_sha256": base["source_sha256"], "unit_index": i, "unit_type": u["unit_type"]}, sort_keys=True, ensure_ascii=False)
        rows.append(base | u | {"unit_index": i, "unit_id": hashlib.sha256(key.encode()).hexdigest()})
    return rows or [base]


def load(files: DataFrame, loaders: dict[str, Loader] | None = None) -> DataFrame:
    """``files`` of :func:`discover`. A row per unit, or one without text for a file that gave none; ``status`` is loaded,
    loaded_empty, failed, skipped_hidden, skipped_sensitive or skipped_unsupported. One bad file fails alone."""
    loaders = loaders or LOADERS
    name, stem = F.lower(F.substring_index("path", "/", -1)), F.lower(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    sensitive = name.isin(*SENSITIVE_NAMES) | F.exists(F.array(*[F.lit(p) for p in SENSITIVE_PARTS]), lambda p: F.contains(stem, p))
    status = F.when(T.hidden(F.col("path")), "skipped_hidden").when(sensitive, "skipped_sensitive").when(~T.extension(F.col("path")).isin(*loaders), "skipped_unsupported")
    source = files.select("path", status.alias("status"), T.extension(F.col("path")).alias("ext"), T.title(F.col("path")).alias("title"), F.when(status.isNull(), F.col("content")).alias("content"))

    def run(batches):
        for one in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):  # one file at a time
            for row in zip(*(one.column(i).to_pylist() for i in range(5)), strict=True):
                yield pa.RecordBatch.from_pylist(file_rows(*row, loaders), schema=_ARROW)

    return source.mapInArrow(run, _UNITS)


def reports(units: DataFrame) -> DataFrame:
    """A row per file: status, units, characters, warnings, error."""
    return units.groupBy("path").agg(F.first("status").alias("status"), F.count("text").alias("units_created"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters_extracted"), F.first("warnings").alias("warnings"), F.first("error").alias("error"))


def manifests(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON files, newest first; one that cannot be parsed is a row with ``_corrupt_record``."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    df = df.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).orderBy(F.desc("modified"), F.desc("file"))
    return df if limit is None else df.limit(limit)
