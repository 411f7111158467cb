"""Scalar expressions on text: normalising, ids, tokens, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import rules

#: Fixed value: the namespace of point ids.
POINT_NAMESPACE = "922127d7-5c34-47bb-a627-8a2c1df2b56e"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def normalise(x: Column) -> Column:
    """NULs go, all line ends become LF, lines lose trailing space, four or more LFs become three."""
    x = F.regexp_replace(F.regexp_replace(x, "\\x00", ""), "\r\n?|[\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]", "\n")
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)[\s&&[^\n]]+(?=\n|\z)", ""), "\n{4,}", "\n\n\n")
    return strip(x)


def content_sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def document_id(path: Column) -> Column:
    return F.substring(content_sha256(path), 1, 20)


def _json(x: Column) -> Column:
    """A JSON string literal of x."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def unit_id(selector: Column, path: Column, sha: Column, index: Column, kind: Column) -> Column:
    """sha256 of the JSON object of these, with sorted keys and spaces after , and :."""
    return content_sha256(F.concat(F.lit('{"selector": '), _json(selector), F.lit(', "source_path": '), _json(path), F.lit(', "source_sha256": '), _json(sha), F.lit(', "unit_index": '), index.cast("string"), F.lit(', "unit_type": '), _json(kind), F.lit("}")))


def chunk_id(index: Column, sha: Column, unit: Column) -> Column:
    return content_sha256(F.concat(F.lit('{"chunk_index_within_unit": '), index.cast("string"), F.lit(', "content_sha256": '), _json(sha), F.lit(', "source_unit_id": '), _json(unit), F.lit("}")))


def uuid5(namespace: str, name: Column) -> Column:
    """The RFC 4122 name-based UUID, natively."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.lpad(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128).cast("long")), 2, "0"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def category(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("uncategorized")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def title(path: Column) -> Column:
    return F.translate(F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=[^/.])\.[^./]+$", ""), "_-", "  ")


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def detect_language(x: Column) -> Column:
    thai, latin = x.rlike(r"[\x{0E00}-\x{0E7F}]"), x.rlike("[A-Za-z]")
    return F.when(thai & latin, "mixed").when(thai, "th").when(latin, "en").otherwise("other")


def tokens(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(rules.TOKEN), F.lit(0)), F.lower)


def contentful(own: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in rules.STOPWORDS])
    return F.array_except(F.filter(own, lambda t: F.length(t) >= 2), stop)


def lexical_norm(x: Column) -> Column:
    x = F.translate(F.lower(x), "​", "")
    return strip(F.translate(x, "“”‘’", "\"\"''"))


def quoted(x: Column) -> Column:
    """Spans between backticks or quotes, in lower case; blank ones go."""
    whole = F.regexp_extract_all(x, F.lit(rules.QUOTED), F.lit(0))
    return F.filter(F.transform(whole, lambda q: F.lower(strip(F.substring(q, F.lit(2), F.length(q) - 2)))), lambda q: q != "")


def phrases(x: Column) -> Column:
    """Exact phrases of a query, each once: quoted spans, tokens with . _ / : in them or beginning with --, and what the table of
    expansions adds."""
    norm = lexical_norm(x)
    marked = F.filter(tokens(x), lambda t: t.rlike("[._/:]|^--"))
    more = []
    for first, others, added in rules.EXPANSIONS:
        asked = F.contains(norm, F.lit(first))
        for i, o in enumerate(others):
            other = F.contains(norm, F.lit(o)) if i == 0 else other | F.contains(norm, F.lit(o))
        more.append(F.when(asked & other if others else asked, F.array(*map(F.lit, added))).otherwise(F.array().cast("array<string>")))
    found = F.transform(F.array_distinct(F.concat(quoted(x), marked, *more)), lexical_norm)
    return F.filter(found, lambda p: p != "")


def markdown_cell(x: Column) -> Column:
    cell = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[\n\r]", " "), r"\|", r"\\\\|")
    return strip(cell)


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def safe_category(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9\x{0E01}-\x{0E59}_-]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", "uncategorized").otherwise(x)


def safe_filename(x: Column) -> Column:
    """Base name in allowed characters; null where nothing or a hidden name is left."""
    name = F.regexp_replace(F.substring_index(F.translate(x, "\\", "/"), "/", -1), r"[^A-Za-z0-9\x{0E01}-\x{0E59}._() -]+", "_")
    name = F.regexp_replace(name, "^[ .]+|[ .]+$", "")
    return F.when((name == "") | F.substring_index(x, "/", -1).startswith("."), None).otherwise(name)


def session_title(x: Column) -> Column:
    flat = strip(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.when(flat == "", "New chat").when(F.length(flat) <= 48, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, 47), r"(?U)\s+\z", ""), F.lit("…")))


def short_id(x: Column, n: int = 8) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def stable_variation(session: Column, message: Column, n: int) -> Column:
    digest = content_sha256(F.concat(session, F.lit("::"), F.lower(strip(message))))
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("long") % n


def rebuild_id(at: Column) -> Column:
    stamp = F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(stamp, F.lit("_"), F.substring(F.sha1(stamp.cast("binary")), 1, 8))


def location_label(page: Column, sheet: Column, start: Column, end: Column, headings: Column) -> Column:
    parts = F.concat_ws("; ", F.when(page.isNotNull(), F.concat(F.lit("page "), page)), F.when(sheet.isNotNull(), F.concat(F.lit("sheet "), sheet)), F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("rows "), start, F.lit("-"), end)), F.nullif(F.array_join(headings, " > "), F.lit("")))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("document"))


def count_of(x: Column, mark: str) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))) / len(mark)
