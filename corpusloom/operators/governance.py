"""Rule scans that accept, reject or quarantine documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import patterns, rules


def _may(low: Column, name: str) -> Column:
    """Whether a text, given in lower case, holds one of the texts that a pattern needs."""
    hints = [F.contains(low, F.lit(h)) for h in rules.HINTS[name]]
    return reduce(Column.__or__, hints)


def hits(x: Column, table: dict[str, str], low: Column | None = None) -> Column:
    """Sorted names of the patterns found; with the text in lower case, only those whose hints are there are tried."""
    return F.array_sort(F.array_compact(F.array(*[F.when(x.rlike(patterns.java(p)) if low is None else _may(low, n) & x.rlike(patterns.java(p)), F.lit(n)) for n, p in table.items()])))


def scan(files: DataFrame, production: bool, allow_secrets: bool = False, stale_days: int | None = None, now: Column | None = None, window: int | None = None) -> DataFrame:
    """``files``: path, text (null where content is not scanned), and modified (timestamp) if ages count.
    ``window``: how many characters of a text are searched; all if not given.
    Adds secret_hits, synthetic_hits, external_book_hits, stale_hits, status, reasons, warnings."""
    name = F.translate("path", "_-", "  ")
    text = F.coalesce("text", F.lit(""))
    seen = F.concat(name, F.lit("\n"), text if window is None else F.substring(text, 1, window))
    low, whole = F.col("__low"), F.col("__whole")
    stale = [F.when(F.col("path").rlike(patterns.java(rules.STALE_PATH)), F.lit("stale_path_keyword")), F.when(_may(whole, "stale_content_keyword") & text.rlike(patterns.java(rules.STALE_CONTENT)), F.lit("stale_content_keyword"))]
    if stale_days is not None:
        stale.insert(0, F.when(F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("modified") > stale_days * 86400, F.lit(f"older_than_{stale_days}_days")))
    folded = lambda x: F.translate(F.lower(F.translate(x, "İ", "i")), "ſı", "si")  # noqa: E731  letters that equal i and s where case is ignored
    lowered = files.withColumns({"__low": folded(seen), "__whole": folded(text)})
    found = lowered.select(
        *files.columns, F.array_sort(F.array_union(hits(seen, rules.SECRET, low), hits(name, rules.SECRET_NAME))).alias("secret_hits"), hits(seen, rules.SYNTHETIC, low).alias("synthetic_hits"), hits(seen, rules.BOOK, low).alias("external_book_hits"), F.array_compact(F.array(*stale)).alias("stale_hits")
    )
    secret, synthetic, book, old = (F.size(c) > 0 for c in ("secret_hits", "synthetic_hits", "external_book_hits", "stale_hits"))
    rejected = secret & (not allow_secrets)
    held = F.lit(production) & ~rejected
    status = F.when(rejected, "rejected").when(held & (synthetic | book), "quarantined").otherwise("accepted")
    reasons = F.array_compact(F.array(F.when(rejected, F.lit("secret_pattern")), F.when(held & synthetic, F.lit("synthetic_fixture")), F.when(held & book & ~synthetic, F.lit("external_book"))))
    warned = F.lit(not production)
    warnings = F.array_compact(F.array(F.when(secret & allow_secrets, F.lit("secret_override")), F.when(warned & synthetic, F.lit("synthetic_fixture")), F.when(warned & book, F.lit("external_book")), F.when(old, F.lit("stale"))))
    return found.select("*", status.alias("status"), reasons.alias("reasons"), warnings.alias("warnings"))


def summary(scanned: DataFrame) -> DataFrame:
    """One row: files by status, and files (not hits) with at least one hit of each family."""
    some = {"secret_hits": "secret_hits", "synthetic_fixture_hits": "synthetic_hits", "external_book_hits": "external_book_hits", "stale_hits": "stale_hits"}
    return scanned.agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("accepted", "quarantined", "rejected")], F.count_if(F.size("warnings") > 0).alias("warned_files"), *[F.count_if(F.size(c) > 0).alias(n) for n, c in some.items()]
    )
