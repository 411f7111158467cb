"""Benchmark passages in documents, by winnowing. DataFrame functions only.

Words are lower-cased (A-Z) runs of ASCII digits and letters and of all characters beyond ASCII. Of
each run of ``WINDOW`` words, the smallest hash of its ``GRAM``-word grams is a fingerprint; texts that
share such a run share its fingerprint, so no passage of that length is missed. Fingerprints of
documents are joined with those of the benchmark; around the grams that hit, the windows themselves
are compared with the benchmark's as strings, which drops chance hits and finds the full extent. An
item of fewer words is one window of its own length, looked up at every place.

Defined results: a null or empty text has no words; an item without words never hits; repeated items
count by their id once; rows of one doc_id with different texts are judged apart, each row of
several equal ones comes out; a null item_id is no item. What depends on the benchmark is
broadcast only after a check of its size, and joined by a shuffle beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import let, members
from corpusloom.llm.store import materialize, small

WINDOW, GRAM = 10, 5

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _places(count: Column) -> Column:
    """1 to count, empty for none."""
    return F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def _grams(names: Column, size: int) -> Column:
    """A hash of each run of ``size`` word names."""
    return F.transform(_places(F.size(names) - (size - 1)), lambda i: F.xxhash64(*[F.element_at(names, i + j) for j in range(size)], F.lit(size)))


def _winnowed(grams: Column) -> Column:
    span = WINDOW - GRAM + 1
    return F.array_distinct(F.transform(_places(F.size(grams) - (span - 1)), lambda i: F.array_min(F.slice(grams, i, span))))


def _named(df: DataFrame) -> DataFrame:
    """words, then a 64-bit name for each, then grams: one projection each, so that none is computed
    again inside another's lambda."""
    df = df.withColumn("words", words(F.col("text"))).withColumn("names", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("grams", _grams(F.col("names"), GRAM))


def find_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs``: doc_id, text; ``items``: item_id, text. Per row of ``docs``: doc_id, th (hash of the text),
    n_words, hits (array of start, size of the windows that hit; words from 0) and items (sorted array of
    item_ids), null where nothing hits."""
    docs = docs.select(F.col("doc_id"), F.col("text"))
    own = _named(items.filter("item_id is not null").select("item_id", "text")).filter(F.size("words") > 0)
    windows = own.select(
        "item_id",
        F.explode(
            F.when(F.size("words") < WINDOW, F.array(F.array_join("words", " "))).otherwise(F.transform(_places(F.size("words") - (WINDOW - 1)), lambda i: F.array_join(F.slice("words", i, WINDOW), " ")))
        ).alias("window"),
    ).distinct()
    windows = materialize(windows, "passages-windows")
    short = sorted(r[0] for r in own.filter(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())  # WINDOW - 1 at most
    marks = own.select(F.explode(F.when(F.size("words") < WINDOW, F.array(_short_name(F.col("names")))).otherwise(_winnowed(F.col("grams")))).alias("mark")).distinct()
    marks = small(materialize(marks, "passages-marks"))

    # every document's fingerprints against the benchmark's; one row of a null mark keeps the document
    named = _named(docs.withColumn("th", F.xxhash64("text")))
    own_marks = [_winnowed(F.col("grams"))] + [_short_names(F.col("names"), m) for m in short]
    rows = named.select("doc_id", "th", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(*own_marks, F.array(F.lit(None).cast("long")))).alias("mark"))
    found = rows.join(marks.withColumn("hit", F.lit(True)), "mark", "left").filter("hit or mark is null")
    hit = found.groupBy("doc_id", "th", "n_words").agg(F.collect_set("mark").alias("marks"), F.count(F.when(F.col("mark").isNull(), 1)).alias("copies"))
    hit = materialize(hit, "passages-hits")

    # the windows around the grams that hit, compared as strings
    todo = small(hit.filter(F.size("marks") > 0).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "marks"))
    near = docs.withColumn("th", F.xxhash64("text")).join(todo, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).drop("d", "t").dropDuplicates(["doc_id", "th"])
    near = _named(near)
    last = F.size("words") - WINDOW

    def around(known):
        at = F.filter(_places(F.size("grams")), lambda i: known(F.element_at("grams", i)))
        return F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.least(F.greatest(p - 1 - (WINDOW - GRAM), F.lit(0)), last), F.least(p - 1, last)))))

    starts = F.when(last < 0, F.array().cast("array<int>")).otherwise(members(F.col("marks"), around))
    spans = [F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(WINDOW).alias("size")))] + [members(F.col("marks"), lambda known, m=m: _short_spans(m, known)) for m in short]

    def said(own):  # windows leave with their own words only
        return F.transform(F.concat(*spans), lambda w: F.struct(w.alias("hit"), F.array_join(F.slice(own, w["start"] + 1, w["size"]), " ").alias("window")))

    near = near.select("doc_id", "th", F.explode(let(F.col("words"), said)).alias("w")).select("doc_id", "th", "w.hit", "w.window")
    matched = near.join(small(windows), "window").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items"))
    matched = matched.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "hits", "items")
    out = hit.join(matched, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return out.select("doc_id", "th", "n_words", "hits", "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def _short_name(names: Column) -> Column:
    return F.xxhash64(names, F.size(names))


def _short_names(names: Column, size: int) -> Column:
    return F.array_distinct(F.transform(_places(F.size(names) - (size - 1)), lambda i: F.xxhash64(F.slice(names, i, size), F.lit(size))))


def _short_spans(size: int, known) -> Column:
    at = F.filter(_places(F.size("names") - (size - 1)), lambda i: known(F.xxhash64(F.slice("names", i, size), F.lit(size))))
    return F.transform(at, lambda i: F.struct((i - 1).alias("start"), F.lit(size).alias("size")))


def hit_words(hits: Column) -> Column:
    """Words that the (sorted) windows cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, h):
        end = h["start"] + h["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], h["start"]))).alias("n"))

    return F.coalesce(F.aggregate(hits, zero, step)["n"], F.lit(0)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    n_hit = hit_words(F.col("hits"))
    ids = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<long>")), lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
