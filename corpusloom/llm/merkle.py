"""Document fingerprints as Merkle trees over sections and paragraphs. DataFrame functions only.

A section ends with an empty line, a paragraph with a line; a paragraph is cut into shards by its content: after at least
``LEAST`` code points, behind the first space that follows one of some letters, and after ``MOST`` at the latest, so that an edit
changes the shards around it alone. A paragraph's hash covers its text, a section's the hashes of its paragraphs, the root
the hashes of the sections, so roots tell equality and unequal branches lead to what was
edited. The fingerprint is the tree as a string: the root, then per section its hash and, in
brackets, per paragraph its hash and its shards' marks.

Likeness (0 to 1) descends both trees: equal roots are 1; of unequal ones, sections that both have are alike as a whole, of the
others the paragraphs that both have, of the rest the shards. It is the share, by code points of distinct branches, that is alike.

Defined results: a null text is the empty text (a tree without sections, like to itself); ids that are
null come first, ties of ids are ordered by text; a table of one row is its own successor; a row
that repeats another follows it. Ids are whole numbers of up to 64 bits, of any range; those of other types are cast, and null if
they are none."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrays import let, sorted_members
from corpusloom.llm.store import materialize

LEAST, MOST = 24, 63
#: Documents of a bucket of neighbouring ids, about; and buckets at most, whose bounds go into the plan.
BUCKET, BUCKETS = 4096, 40_000


def tree(text: Column) -> Column:
    """array<struct<h, n, paragraphs: array<struct<h, n, shards: array<long>>>>>; a shard is 32 bits of hash
    and, in the low six, its length; n counts code points."""

    def shard(x):
        return F.shiftleft(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)), 6).bitwiseOR(F.length(x).cast("long"))

    def paragraph(p):
        pieces = F.regexp_extract_all(p, F.lit(f"(?s).{{{LEAST},{MOST - 1}}}?[aeiouns] |.{{1,{MOST}}}"), F.lit(0))
        return F.struct(F.sha2(p.cast("binary"), 256).alias("h"), F.length(p).alias("n"), F.transform(pieces, shard).alias("shards"))

    def section(s):
        return F.struct(F.transform(F.split(s, "(?<=\n)(?!\\z)"), paragraph).alias("paragraphs"), F.length(s).alias("n"))

    def hashed(s):
        return F.struct(F.sha2(F.array_join(F.transform(s["paragraphs"], lambda p: p["h"]), "").cast("binary"), 256).alias("h"), s["n"].alias("n"), s["paragraphs"].alias("paragraphs"))

    sections = F.transform(F.filter(F.split(text, "(?<=\n\n)(?!\n|\\z)"), lambda s: F.length(s) > 0), section)
    return F.transform(sections, hashed)


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["h"]), "").cast("binary"), 256)


def fingerprint(sections: Column) -> Column:
    def paragraph(p):
        return F.concat(F.substring(p["h"], 1, 12), F.lit("."), F.array_join(F.transform(p["shards"], lambda x: F.lower(F.hex(x))), "."))

    return F.concat_ws(":", root(sections), F.array_join(F.transform(sections, lambda s: F.concat(F.substring(s["h"], 1, 12), F.lit("("), F.array_join(F.transform(s["paragraphs"], paragraph), ","), F.lit(")"))), ""))


def _said(sections: Column) -> Column:
    """A string for each section: hash and code points, then the same of each paragraph with its shards. Strings are what set
    operations of arrays find by hashing, in time that grows with the text alone."""

    def paragraph(p):
        return F.concat(p["h"], F.lit(":"), p["n"].cast("string"), F.lit(":"), F.array_join(F.transform(p["shards"], lambda x: x.cast("string")), "."))

    return F.transform(sections, lambda s: F.concat(s["h"], F.lit(":"), s["n"].cast("string"), F.lit("|"), F.array_join(F.transform(s["paragraphs"], paragraph), "|")))


def _weight(said: Column) -> Column:
    """Code points of the sections or paragraphs."""
    return F.aggregate(said, F.lit(0).cast("long"), lambda a, x: a + F.substring_index(F.substring_index(F.substring_index(x, "|", 1), ":", 2), ":", -1).cast("long"))


def _weight_of_shards(own: Column) -> Column:
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x.cast("long").bitwiseAND(F.lit(63)))


def likeness(a: Column, b: Column) -> Column:
    """Of two trees."""

    def paragraphs(said):
        return F.array_distinct(F.flatten(F.transform(said, lambda x: F.slice(F.split(x, r"\|"), F.lit(2), F.length(x)))))

    def shards(said):
        return F.array_distinct(F.flatten(F.transform(said, lambda x: F.filter(F.split(F.substring_index(x, ":", -1), r"\."), lambda y: y != ""))))

    def by_shards(alike: Column, x: Column, y: Column) -> Column:
        both = alike + _weight_of_shards(F.array_intersect(x, y))
        total = 2 * alike + _weight_of_shards(x) + _weight_of_shards(y)
        return F.when(total == 0, 1.0).otherwise(2.0 * both / total)

    def by_paragraphs(alike: Column, p: Column, q: Column) -> Column:
        rest = F.struct(shards(F.array_except(p, q)).alias("x"), shards(F.array_except(q, p)).alias("y"), (alike + _weight(F.array_intersect(p, q))).alias("alike"))
        return let(rest, lambda r: by_shards(r["alike"], r["x"], r["y"]))

    def by_sections(x: Column, y: Column) -> Column:
        rest = F.struct(paragraphs(F.array_except(x, y)).alias("p"), paragraphs(F.array_except(y, x)).alias("q"), _weight(F.array_intersect(x, y)).alias("alike"))
        return let(rest, lambda r: by_paragraphs(r["alike"], r["p"], r["q"]))

    both = F.struct(_said(a).alias("x"), _said(b).alias("y"))
    return F.when(root(a) == root(b), 1.0).otherwise(let(both, lambda t: by_sections(t["x"], t["y"])))


def differing(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>: numbers (from 0) of the paragraphs of tree ``a`` that tree ``b`` does not have, descending only into
    sections whose hash differs; empty for equal roots."""
    none = F.array().cast("array<struct<section:int,paragraph:int>>")

    def inside(s, i, known):
        return F.filter(F.transform(s["paragraphs"], lambda p, j: F.when(~known(F.xxhash64(p["h"])), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull())

    def below(known_section, known) -> Column:
        return F.flatten(F.transform(a, lambda s, i: F.when(known_section(F.xxhash64(s["h"])), none).otherwise(inside(s, i, known))))

    sections = F.transform(b, lambda t: F.xxhash64(t["h"]))
    paragraphs = F.flatten(F.transform(b, lambda t: F.transform(t["paragraphs"], lambda p: F.xxhash64(p["h"]))))
    return F.when(root(a) == root(b), none).otherwise(sorted_members(sections, lambda known_section: sorted_members(paragraphs, lambda known: below(known_section, known))))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds the key reaches, looked up over three levels. The bounds are constants of the plan."""
    fan = max(1, round(len(bounds) ** (1 / 3) + 0.5))
    wide = fan * fan

    def constant(values: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(values)), kind)

    top = constant(bounds[::wide], "array<bigint>")
    middle = constant([bounds[i : i + wide : fan] for i in range(0, len(bounds), wide)], "array<array<bigint>>")
    leaves = constant([bounds[i : i + fan] for i in range(0, len(bounds), fan)], "array<array<bigint>>")

    def reached(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= key))

    def in_leaf(m: Column, t: Column) -> Column:  # both count from 1
        leaf = (t - 1) * fan + m
        return (leaf - 1) * fan + reached(F.element_at(leaves, leaf))

    found = let(reached(top), lambda t: F.when(t == 0, 0).otherwise(let(reached(F.element_at(middle, t)), lambda m: in_leaf(m, t))))
    return found if bounds else F.lit(0)


def _bounds(keys: DataFrame, column: str, count: int) -> list[int]:
    """Ascending values that cut the column into about ``BUCKET`` rows each, ``BUCKETS`` parts at most: a summary of bounded size."""
    parts = min(BUCKETS, count // BUCKET + 1)
    if parts == 1:
        return []
    found = keys.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10 * parts).alias("b")).first().b
    return sorted(set(found or []))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and next_text, the text of the next id (the first's after the last).

    Ids are dealt to buckets between approximate quantiles, those without an id to buckets by the first bytes of their text, so that no range
    of values makes a bucket large; only the ends of buckets look beyond their own, and one shuffle of the texts serves both. Rows of one id
    are in one bucket."""
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first_bytes = F.conv(F.hex(F.substring(F.rpad(F.col("text").cast("binary"), 7, F.lit(b"\x00")), 1, 7)), 16, 10).cast("long")
    known, unknown = docs.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    nulls = _bounds(docs.filter("doc_id is null").select(first_bytes.alias("k")), "k", unknown) if unknown else []
    ids = _bounds(docs, "doc_id", known)
    bucket = F.when(F.col("doc_id").isNull(), _bucket(first_bytes, nulls)).otherwise(_bucket(F.col("doc_id"), ids) + len(nulls) + 1)
    w = Window.partitionBy("bucket").orderBy("doc_id", "text")
    here = docs.withColumn("bucket", bucket.cast("long")).repartition("bucket").select("*", F.lead("text").over(w).alias("next_text"), F.row_number().over(w).alias("at"))
    # the first of each bucket follows the last of the bucket before: at most 2 * BUCKETS + 2 rows
    order = Window.orderBy("bucket")
    used = materialize(docs.select(bucket.cast("long").alias("bucket")).distinct(), "merkle-buckets")
    after = used.select("bucket", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order)).alias("after"))
    heads = here.filter("at = 1").select(F.col("bucket").alias("after"), F.col("text").alias("next_text"))
    last = here.filter("next_text is null").drop("next_text", "at").join(F.broadcast(after), "bucket").join(heads, "after")
    return here.filter("next_text is not null").select("doc_id", "text", "next_text").unionByName(last.select("doc_id", "text", "next_text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_edited (paragraphs of the text that the
    edited text does not have) and first_edited (section.paragraph of the first of them, or null); edited is the
    text with its last half replaced by the beginning of the next text."""
    pairs = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    trees = pairs.select("doc_id", "text", "next_text", edited.alias("edited")).select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.inline(F.array(F.struct(tree(F.col("text")).alias("a"), tree(F.col("edited")).alias("b"), tree(F.col("next_text")).alias("c"))))
    )
    a, b, c = (F.col(x) for x in "abc")
    marks = trees.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), F.inline(F.array(F.struct(differing(a, b).alias("d"))))
    )
    first = F.try_element_at("d", F.lit(1))
    return marks.select(*[x for x in marks.columns if x != "d"], F.size("d").cast("long").alias("n_edited"), F.when(F.size("d") > 0, F.concat_ws(".", first["section"], first["paragraph"])).alias("first_edited"))
