"""Personal data, and what gives it away. DataFrame functions only.

Entities are e-mail and IP addresses, card and phone numbers, by patterns with tests. The corpus then
tells which terms reveal an entity: for an entity c and a term t of the same document, the share of
c's information that t discloses is PMI(c; t) / IC(c), with probabilities estimated as shares of
documents: IC(c) = log(N / n(c)), PMI = log(N n(c,t) / (n(c) n(t))). Terms whose share reaches
``DISCLOSES``, seen together in ``SUPPORT`` documents at least, are personal data too, wherever they
stand in a document with c; sanitising replaces them, and the entities, by their kind.

Positions come from splitting at the pattern: a match starts after the pieces and matches before it.
Defined results: a null text is empty; a repeated row has its own spans, and counts as a document of
its own; offsets are code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import cutter, let, numbers, running
from corpusloom.llm.store import materialize, small

DISCLOSES, SUPPORT = 0.9, 3

#: Possessive, and bound to begin where a run begins, so that no input takes quadratic time; they match
#: what the plain patterns match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_HINTS = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9][\x20().0-9-]"}
KINDS = tuple(PATTERNS)
_TERM = r"\p{L}{3,}"
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), step) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return x.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(x))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(x))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _located(matches: Column, gaps: Column, keep) -> Column:
    """(start, end, value) of the matches that ``keep`` accepts. A match starts behind the gaps and matches before it, whose
    lengths are summed up once."""

    def with_matches(own: Column) -> Column:
        kept = F.filter(numbers(F.size(own)), lambda i: keep(F.element_at(own, i)))

        def with_totals(first) -> Column:
            def span(i):
                start = first(2 * i - 1).cast("int")
                return F.struct(start.alias("start"), (start + F.length(F.element_at(own, i))).alias("end"), F.element_at(own, i).alias("value"))

            return F.transform(kept, span)

        lengths = F.flatten(F.zip_with(gaps, own, lambda g, m: F.array(F.length(g), F.coalesce(F.length(m), F.lit(0)))))
        return running(lengths, F.lit(0), lambda a, x: a + x, with_totals)

    return let(matches, with_matches)


def find_entities(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``entities`` array<struct<kind (number), start, end, value>>, by kind and start."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    cut = docs.select("*", *[c for k, p in PATTERNS.items() for c in (F.when(text.rlike(_HINTS[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}"), F.when(text.rlike(_HINTS[k]), F.split(text, p, -1)).otherwise(none).alias(f"g_{k}"))])

    def spans(number: int, kind: str) -> Column:
        found = _located(F.col(f"m_{kind}"), F.col(f"g_{kind}"), lambda x: _valid(kind, x))
        return F.transform(found, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return cut.select(*[docs[c] for c in docs.columns], F.concat(*[spans(i, k) for i, k in enumerate(KINDS)]).cast(_SPAN).alias("entities"))


def revealing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, value, term, share) of the terms that disclose an entity. ``found``: id, entities, words (the
    distinct terms outside its mail addresses, where it has entities)."""
    total = found.count()
    # as strings, of which an array's distinct ones are found by hashing
    each = found.select("id", F.explode(F.array_distinct(F.transform("entities", lambda s: F.concat(s["kind"].cast("string"), s["value"])))).alias("x"))
    each = each.select("id", F.substring("x", 1, 1).cast("int").alias("kind"), F.expr("substring(x, 2)").alias("value"))
    of_entity = each.groupBy("kind", "value").agg(F.count("*").alias("n_c")).filter(F.col("n_c") >= SUPPORT)
    held = materialize(each.join(small(materialize(of_entity, "pii-counted")), ["kind", "value"]), "pii-held")

    # the terms of the documents that hold such entities: outside mail addresses (other entities hold no letters), or inside
    some = found.join(small(materialize(held.select("id").distinct(), "pii-holders")), "id", "left_semi")
    mails = some.select("id", F.explode("entities").alias("e")).filter(F.col("e.kind") == KINDS.index("email")).select("id", F.col("e.value").alias("mail")).distinct()
    inside = mails.select("id", "mail", F.explode(F.regexp_extract_all("mail", F.lit(_TERM), F.lit(0))).alias("term"))
    outside = some.select("id", F.lit(None).cast("string").alias("mail"), F.explode("words").alias("term"))
    named = outside.unionByName(inside).groupBy("id", "term").agg(F.max(F.col("mail").isNull()).alias("outside"), F.min("mail").alias("low"), F.max("mail").alias("high"))
    named = materialize(named, "pii-named")
    # a term that stands in the entity alone does not reveal it
    apart = F.col("outside") | (F.col("low") != F.col("value")) | (F.col("high") != F.col("value"))
    together = held.join(named, "id").filter(apart).groupBy("kind", "value", "term").agg(F.first("n_c").alias("n_c"), F.count("*").alias("n_ct")).filter(F.col("n_ct") >= SUPPORT)
    # a term's documents with such entities are some of all its documents, so they bound the share from above
    around = named.groupBy("term").agg(F.count("*").alias("least_t"))
    bits = F.log(F.lit(float(max(total, 1))) / F.col("n_c"))

    def pmi(n_t):
        return F.log(F.col("n_ct") * float(total) / (F.col("n_c").cast("double") * n_t))

    together = together.join(around, "term").filter((bits > 0) & (pmi(F.col("least_t")) >= DISCLOSES * bits - 1e-9))
    together = materialize(together.drop("least_t"), "pii-together")
    terms = small(together.select("term").distinct())
    of_term = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_TERM), F.lit(0)))).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    return together.join(of_term, "term").select("kind", "value", "term", (pmi(F.col("n_t")) / bits).alias("share")).filter(F.col("share") >= DISCLOSES)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, text. Per row: doc_id, th (hash of the text), entities, and terms
    array<struct<start,end,value>>, the places of terms that reveal one of its entities."""
    docs = docs.select(F.col("doc_id"), F.col("text"))
    text = F.coalesce("text", F.lit(""))

    own = F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, PATTERNS["email"], " "), F.lit(_TERM), F.lit(0)))
    found = find_entities(docs).select("doc_id", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("id"), "entities", F.when(F.size("entities") > 0, own).alias("words"))
    found = materialize(found, "pii-entities")
    named = materialize(revealing_terms(docs, found.filter(F.size("entities") > 0).unionByName(found.filter(F.size("entities") == 0))), "pii-terms")
    told = found.select("id", "doc_id", "th", F.explode("entities").alias("e")).join(named, (F.col("e.kind") == F.col("kind")) & (F.col("e.value") == F.col("value")))
    told = materialize(told.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("term")).alias("names")), "pii-told")
    todo = small(told.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "names"))
    rows = docs.withColumn("th", F.xxhash64("text")).join(todo, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).dropDuplicates(["doc_id", "th"])
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("names", "|"), F.lit(r")(?!\p{L})"))
    cut = rows.select("d", "t", F.regexp_extract_all("text", pattern, F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("g"))
    terms = cut.select("d", "t", _located(F.col("m"), F.col("g"), lambda x: F.lit(True)).alias("terms"))
    out = found.join(terms, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return out.select("doc_id", "th", "entities", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,value:string>>")).alias("terms"))


def sanitise(text: Column, entities: Column, terms: Column) -> Column:
    """The text with every span generalised to its kind; a span that overlaps one before it adds nothing."""
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    spans = F.array_sort(F.concat(F.transform(entities, lambda s: F.struct(s["start"], s["end"], F.element_at(names, s["kind"] + 1).alias("tag"))), F.transform(terms, lambda s: F.struct(s["start"], s["end"], F.lit("TERM").alias("tag")))))

    def with_spans(own: Column) -> Column:
        def with_ends(reach) -> Column:
            def with_cut(cut) -> Column:
                def piece(s, i):
                    at = reach(i)  # the farthest end of the spans before
                    return F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.lit("["), s["tag"], F.lit("]"))).otherwise("")

                return F.concat(F.array_join(F.transform(own, piece), ""), cut(reach(F.size(own)), F.length(text)))

            return cutter(text, with_cut)

        return running(F.transform(own, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x), with_ends)

    return let(spans, with_spans)


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("entities", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    more = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))

    def count(i: int, kind: str) -> Column:
        return F.size(F.filter("entities", lambda s: s["kind"] == i)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(i, k) for i, k in enumerate(KINDS)], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"))
