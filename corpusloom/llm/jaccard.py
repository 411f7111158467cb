"""N-gram Jaccard join: documents whose sets of word shingles overlap by a threshold, by a grouped
prefix join, and the components that the links make.

1. Documents of the same set are one class; what follows is between classes, so a group of copies,
   however large, is one class and its links are implied.
2. Shingles have one order: by how often they repeat (a count sketch of fixed size over those that
   repeat within a task, rounded to powers of two), then by name. In this order two sets that reach the threshold share a shingle of their
   prefixes, the first n - ceil(t n) + 1. Classes of the same size and prefix are one group. It is named by 64
   bits; should two groups share a name they are treated as one, of two prefixes, which loses nothing.
3. For each prefix shingle, groups are reduced to the smallest and largest before they are shuffled;
   shingles of one group alone are done with, and are left out wherever prefixes are compared.
4. First each group is tried, by one member each, against the likeliest centre among those that share a
   prefix shingle with it, and each group's members against one of them; the links found make components. Then pairs of
   groups that are not of one component are filtered by size and by the number of prefix shingles
   that they share, expanded to members, and the members of different components verified. So every
   link either is verified or lies inside one component already.
5. Verification compares words: shingles that two texts share by name are compared word by word, by
   numbers that one task gives to equal words only. A member with many partners is spread over tasks.

A class is named by a 128-bit BLAKE2b digest of its set's 128-bit shingle names; prefixes hold the first 64 bits of
those. Should two shingles of one text agree in these, the text's set is told apart by 128 bits, but its prefix
counts them as one where pairs are filtered.

Defined results: a null or empty text has the empty set and no link; fewer words than a shingle make one shingle;
repeated rows are copies of each other; the component is named by its smallest doc_id; rows with a null doc_id are
linked with nothing; a doc_id that stands on rows of different texts is judged row by row, so that a text is
linked by its own words alone."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.store import bit_filter, join_hot, materialize, may_hold, tidy
from corpusloom.llm.words import Lexicon, Shingles, mix, overlap, shingles, split_words

PERCENT = 80
SHINGLE = 5
#: log2 of the sketch's counters (one byte each when broadcast), and of its ranges.
SKETCH, SKETCH_RANGES = 22, 4
#: Shingles of a task that are counted together for the sketch.
CHUNK = 3_000_000
#: Partners of a member that one task verifies at once.
SPREAD = 64


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest intersection with 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


_SKETCH_AT = np.uint64(64 - SKETCH)


def _sets(texts, rows: int = 128):
    """The shingle set of each text of an Arrow column, in order; words are numbered anew where they have become many."""
    lexicon = Lexicon()
    for at in range(0, len(texts), rows):
        yield from shingles([split_words(t, lower=True) for t in texts.slice(at, rows).to_pylist()], lexicon, SHINGLE)
        if lexicon.full():
            lexicon = Lexicon()


_FIRST = "kind int, id long, n long, class binary, slots binary, counts binary"
_FIRST_ARROW = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("slots", pa.binary()), ("counts", pa.binary())])


def _sets_and_sketch(batches):
    """kind 0: a document's set size and class; kind 1: a task's counters of one range, those that are
    not zero. Only shingles that repeat among some ``CHUNK`` shingles of a task are counted: the many
    that occur once would drown the counters, and need none."""
    sketch = np.zeros(1 << SKETCH, np.uint32)
    chunk: list[np.ndarray] = []
    held = 0

    def count():
        names = np.concatenate(chunk)
        chunk.clear()
        names.sort()  # in place, with the parts given back: this is what a worker holds most in
        at = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, int)
        times = np.diff(np.append(at, len(names)))
        np.add.at(sketch, (names[at[times > 1]] >> _SKETCH_AT).astype(np.int64), times[times > 1].astype(np.uint32))

    extra: list[pa.Field] = []
    for batch in batches:
        extra = list(batch.schema)[2:]
        sizes, names = [], []
        for own in _sets(batch.column(1)):
            sizes.append(len(own))
            names.append(own.name())
            chunk.append(own.first)
            held += len(own)
            if held >= CHUNK:
                count()
                held = 0
        m = batch.num_rows
        nil = pa.nulls(m, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), nil, nil, *batch.columns[2:]], names=[*_FIRST_ARROW.names, *batch.schema.names[2:]])
    if chunk:
        count()
    size = 1 << (SKETCH - SKETCH_RANGES)
    for r in range(1 << SKETCH_RANGES):
        own = sketch[r * size : (r + 1) * size]
        at = np.flatnonzero(own)
        if len(at):
            row = pa.RecordBatch.from_pylist([{"kind": 1, "id": r, "n": 0, "class": None, "slots": at.astype(np.uint32).tobytes(), "counts": own[at].astype(np.uint32).tobytes()}], schema=_FIRST_ARROW)
            yield pa.RecordBatch.from_arrays([*row.columns, *(pa.nulls(1, f.type) for f in extra)], names=[*_FIRST_ARROW.names, *(f.name for f in extra)])


def _add_sketches(batches):
    size = 1 << (SKETCH - SKETCH_RANGES)
    sums: dict[int, np.ndarray] = {}  # the ranges of this task, each of fixed size
    for batch in batches:
        for r, slots, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = sums.setdefault(r, np.zeros(size, np.int64))
            own[np.frombuffer(slots, np.uint32)] += np.frombuffer(counts, np.uint32)
    for r, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([np.ceil(np.log2(np.maximum(own, 1))).astype(np.uint8).tobytes()], pa.binary())], names=["range", "levels"])


def _sketch(first: DataFrame) -> np.ndarray:
    """log2 of the counters, 2**SKETCH bytes."""
    got = first.filter("kind = 1").select("id", "slots", "counts").repartition(1 << SKETCH_RANGES, "id").mapInArrow(tidy(_add_sketches), "range long, levels binary").toArrow()
    size = 1 << (SKETCH - SKETCH_RANGES)
    out = np.zeros(1 << SKETCH, np.uint8)
    for r, levels in zip(got["range"].to_pylist(), got["levels"].to_pylist(), strict=True):
        out[r * size : (r + 1) * size] = np.frombuffer(levels, np.uint8)
    return out


def ordered_prefix(own: Shingles, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set in the common order."""
    rank = levels[(own.first >> _SKETCH_AT).astype(np.int64)]
    return own.first[np.argsort(rank, kind="stable")[: prefix_length(len(own), percent)]]  # first ascends


_PREFIXES = "class binary, n long, grp long, more long, prefix array<long>"


def _prefixes(shared, first, percent: int):
    """Of the documents that the filter ``first`` lets through (each class's smallest, and a few more), a row per class of a batch: its name, size, group (of the same size and prefix: 64 bits of a digest, and 64
    more) and prefix."""

    def run(batches):
        levels, bits = shared.value, first.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)  # never null
            texts = batch.column(1).take(pa.array(np.flatnonzero(may_hold(bits, mix(ids.view(np.uint64))))))
            seen: set[bytes] = set()
            rows = []
            for own in _sets(texts):
                name = own.name()
                if name and name not in seen:
                    seen.add(name)
                    prefix = ordered_prefix(own, levels, percent).view(np.int64)
                    rows.append((name, len(own), blake2b(prefix.tobytes() + len(own).to_bytes(8, "little"), digest_size=16).digest(), prefix))
            if rows:
                offsets = np.cumsum([0, *(len(r[3]) for r in rows)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[3] for r in rows])))
                halves = np.frombuffer(b"".join(r[2] for r in rows), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), lists],
                    names=["class", "n", "grp", "more", "prefix"],
                )

    return run


_SHARED = "grp long, n long, more long, prefix array<long>, places array<int>"


def _shared_prefixes(shared):
    """Rows: grp, n, more, prefix. The prefix cut down to the tokens that the filter lets through, with their places from 0."""

    def run(batches):
        words = shared.value
        for batch in batches:
            lists = batch.column(3)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy()
            tokens = flat.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            place = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
            stay = may_hold(words, mix(tokens.view(np.uint64)))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[stay], minlength=batch.num_rows))]).astype(np.int32))
            cut = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (tokens[stay], place[stay].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cut], names=["grp", "n", "more", "prefix", "places"])

    return run


def _spread(batches):
    for batch in batches:
        x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(mix(x.view(np.uint64)).view(np.int64))], names=["key"])


def _bits(df: DataFrame, column: str):
    """A broadcast filter of the column's values, spread by mix()."""
    spread = materialize(df.select(column).mapInArrow(tidy(_spread), "key long"), "jaccard-keys")
    return df.sparkSession.sparkContext.broadcast(bit_filter(spread, "key"))


def _needed_texts(shared):
    """(id, class, text) of the documents that the filter lets through. Texts move, not sets: they are
    shorter, and compress."""

    def run(batches):
        words = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)  # never null
            own = batch.take(pa.array(np.flatnonzero(may_hold(words, mix(ids.view(np.uint64))))))
            names = [x.name() for x in _sets(own.column(1))]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(names, pa.binary()), own.column(1)], names=["id", "class", "text"])

    return run


def _verify(percent: int):
    """Rows of a star (centre, part) come together, the centre's text first; the members that reach the
    threshold with it come out. One lexicon numbers the words of a star."""

    def run(batches):
        centre, own, lexicon = None, None, Lexicon()
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            out = []
            for star, part, member, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if member is None:
                    if lexicon.full():
                        lexicon = Lexicon()
                    centre, own = (star, part), shingles([split_words(text, lower=True)], lexicon, SHINGLE)[0]
                elif centre == (star, part):
                    x = shingles([split_words(text, lower=True)], lexicon, SHINGLE)[0]
                    both = overlap(own, x)
                    if 100 * both >= percent * (len(own) + len(x) - both):
                        out.append((star, member))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["a", "b"])

    return run


def _links(docs: DataFrame, members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``pairs``: a, b (numbers of classes). Those that reach the threshold, verified on the sets of their smallest
    documents (``members``: no, class, id), made again from the texts."""
    pairs = materialize(pairs.select("a", "b"), "jaccard-pairs")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    pairs = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SPREAD)).alias("part"))
    stars = pairs.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("no")).distinct().union(pairs.select("a", "part", "b", F.col("b").alias("no")))
    stars = materialize(stars.join(members, "no"), "jaccard-stars")
    ids = stars.select("id").distinct()
    texts = docs.filter("id is not null").select("id", "text").mapInArrow(tidy(_needed_texts(_bits(ids, "id"))), "id long, class binary, text string").dropDuplicates(["id", "class"])
    rows = stars.join(texts, ["id", "class"]).select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return materialize(rows.mapInArrow(tidy(_verify(percent)), "a long, b long"), "jaccard-links")


def _group_pairs(groups: DataFrame, listed: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (p, q) whose members are not all of one component, that share a prefix
    shingle, and whose sizes, places of it and number of shared prefix shingles allow the threshold.
    ``groups``: grp, least, most (components of the members); ``listed``: grp, n, token, at."""
    named = listed.join(groups, "grp")
    mixed = named.groupBy("token").agg(F.min("least").alias("p"), F.max("most").alias("q")).filter("p < q").select("token")
    left = materialize(named.join(mixed, "token"), "jaccard-mixed")
    x, y = (left.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("grp", "n", "at", "least", "most")]) for s in "xy")
    need = F.ceil(percent * (F.col("n_x") + F.col("n_y")) / (100 + percent))
    # of the first shingle that two sets share, no more than what follows it in either can be shared
    ahead = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    sizes = f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
    both = x.join(y, (x["token"] == y["token"]) & F.expr(f"grp_x < grp_y and least(least_x, least_y) < greatest(most_x, most_y) and {sizes}") & (ahead >= need))
    return _possible(both.select(F.col("grp_x").alias("p"), F.col("grp_y").alias("q"), "n_x", "n_y").distinct(), shared, percent)


def _possible(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Of pairs (p, q, with sizes n_x, n_y) those whose prefixes share enough for the threshold. ``shared``: grp, prefix; what two prefixes
    share is in lists, so the tokens of one group alone are not needed, nor moved."""
    pairs = materialize(pairs, "jaccard-candidates")
    some = pairs.select(F.col("p").alias("grp")).union(pairs.select("q")).distinct()
    known = materialize(shared.select("grp", "prefix").join(some, "grp"), "jaccard-compared")
    x, y = (known.select(F.col("grp").alias(g), F.col("prefix").alias(f"prefix_{g}")) for g in "pq")
    small, large = F.least("n_x", "n_y"), F.greatest("n_x", "n_y")
    need = F.ceil(percent * (F.col("n_x") + F.col("n_y")) / (100 + percent))
    behind = F.ceil(percent * large / 100) - 1  # shingles behind the prefix, of the larger set
    both = F.size(F.array_intersect("prefix_p", "prefix_q"))
    return pairs.join(x, "p").join(y, "q").filter(F.least(both + behind, small) >= need).select("p", "q").distinct()


def link_documents(docs: DataFrame, percent: int = PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs``: doc_id, text. One row per row of ``docs``: doc_id, n_shingles, component_id, the ``keep`` columns, and component,
    which names the row's component and is null for rows that are linked with nothing by definition."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    kept = "".join(f", `keep_{c}` {docs.schema[f'keep_{c}'].dataType.simpleString()}" for c in keep)
    first = materialize(docs.mapInArrow(tidy(_sets_and_sketch), _FIRST + kept), "jaccard-sets")
    sizes = first.filter("kind = 0").select("id", "n", "class", *[f"keep_{c}" for c in keep])
    members = sizes.filter("n > 0 and id is not null").groupBy("class").agg(F.min("id").alias("id"))
    members = materialize(members.withColumn("no", F.monotonically_increasing_id()), "jaccard-members")
    levels = spark.sparkContext.broadcast(_sketch(first))
    prefixes = materialize(docs.filter("id is not null").select("id", "text").mapInArrow(tidy(_prefixes(levels, _bits(members, "id"), percent)), _PREFIXES), "jaccard-prefixes")

    # groups: classes of the same size and prefix; the smallest class stands for the group
    classes = prefixes.select("grp", "class", "n").distinct().join(members.select("class", "no"), "class").select("grp", "no", "n")
    classes = materialize(classes, "jaccard-grouped")
    heads = classes.groupBy("grp").agg(F.min("no").alias("head"), F.first("n").alias("n"))
    tokens = prefixes.select("grp", F.explode("prefix").alias("token"))
    span = tokens.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low < high").select("token")
    span = materialize(span, "jaccard-tokens")
    shared = prefixes.select("grp", "n", "more", "prefix").mapInArrow(tidy(_shared_prefixes(_bits(span, "token"))), _SHARED)
    shared = materialize(shared.dropDuplicates(["grp", "more"]).filter(F.size("prefix") > 0), "jaccard-shared")  # a row per group
    listed = shared.select("grp", "n", F.inline(F.arrays_zip(F.col("prefix").alias("token"), F.col("places").alias("at"))))
    listed = materialize(listed.join(span, "token").select("grp", "n", "token", "at"), "jaccard-lists")

    # first: each group's head against that of the likeliest centre it shares a list with, and the members of a
    # group against its head. A text that others were made from has a prefix of shared shingles only;
    # what changed in a copy is rare, and fills the copy's prefix. So the centre of a list is the group
    # with the largest share of its prefix in lists.
    prefix = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    share = listed.groupBy("grp", "n").agg(F.count("*").alias("c")).select("grp", (F.col("c") / prefix).alias("share"))
    centres = listed.join(share, "grp").groupBy("token").agg(F.max(F.struct("share", "grp")).alias("c")).select("token", F.col("c.grp").alias("p"))
    some = listed.join(centres, "token").filter("grp != p").groupBy("p", F.col("grp").alias("q")).agg(F.count("*").alias("shared"))
    best = some.groupBy("q").agg(F.max(F.struct("shared", "p")).alias("best")).select("best.p", "q")
    sized = best.join(heads.select(F.col("grp").alias("p"), F.col("n").alias("n_x")), "p").join(heads.select(F.col("grp").alias("q"), F.col("n").alias("n_y")), "q")
    promising = _heads_of(_possible(sized, shared, percent), heads)
    inside = join_hot(classes.select("grp", "no"), heads, "grp").filter("no != head").select(F.col("head").alias("a"), F.col("no").alias("b"))
    links = _links(docs, members, promising.union(inside).distinct(), percent)
    label = components(links)

    # then: members of different components, of one group or of two that share a prefix shingle
    named = materialize(classes.join(label, F.col("no") == F.col("node"), "left").select("grp", "no", F.coalesce("label", "no").alias("part")), "jaccard-classes")
    groups = named.groupBy("grp").agg(F.min("part").alias("least"), F.max("part").alias("most"))
    pairs = _group_pairs(groups, listed, shared, percent)
    pairs = pairs.union(groups.filter("least < most").select("grp", "grp"))
    x, y = (named.select(F.col("grp").alias(g), F.col("no").alias(c), F.col("part").alias(f"part_{c}")) for g, c in (("p", "a"), ("q", "b")))
    expanded = pairs.join(x, "p").join(y, "q").filter("part_a != part_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _links(docs, members, expanded, percent)
    if not more.isEmpty():
        label = components(links.union(more))

    # every class's smallest document, then every document's component
    named = members.join(label, F.col("no") == F.col("node"), "left").select("class", "id", F.coalesce("label", "no").alias("label"))
    named = materialize(named, "jaccard-named")
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    found = materialize(join_hot(named, smallest, "label").select("class", "component_id", F.col("label").alias("component")), "jaccard-found")
    out = join_hot(sizes, found, "class", "left")
    alone = F.col("component_id").isNull() | (F.col("n") == 0) | F.col("id").isNull()
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), *[F.col(f"keep_{c}").alias(c) for c in keep], F.when(~alone, F.col("component")).alias("component")
    )


def _heads_of(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs of groups (p, q) as pairs of their heads (a, b)."""
    x, y = (heads.select(F.col("grp").alias(g), F.col("head").alias(h)) for g, h in (("p", "a"), ("q", "b")))
    return pairs.join(x, "p").join(y, "q").select("a", "b")
