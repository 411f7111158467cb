"""Repeated byte windows by a depth-limited radix sort of suffixes, most significant digit first.

A suffix is looked at through its first ``WINDOW`` bytes alone. Each pass names a longer digit of the suffixes
that are left, brings those of equal digits together, and lets those go that are alone: what is left after the last pass, in
groups of two at least, are exactly the repeated windows. One row per byte and pass would be a hundred
times the input, so suffixes take the first passes in runs that have their digit in common:

1. The first digit is a gram of ``GRAM`` bytes inside the window, the least of all by a hash, so that equal windows have it at the
   same offset. Neighbouring suffixes mostly share it: they are one item, a row of the digit's name (its core) and the name of
   all bytes that the item's windows cover (its hull). A core that occurs once: none of the windows repeats. A hull that occurs
   again: all of them do. The others go on, with one item of each repeated hull that shares a core with them.
2. The second digit has ``WINDOW - PART + 1`` bytes, common to ``PART`` suffixes whose offsets are in one step; judged likewise.
3. The third is the whole window, a row for each suffix that is still undecided.

Names of hulls and windows are 128 bits of BLAKE2b; what rests on them is that different bytes have different names. Cores decide only
what goes on. Before each shuffle a task puts equal hulls together, so a passage that a third of all
texts hold makes one row per task; of a core that is frequent within a task one row stays under the core's key, the others
are dealt by their hulls.

Whole copies of a text are told by SHA-256 first: all their bytes go, and one of them stays as a
source for the other texts."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import materialize, only, small, tidy
from corpusloom.llm.words import mix

WINDOW, GRAM, PART = 200, 32, 16
#: Windows that are worked on at once, so that arrays stay in a core's cache; rows that a task holds before it puts equal ones together.
BLOCK, BUFFER = 1 << 17, 500_000
#: From so many items of one core within a task on, they are dealt by their hulls.
FREQUENT = 8

#: ``place`` of an item: offset of the core's gram or step (8 bits), windows less one (8), first byte (32), then flags.
TWICE, KNOWN, SHARED, QUIET = (np.int64(1 << b) for b in range(48, 52))
_PLACE = np.int64((1 << 48) - 1)
_AT = (1 << 20) - 1
_BYTES = np.frombuffer(b"".join(blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_ROWS = "key long, h1 long, h2 long, id long, place long"
_FOUND = "id long, place long, settled boolean, further boolean"


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit name for each ``GRAM`` consecutive bytes."""
    name, size = _BYTES[data], 1
    while size < GRAM:
        name = name[:-size] * _STEP + name[size:]
        name ^= name >> np.uint64(29)
        size *= 2
    return name


def least_places(key: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive keys."""
    n = len(key) - size + 1
    full = np.concatenate([key, np.full(-len(key) % size, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, size)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def items(data: np.ndarray, ends: np.ndarray):
    """Of texts put one after another, ``ends`` the end of its text for each byte: arrays (first byte, windows, offset of the
    gram, name of the gram) for stretches of windows that have their least gram in common, block by block."""
    for at in range(0, len(data) - WINDOW + 1, BLOCK):
        seg = data[at : at + BLOCK + WINDOW - 1]
        n = len(seg) - WINDOW + 1
        starts = np.flatnonzero(np.arange(at + WINDOW, at + WINDOW + n) <= ends[at : at + n])
        if not len(starts):
            continue
        name = _grams(seg)
        gram = (least_places((name & ~np.uint64(_AT)) | np.arange(len(name), dtype=np.uint64), WINDOW - GRAM + 1) & np.uint64(_AT)).astype(np.int64)[starts]
        head = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        count = np.diff(np.append(head, len(starts)))
        yield at + starts[head], count, gram[head] - starts[head], mix(name[gram[head]])


def _digests(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit names (rows of two) of stretches of bytes."""
    out = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


class Rows:
    """Rows of a pass on their way to the shuffle: equal hulls of a task become one, frequent cores are dealt by hull."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, core: np.ndarray, names: np.ndarray, id_: np.ndarray, place: np.ndarray):
        self.parts.append(np.stack([core.view(np.int64), names[:, 0], names[:, 1], id_, place]))
        self.held += len(core)
        if self.held >= BUFFER:
            yield self.settled()

    def rest(self):
        if self.parts:
            yield self.settled()

    def settled(self) -> pa.RecordBatch:
        rows = np.concatenate(self.parts, 1)
        self.parts, self.held = [], 0
        rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
        core, h1, h2, id_, place = rows
        new = np.ones(len(core), bool)
        new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(0)
        head = np.flatnonzero(new)
        repeated = np.add.reduceat(1 + ((place & TWICE) != 0), head) > 1 if len(head) else np.zeros(0, bool)
        place[head[repeated]] |= TWICE
        place[~new] |= KNOWN  # of a hull that the row at its head stands for
        key = core.copy()
        key[~new] = mix((id_[~new] ^ place[~new]).view(np.uint64)).view(np.int64)
        rows[1:3, ~new] = 0
        at = np.flatnonzero(np.concatenate([[True], core[head][1:] != core[head][:-1]])) if len(head) else head
        size = np.diff(np.append(at, len(head)))
        many = np.repeat(size >= FREQUENT, size)
        place[head[many]] |= SHARED
        first = np.zeros(len(head), bool)
        first[at] = True
        away = head[many & ~first]
        key[away] = mix(h1[away].view(np.uint64)).view(np.int64)
        keep = new | ((place & QUIET) == 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, h1, h2, id_, place)], names=["key", "h1", "h2", "id", "place"])


def _refine(batches):
    """Rows sorted by key, h1 and h2: which hulls occur again (settled), and which items go on (further). The last row of
    a batch is held back, with what came before it, until the next one is there."""
    held, key_before, hull_before = None, False, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)])
        if held is not None:
            rows = np.concatenate([held, rows], 1)
        yield _judged(rows, key_before, hull_before, False)
        last = rows[:, -1]
        same_key, same_hull = rows[0] == last[0], (rows[:3].T == last[:3]).all(1)
        key_before = int(same_key.sum()) > 1 or (key_before and bool(same_key.all()))
        hull_before = int(same_hull.sum()) > 1 or (hull_before and bool(same_hull.all()))
        held = rows[:, -1:]
    if held is not None:
        yield _judged(held, key_before, hull_before, True)


def _judged(rows: np.ndarray, key_before: bool, hull_before: bool, final: bool) -> pa.RecordBatch:
    """Of all rows but the last (of all, if ``final``). ``key_before``, ``hull_before``: there were rows of the first row's key, hull."""
    key, place = rows[0], rows[4]
    n = len(key)
    new_key, new_hull = np.ones(n, bool), np.ones(n, bool)
    new_key[1:] = key[1:] != key[:-1]
    new_hull[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(0)
    keys, hulls = np.flatnonzero(new_key), np.flatnonzero(new_hull)
    known, shared = (place & KNOWN) != 0, (place & SHARED) != 0
    of_key, of_hull = np.cumsum(new_key) - 1, np.cumsum(new_hull) - 1
    weight = np.add.reduceat(1 + ((place & TWICE) != 0), hulls)
    weight[0] += hull_before
    size = np.diff(np.append(keys, n))
    size[0] += key_before
    several = np.add.reduceat(new_hull.astype(int), keys) > 1
    several[0] |= key_before
    several[-1] |= not final  # the batch may end within the key
    shared = np.logical_or.reduceat(shared, keys)
    common = (size > 1) | shared
    settled = known | (weight[of_hull] > 1)
    stands = new_hull & (several | shared)[of_key]
    if hull_before:
        stands[0] = False
    further = ~known & np.where(settled, stands, common[of_key])
    settled &= (place & QUIET) == 0
    out = (settled | further)[: n if final else n - 1]
    columns = [x[: len(out)][out] for x in (rows[3], place & (_PLACE | QUIET), settled, further)]
    columns[1] = np.where(weight[of_hull][: len(out)][out] > 1, columns[1] | TWICE | QUIET, columns[1])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["id", "place", "settled", "further"])


def _first_rows(batches):
    """Rows: id, copied, data. The items of whole texts."""
    rows = Rows()
    for batch in batches:
        ids, copied = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        texts = [x.as_py() for x in batch.column(2)]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw, ends = b"".join(texts), np.cumsum(lengths)
        begins = ends - lengths
        flags = np.where(copied, TWICE | QUIET, np.int64(0))
        for first, count, offset, core in items(np.frombuffer(raw, np.uint8), np.repeat(ends, lengths)):
            doc = np.searchsorted(ends, first, "right")
            place = (first - begins[doc]) << 16 | (count - 1) << 8 | offset
            yield from rows.add(core, _digests(raw, first, first + count - 1 + WINDOW), ids[doc], place | flags[doc])
    yield from rows.rest()


def _hulls(batches):
    """Rows: id, data, places. A row for each place, with the bytes of its hull."""
    for batch in batches:
        data, places = batch.column(1), batch.column(2)
        for k in range(batch.num_rows):
            raw, own = data[k].as_py(), np.array(places[k].as_py(), np.int64)
            for at in range(0, len(own), 1000):
                some = own[at : at + 1000]
                first = (some & _PLACE) >> 16
                end = first + (some >> 8 & 255) + WINDOW
                hulls = [raw[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0)[k].as_py(), len(some))), pa.array(some), pa.array(hulls, pa.binary())], names=["doc", "item", "data"])


def _part_rows(batches):
    """Rows: id, item, data. Each item in parts of offsets that are in one step of ``PART``."""
    rows = Rows()
    for batch in batches:
        ids, places, out = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), []
        for id_, place, cell in zip(ids, places.tolist(), batch.column(2), strict=True):
            raw, offset = cell.as_py(), place & 255
            least = offset - (place >> 8 & 255)
            flags = place & int(QUIET | TWICE)
            for q in range(least // PART, offset // PART + 1):
                high, low = min(offset, q * PART + PART - 1), max(least, q * PART)
                begin, common = offset - high, offset - q * PART
                core = blake2b(raw[common : common + WINDOW - PART + 1], digest_size=8, salt=bytes([q])).digest()
                hull = blake2b(raw[begin : offset - low + WINDOW], digest_size=16).digest()
                out.append((core, hull, id_, begin << 16 | (high - low) << 8 | q | flags))
        if out:
            yield from rows.add(np.frombuffer(b"".join(x[0] for x in out), np.int64), np.frombuffer(b"".join(x[1] for x in out), np.int64).reshape(-1, 2), *(np.array([x[c] for x in out], np.int64) for c in (2, 3)))
    yield from rows.rest()


def _window_rows(batches):
    """Rows: id, data, places. Each window of the places."""
    rows = Rows()
    for batch in batches:
        for id_, cell, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            own = np.array(places.as_py(), np.int64)
            count = (own >> 8 & 255) + 1
            first = np.repeat((own & _PLACE) >> 16, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            names = _digests(cell.as_py(), first, first + WINDOW)
            yield from rows.add(names[:, 0].copy(), names, np.full(len(first), id_, np.int64), first << 16 | np.repeat(own & (QUIET | TWICE), count))
    yield from rows.rest()


def _merged(batches):
    """Rows sorted by doc and place: stretches of bytes (start, end) that settled places cover, those of a batch that
    overlap or touch made one."""
    for batch in batches:
        doc, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        if not len(doc):
            continue
        start = (place & _PLACE) >> 16
        end = start + (place >> 8 & 255) + WINDOW
        new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
        base = (np.cumsum(new_doc) - 1) << 33  # so that no text reaches into the next
        far = np.maximum.accumulate(base + end)
        head = np.flatnonzero(new_doc | np.concatenate([[True], (base + start)[1:] > far[:-1]]))
        tail = np.append(head[1:], len(doc)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(start[head]), pa.array((far - base)[tail])], names=["id", "start", "end"])


def _cut(batches):
    """Rows: n_bytes, data, spans (sorted) and doc_id. Spans that overlap or touch made one, and the bytes outside them."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
        spans, kept = [], []
        for cell, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw, out = cell.as_py(), []
            for s in own:
                if out and s["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(dict(s))
            bounds = [0, *(x for s in out for x in (s["start"], s["end"])), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
            spans.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def _round(rows: DataFrame, name: str) -> DataFrame:
    return materialize(rows.repartition("key").sortWithinPartitions("key", "h1", "h2").mapInArrow(tidy(_refine), _FOUND), name)


def _going_on(found: DataFrame, name: str) -> DataFrame:
    return small(materialize(found.filter("further").groupBy("id").agg(F.collect_list("place").alias("places")), name))


def _spans() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint>>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id (of any type that orders), text. Per row: doc_id, n_bytes, spans (maximal stretches of removed bytes,
    start and end), kept (the other bytes; null where none was removed) and kept_sha256. A byte is removed if a window of
    ``WINDOW`` bytes that covers it starts anywhere else too, in the same text or another.

    Defined results: a null text is empty; texts shorter than the window keep all; repeated rows, with or without an id, are each
    other's copies, so all their bytes go; other columns of ``docs`` are not looked at, whatever their names; an empty table gives none."""
    own = only(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    own = own.withColumns({"n_bytes": F.octet_length("data").cast("long"), "whole": F.sha2("data", 256)})
    copies = own.filter(F.col("n_bytes") >= WINDOW).groupBy("whole").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("whole", "least", F.lit(True).alias("copied"))
    own = own.join(small(materialize(copies, "suffixes-copies")), "whole", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    read = (F.col("n_bytes") >= WINDOW) & (~F.col("copied") | F.col("doc_id").eqNullSafe(F.col("least")))
    texts = materialize(own.select(F.monotonically_increasing_id().alias("id"), "doc_id", "n_bytes", "copied", F.when(~F.col("copied"), F.col("whole")).alias("whole"), F.when(read, F.col("data")).alias("data")), "suffixes-texts")
    some = texts.filter("data is not null")

    found = _round(some.select("id", "copied", "data").mapInArrow(tidy(_first_rows), _ROWS), "suffixes-first")
    hulls = some.join(_going_on(found, "suffixes-wanted"), "id").select("id", "data", "places").mapInArrow(tidy(_hulls), "doc long, item long, data binary")
    hulls = materialize(hulls.select(F.monotonically_increasing_id().alias("id"), "doc", "item", "data"), "suffixes-hulls")
    parts = _round(hulls.select("id", "item", "data").mapInArrow(tidy(_part_rows), _ROWS), "suffixes-parts")
    windows = hulls.join(_going_on(parts, "suffixes-undecided"), "id").select("id", "data", "places").mapInArrow(tidy(_window_rows), _ROWS)
    windows = _round(windows, "suffixes-windows")

    place = F.col("place").bitwiseAND(F.lit(int(_PLACE)))
    inner = parts.unionByName(windows).filter("settled").select("id", place.alias("place")).join(hulls.select("id", "doc", "item"), "id")
    item = F.shiftright(F.col("item").bitwiseAND(F.lit(int(_PLACE))), 16)
    inner = inner.select(F.col("doc").alias("id"), (F.shiftleft(item, 16) + F.col("place")).alias("place"))
    settled = found.filter("settled").select("id", place.alias("place")).unionByName(inner)
    spans = settled.repartition("id").sortWithinPartitions("id", "place").mapInArrow(tidy(_merged), "id long, start long, end long")
    spans = small(materialize(spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "suffixes-spans"))

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    cut = some.filter(~F.col("copied")).join(spans, "id").select("n_bytes", "data", "spans", "doc_id").mapInArrow(tidy(_cut), f"doc_id {id_kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    cut = cut.withColumn("kept_sha256", F.sha2("kept", 256))
    gone, none = F.lit(b""), F.lit(None).cast("binary")
    copied = texts.filter("copied").select("doc_id", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"), gone.alias("kept"), F.sha2(gone, 256).alias("kept_sha256"))
    whole = texts.filter(~F.col("copied")).join(spans.select("id"), "id", "left_anti").select("doc_id", "n_bytes", _spans().alias("spans"), none.alias("kept"), F.col("whole").alias("kept_sha256"))
    return cut.unionByName(copied).unionByName(whole)


def digest(repeats: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeats.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
