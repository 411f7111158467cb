"""Long repeats across documents, found by recompression.

Rounds rename each text: runs of a symbol become one symbol, then pairs (left, right) become one,
where a coin of the name says whether a symbol may stand left or right. A new name is a 128-bit chain of the
names that it stands for, down to those of words, so that all tasks name alike, and equal passages
get equal symbols inside, whatever surrounds them. Each symbol carries the words that its making
depended on; it is interior to a window if all of these are.

1. Rows whose whole text is that of a smaller id lose what they hold at once, and take no part in what follows.
2. After ``ROUNDS`` rounds a symbol covers some six words. Symbols are grouped over all documents;
   those of two documents at least are shared.
3. A window of words can repeat only if all its interior symbols are shared (a window without any
   passes). A fixed-size filter of the shared symbols goes to the workers; what it lets through too
   much is only more to check.
4. Symbols reveal the repeat: a window is named by its interior symbols and the words before and behind them,
   which equal windows have in common. Windows come together by this name, sorted, and each
   is told the first place of the smallest id. Names that very many windows bear (fewer than ``HOT`` at a time,
   found in a sample that decides nothing else) are pre-aggregated instead, and their windows become stretches within each text.
5. Windows that follow each other in both texts make one stretch. Of the stretches of a text only those are kept that its words
   to be removed need, so that no word is in more than two; words that repeat within a passage, whose windows' first places
   go back and forth, would else make a stretch for every few words. The words of the stretch are fetched from the
   text of the smaller id and compared with those to be removed, word by word; a difference, which two
   windows of one 128-bit name would be, ends the job.

Defined results: a null or empty text has no words; texts of fewer words than the window keep all;
of repeated rows with one id neither is cut for the other's sake; ids decide, so the smallest id of
each repeat keeps its words; a row without an id keeps all, and takes none from others."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import bit_filter, join_hot, materialize, may_hold, small, tidy
from corpusloom.llm.words import BLOCK, chain, mix, split_words, window_names, word_names

WINDOW = 50
ROUNDS = 6
#: Symbols buffered before they are reduced to one row per name.
BUFFER = 1_000_000
#: One in so many texts is looked at to find hot names; a name is hot from so many windows of the sample, and one in HOT.
SAMPLE, HOT_LEAST, HOT = 64, 500, 2000
#: Words of the texts that are parsed together.
GROUP = BLOCK

_FAR = np.int64(1) << np.int64(40)  # what lies beyond a text's ends


class Parse:
    """Symbols of many texts, one after another: names, the words that they cover [start, end) and
    those that they depend on [low, high), as places in the joined texts, and the text of each."""

    def __init__(self, names: np.ndarray, begins: np.ndarray):
        lengths = np.diff(begins)
        n = names.shape[1]
        self.name = names
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.start = np.arange(n)
        self.low, self.high = self.start.copy(), self.start + 1
        self.end = self.high.copy()

    def _edges(self):
        """Whether a symbol is the first, the last of its text; what its neighbours depend on."""
        first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
        last = np.concatenate([first[1:], [True]])
        before = np.where(first, -_FAR, np.concatenate([[0], self.low[:-1]]))
        after = np.where(last, _FAR, np.concatenate([self.high[1:], [0]]))
        return first, last, before, after

    def _merge(self, head: np.ndarray, name: np.ndarray) -> None:
        """Symbols up to the next head become one; ``name`` of the heads."""
        at = np.flatnonzero(head)
        tail = np.append(at[1:], len(head)) - 1
        self.name, self.doc, self.start, self.end = name, self.doc[at], self.start[at], self.end[tail]
        self.low, self.high = np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at)

    def runs(self) -> None:
        if not len(self.doc):
            return
        first, last, before, after = self._edges()
        head = first | np.concatenate([[True], (self.name[:, 1:] != self.name[:, :-1]).any(0)])
        foot = np.concatenate([head[1:], [True]])
        self.low = np.where(head, np.minimum(self.low, before), self.low)  # where a run ends depends on what is next to it
        self.high = np.where(foot, np.maximum(self.high, after), self.high)
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(head)))
        name, long = self.name[:, at], size > 1
        name[:, long] = chain(name[:, long], np.stack([size[long], size[long]]).astype(np.uint64))
        self._merge(head, name)

    def pairs(self, coin: int) -> None:
        if not len(self.doc):
            return
        first, last, before, after = self._edges()
        left = (mix(self.name[0] ^ np.uint64(coin * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)) == 1
        joins = left & ~last & ~np.concatenate([left[1:], [True]])  # a left one before a right one
        joined = np.concatenate([[False], joins[:-1]])
        self.high = np.where(left & ~joins, np.maximum(self.high, after), self.high)
        self.low = np.where(~left & ~joined, np.minimum(self.low, before), self.low)
        head = ~joined
        at = np.flatnonzero(head)
        name, two = self.name[:, at], np.flatnonzero(joins[at])
        name[:, two] = chain(name[:, two], self.name[:, at[two] + 1])
        self._merge(head, name)


def recompress(names: np.ndarray, begins: np.ndarray, rounds: int = ROUNDS) -> Parse:
    """``names``: of the words of texts, one after another (2 lanes); ``begins``: where each begins, and the last ends."""
    parse = Parse(names, begins)
    for r in range(rounds):
        if r % 3 == 0:
            parse.runs()
        parse.pairs(r + 1)
    return parse


def _grouped(texts):
    """(first row, word lists) of consecutive rows of an Arrow column, of some ``GROUP`` words together."""
    start, group, held = 0, [], 0
    for i in range(len(texts)):
        group.append(split_words(texts[i].as_py()))
        held += len(group[-1])
        if held >= GROUP:
            yield start, group
            start, group, held = i + 1, [], 0
    if group:
        yield start, group


def _symbols(window: int):
    """Per task: symbols that a window can hold inside, with the smallest and largest id."""

    def run(batches):
        parts: list[tuple] = []

        def settle():
            name, low, high = (np.concatenate([p[i] for p in parts]) for i in range(3))
            by = np.argsort(name, kind="stable")
            name, low, high = name[by], low[by], high[by]
            at = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, int)
            return (name[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)) if len(at) else (name, low, high)

        def rows():
            name, low, high = settle()
            for i in range(0, len(name), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (name.view(np.int64), low, high)], names=["symbol", "low", "high"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)  # never null
            for start, group in _grouped(batch.column(1)):
                p = recompress(*word_names(group))
                fits = p.high - p.low <= window
                own = ids[start + p.doc[fits]]
                parts.append((p.name[0][fits], own, own))
            if sum(len(p[0]) for p in parts) > BUFFER:
                parts = [settle()]
                if len(parts[0][0]) > BUFFER // 2:
                    yield from rows()
                    parts = []
        if parts:
            yield from rows()

    return run


def _windows_to_check(n_words: int, low: np.ndarray, high: np.ndarray, known: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows of a text all of whose interior symbols are shared; ``low``, ``high`` and ``known`` of its symbols."""
    n = n_words - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    unknown = ~known & (high - low <= window)
    # an unshared symbol [a, b) rules out the windows that begin in [b - window, a]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.clip(high[unknown] - window, 0, n), 1)
    np.add.at(mark, np.clip(low[unknown] + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(mark)[:n] == 0)


def _chained(state: np.ndarray, names: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The states after the names [begin, end) of each."""
    for k in range(int((end - begin).max(initial=0))):
        on = np.flatnonzero(begin + k < end)
        state[:, on] = chain(state[:, on], names[:, begin[on] + k])
    return state


def interior(parse: Parse, low: int, high: int, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) interior symbol of each window of a text, whose symbols are [low, high)."""
    i = np.searchsorted(parse.low[low:high], starts, "left")
    return low + i, low + np.maximum(i, np.searchsorted(parse.high[low:high], starts + window, "right"))


def named_by_symbols(starts: np.ndarray, i: np.ndarray, j: np.ndarray, names: np.ndarray, parse: Parse, window: int) -> np.ndarray:
    """Names (2 lanes) of windows: of the interior symbols [i, j), the words before them and the words behind."""
    out = np.empty((2, len(starts)), np.uint64)
    for at in range(0, len(starts), BLOCK):
        begin, first, last = starts[at : at + BLOCK], i[at : at + BLOCK], j[at : at + BLOCK]
        end = begin + window
        some = last > first
        head = np.where(some, parse.start[np.minimum(first, len(parse.start) - 1)], end)
        tail = np.where(some, parse.end[last - 1], end)
        state = _chained(np.stack([last - first, head - begin]).astype(np.uint64), parse.name, first, last)
        state = _chained(state, names, begin, head)
        out[:, at : at + BLOCK] = _chained(state, names, tail, end)
    return out


_CHECK = "id long, doc_id long, n_words long, copied_words long, kept string, windows array<struct<at:int,a:long,b:long>>, text string"


def _candidates(shared, window: int):
    """Rows: id, doc_id, copied (whether the text is that of a smaller id), text."""

    def run(batches):
        words_filter = shared.value
        kind = pa.list_(pa.struct([("at", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            copied = batch.column(2).to_pylist()
            for first, group in _grouped(batch.column(3)):
                names, begins = word_names(group)
                parse = recompress(names, begins)
                known = may_hold(words_filter, parse.name[0])
                symbols = np.searchsorted(parse.doc, np.arange(len(group) + 1))
                kept, copies, places, inside, offsets = [], [], [], [], [0]
                for k, words in enumerate(group):
                    begin, low, high = int(begins[k]), int(symbols[k]), int(symbols[k + 1])
                    gone = copied[first + k] and len(words) >= window
                    at = np.zeros(0, np.int64)
                    if not copied[first + k]:
                        at = begin + _windows_to_check(len(words), parse.low[low:high] - begin, parse.high[low:high] - begin, known[low:high], window)
                    copies.append(len(words) if gone else 0)
                    kept.append(None if len(at) else hashlib.sha256(b"" if gone else b" ".join(words)).hexdigest())
                    places.append(at)
                    inside.append(interior(parse, low, high, at, window))
                    offsets.append(offsets[-1] + len(at))
                at, i, j = np.concatenate(places), *(np.concatenate([x[c] for x in inside]) for c in (0, 1))
                a, b = named_by_symbols(at, i, j, names, parse, window).view(np.int64)
                at = (at - np.repeat(begins[:-1], np.diff(offsets))).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(at), pa.array(a), pa.array(b)], names=["at", "a", "b"])).cast(kind)
                rows = slice(first, first + len(group))
                texts = [t if k is None else None for t, k in zip(batch.column(3)[rows].to_pylist(), kept, strict=True)]
                sizes = np.diff(begins)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(1)[rows], pa.array(sizes, pa.int64()), pa.array(copies, pa.int64()), pa.array(kept, pa.string()), found, pa.array(texts, pa.string())], names=["id", "doc_id", "n_words", "copied_words", "kept", "windows", "text"]
                )

    return run


_FOUND = "id long, at int, source long, source_at int"


def _first_places(batches):
    """Windows sorted by name, doc_id, id and place: those of other ids than the smallest of their name, with
    the first place of it."""
    name, doc, place = None, 0, (0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, docs, ids, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[0] = (a[0], b[0]) != name
        head = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        old = head < 0  # still of the name that the last batch ended with
        least, source, source_at = np.where(old, doc, docs[head]), np.where(old, place[0], ids[head]), np.where(old, place[1], at[head])
        name, doc, place = (a[-1], b[-1]), least[-1], (source[-1], source_at[-1])
        more = docs > least
        yield pa.RecordBatch.from_arrays([pa.array(ids[more]), pa.array(at[more]), pa.array(source[more]), pa.array(source_at[more].astype(np.int32))], names=["id", "at", "source", "source_at"])


def _hot_names(windows: DataFrame) -> list[int]:
    """Names (their first halves) that very many of the ``windows`` bear; fewer than HOT, or than HOT_LEAST windows of the sample allow."""
    seen = windows.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    names = seen.groupBy("a").count()
    total = names.agg(F.sum("count")).first()[0] or 0
    return [r[0] for r in names.filter(F.col("count") >= max(HOT_LEAST, total // HOT)).select("a").collect()]  # HOT at most


def _repeated(windows: DataFrame) -> DataFrame:
    """``windows``: a, b, doc_id, id, at. (id, at, source, source_at) of those that a smaller doc_id has too."""
    return windows.repartition("a", "b").sortWithinPartitions("a", "b", "doc_id", "id", "at").select("a", "b", "doc_id", "id", "at").mapInArrow(tidy(_first_places), _FOUND)


def _stretches(window: int):
    """Rows sorted by id and place: (id, at, size, source, source_at), windows that follow each other in both texts
    made one stretch of words, those that :func:`_needed` keeps. One that a batch ends is two stretches."""

    def run(batches):
        for batch in batches:
            ids, at, source, source_at = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4))
            if len(ids):
                yield _as_stretches(ids, at, source, source_at, window)

    return run


def _needed(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    """Stretches [start, end) that cover all words which those of their text (a number, ascending) cover. Starts and ends
    ascend within a text. The next is the last that leaves no word out, so the next but one shares no word with it."""
    lane = text << np.int64(32)  # texts lie one after another, apart
    follow = np.maximum(np.arange(len(text)) + 1, np.searchsorted(lane + start, lane + end, "right") - 1).tolist()
    out, k = [], 0
    while k < len(follow):
        out.append(k)
        k = follow[k]
    return out


def _as_stretches(ids: np.ndarray, at: np.ndarray, source: np.ndarray, source_at: np.ndarray, window: int) -> pa.RecordBatch:
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1) | (source_at[1:] != source_at[:-1] + 1)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(ids))) + window - 1
    text = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]))[head]
    need = _needed(text, at[head], at[head] + size)
    head, size = head[need], size[need]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[head], at[head], size, source[head], source_at[head])], names=["id", "at", "size", "source", "source_at"])


def _hot_stretches(shared, window: int):
    """Rows: id, doc_id, windows array<struct<at, a, b>>. Their stretches, as :func:`_stretches` makes them, by the first places of
    the names: ``shared`` has arrays a (ascending), b, doc_id, id, at."""

    def run(batches):
        a, b, least, source, source_at = shared.value
        for batch in batches:
            lists = batch.column(2)
            at, own_a, own_b = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            ids, docs = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in range(2))
            first, last = (np.searchsorted(a, own_a, side) for side in ("left", "right"))
            place = np.full(len(row), -1)
            for k in range(int((last - first).max(initial=0))):  # once, but for names that share a half
                on = np.flatnonzero(first + k < last)
                on = on[b[first[on] + k] == own_b[on]]
                place[on] = first[on] + k
            more = np.flatnonzero(place >= 0)
            more = more[docs[more] > least[place[more]]]
            if len(more):
                yield _as_stretches(ids[more], at[more].astype(np.int64), source[place[more]], source_at[place[more]], window)

    return run


def _stretches_of(checked: DataFrame, window: int) -> DataFrame:
    """``checked``: id, doc_id, windows. (id, at, size, source, source_at): words that a text has in common with that of a smaller
    doc_id. Windows of hot names are told their first places where they are, in arrays by text, since there are as many of them as
    the texts that share a passage hold, and few stretches: of either kind of names, two for each ``window`` words of a text at most,
    and one for each batch that a text ends or begins in."""
    schema = "id long, at long, size long, source long, source_at long"
    of = lambda df: df.select("id", "doc_id", F.explode("windows").alias("w")).select("w.a", "w.b", "doc_id", "id", "w.at")
    windows = of(checked)
    hot = _hot_names(windows)
    rest = windows.filter(~F.col("a").isin(hot)) if hot else windows
    found = _repeated(rest).repartition("id").sortWithinPartitions("id", "at").mapInArrow(tidy(_stretches(window)), schema)
    if not hot:
        return found
    some = checked.select("id", "doc_id", F.filter("windows", lambda w: w["a"].isin(hot)).alias("windows")).filter(F.size("windows") > 0)
    first = of(some).groupBy("a", "b").agg(F.min(F.struct("doc_id", "id", "at")).alias("f")).select("a", "b", "f.*").orderBy("a").toArrow()  # a row for each hot name
    shared = checked.sparkSession.sparkContext.broadcast([first[c].to_numpy().astype(np.int64) for c in ("a", "b", "doc_id", "id", "at")])
    return found.unionByName(some.mapInArrow(tidy(_hot_stretches(shared, window)), schema))


def _words_of_sources(batches):
    """Rows: source, text, wanted array<struct<source_at, size>>. The words of each stretch."""
    for batch in (b.slice(k, 1) for b in batches for k in range(b.num_rows)):
        words = split_words(batch.column(1)[0].as_py())
        out, held = [], 0
        for w in batch.column(2)[0].as_py():
            out.append((w["source_at"], w["size"], b" ".join(words[w["source_at"] : w["source_at"] + w["size"]])))
            held += len(out[-1][2])
            if held > 8_000_000:
                yield _batch_of(batch.column(0)[0].as_py(), out)
                out, held = [], 0
        yield _batch_of(batch.column(0)[0].as_py(), out)


def _batch_of(source: int, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([source] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode("utf-8", "surrogatepass") for r in rows], pa.string())], names=["source", "source_at", "size", "said"])


_DONE = "doc_id long, n_words long, n_removed long, kept_text string"


def _cut(batches):
    """Rows of an id come together: its text first, then the stretches to remove with the words that their
    source has. All of these must be the text's own."""
    now, words, gone = None, [], np.zeros(0, bool)

    def row():
        left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
        return now[1], len(words), int(gone.sum()), left.decode("utf-8", "surrogatepass")

    def batch_of(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "kept_text"])

    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        out = []
        for id_, doc_id, at, size, said in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if at is None:
                if now:
                    out.append(row())
                now, words = (id_, doc_id), split_words(said)
                gone = np.zeros(len(words), bool)
            elif words[at : at + size] != split_words(said):
                raise ValueError("two different windows have one name")
            else:
                gone[at : at + size] = True
        yield batch_of(out)
    if now:
        yield batch_of([row()])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``: doc_id, text. Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined
    by a space) and kept_text, null where nothing was removed."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    named = source.withColumn("whole", F.sha2(F.col("text").cast("binary"), 256))
    copies = named.filter("doc_id is not null").groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("whole", "least")
    copies = small(materialize(copies, "repeats-copies"))
    own = named.join(copies, "whole", "left").select("doc_id", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copied"), "text")

    symbols = own.filter("doc_id is not null and not copied").select("doc_id", "text").mapInArrow(tidy(_symbols(window)), "symbol long, low long, high long")
    shared = symbols.groupBy("symbol").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("symbol")
    filter_words = docs.sparkSession.sparkContext.broadcast(bit_filter(materialize(shared, "repeats-symbols"), "symbol"))  # 2**FILTER_BITS bits
    checked = own.select(F.monotonically_increasing_id().alias("id"), "doc_id", "copied", "text").mapInArrow(tidy(_candidates(filter_words, window)), _CHECK)
    checked = materialize(checked, "repeats-windows")

    stretches = materialize(_stretches_of(checked.filter("doc_id is not null").select("id", "doc_id", "windows"), window), "repeats-stretches")
    texts = checked.filter("text is not null").select("id", "doc_id", "text")
    wanted = stretches.groupBy("source").agg(F.collect_set(F.struct("source_at", "size")).alias("wanted"))
    said = texts.join(wanted, F.col("id") == F.col("source")).select("source", "text", "wanted").mapInArrow(tidy(_words_of_sources), "source long, source_at long, size long, said string")
    place = F.concat_ws(":", "source", "source_at", "size")
    said = materialize(said.withColumn("place", place).select("place", "said"), "repeats-words")
    gone = join_hot(stretches.withColumn("place", place), said, "place").select("id", F.lit(None).cast("long").alias("doc_id"), "at", "size", "said")
    rows = texts.select("id", "doc_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("size"), F.col("text").alias("said")).unionByName(gone)
    cut = rows.repartition("id").sortWithinPartitions("id", F.col("at").asc_nulls_first()).mapInArrow(tidy(_cut), _DONE)

    whole = F.col("copied_words")
    done = checked.filter("text is null").select("doc_id", "n_words", whole.alias("n_removed"), F.col("kept").alias("kept_sha256"), F.when(whole > 0, "").alias("kept_text"))
    some = cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.when(F.col("n_removed") > 0, F.col("kept_text")).alias("kept_text"))
    return done.unionByName(some)
