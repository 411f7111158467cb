"""Language-model scores by prediction by partial matching over bytes.

A trie of byte contexts up to ``ORDER`` is counted over all training texts. In a context, symbol s
has weight 2*count(s) - 1 and the escape the number of distinct symbols (method D). After an escape,
the symbols of the longer context are excluded from the shorter one. Below order 0 the symbols left
are equally likely. Byte 0xFF, which UTF-8 never holds, ends a text and fills the context at its
start, so that the probabilities of all texts sum to 1.

The trie is whole at every size: no edge is left out. It is dealt out by the last ``LOW`` + 1 bytes of
the context, so that a context and its suffixes down to that length lie together; the edges of shorter
contexts, 256 ** (LOW + 1) at most whatever the input, go to every worker. A text's score is a sum over
its edges. So the edges of the texts, each with the texts it occurs in, are sent to the range of the
trie that holds them, and each range returns its part of the sum of every text.

Because a symbol that follows a context also follows its suffixes, the excluded symbols depend on
the context alone. All escapes and exclusions are thus worked out per trie node, once, and scoring
is a few hash look-ups per distinct edge of a batch of texts.

The base score is a unigram model of words. Words that hold at least one in ``SHARE`` of the tokens
go to the workers; the others are counted by a join.

Defined results: a null text is empty; a repeated row is scored by itself and, if it is a training
row, learned as often as it is given; without training rows each byte has probability 1/256."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import materialize, tidy

ORDER = 5
SHARE = 1 << 20
END = 0xFF
#: Contexts up to this length are on every worker.
LOW = 2
#: Buffered edges before they are summed.
BUFFER = 3_000_000
#: Buckets that contexts are hashed to; ranges of the trie are of so many edges, and so many ranges at least.
BUCKETS, RANGE_EDGES, RANGES = 4096, 1_500_000, 24
#: Groups of buckets in which edges are counted.
COUNTED = 64
#: Bytes and texts whose edges are sent together; a text's number has 16 bits beside the 48 of an edge.
BATCH_BYTES, BATCH_TEXTS = 6_000_000, 1 << 16
#: Training bytes to a range from which its texts are dealt out to several tasks, each with the range's edges.
TASK_BYTES = 64_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def contexts(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of order+1 bytes (context and symbol) for each byte and end, and the number per text."""
    pad = bytes([END]) * order
    data = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(lengths + order)
    at = np.arange(len(data))
    inside = np.ones(len(data), bool)
    starts = ends - lengths - order
    for j in range(order):
        inside[starts + j] = False
    at = at[inside]
    keys = np.zeros(len(at), np.uint64)
    for j in range(order, -1, -1):
        keys = (keys << np.uint64(8)) | data[at - j]
    return keys, lengths


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class _Sum:
    """Counts per key, summed whenever the buffer is full."""

    def __init__(self):
        self.parts, self.size, self.total = [], 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def add(self, keys, counts):
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > BUFFER + len(self.total[0]):
            self.settle()

    def settle(self):
        parts = [self.total, *self.parts]
        self.total = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        self.parts, self.size = [], 0
        return self.total


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _bucket(keys: np.ndarray) -> np.ndarray:
    """The bucket of an edge of more than ``LOW`` bytes of context, by the last LOW + 1 of them."""
    return ((((keys >> np.uint64(8)) & np.uint64((1 << (8 * (LOW + 1))) - 1)) * _MIX) >> np.uint64(40)) % np.uint64(BUCKETS)


def _dealt(place: np.ndarray):
    """(place, the indices that belong there, in order), for each place that has some."""
    by = np.argsort(place.astype(np.uint16), kind="stable")
    own = place[by]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
    return [(int(own[i]), part) for i, part in zip(first, np.split(by, first[1:]), strict=False)]


def _masked(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a lower order: every place in a text has an edge of each."""
    return _summed(keys & np.uint64((1 << (8 * (order + 1))) - 1), counts)


_COUNTS = "kind int, place int, word binary, n long, keys binary, counts binary"
_COUNTS_ARROW = pa.schema([("kind", pa.int32()), ("place", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _count_texts(batches):
    """Per task: the count of each word (kind 0; the end of a text is the empty word), and sorted
    edges of order LOW (kind LOW + 1) and, by groups of buckets, of ORDER (kind ORDER + 1)."""
    words: Counter = Counter()
    edges = _Sum()

    def word_rows():
        items = list(words.items())
        words.clear()
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            nil, m = pa.nulls(len(part), pa.binary()), len(part)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array([0] * m, pa.int32()), pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64()), nil, nil], schema=_COUNTS_ARROW)

    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            texts = [lowered(t) for t in batch.column(0).slice(start, 1024).to_pylist()]
            for t in texts:
                words.update(t.split())
            words[b""] += len(texts)
            if len(words) > 400_000:
                yield from word_rows()
            keys, _ = contexts(texts)
            keys.sort()  # far faster than sorting keys with their counts
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            edges.add(keys[first], np.diff(np.append(first, len(keys))))
    yield from word_rows()
    keys, counts = edges.settle()
    low = _masked(keys, counts, LOW)
    for kind, (keys, counts), place in ((LOW + 1, low, np.zeros(len(low[0]), int)), (ORDER + 1, (keys, counts), _bucket(keys) % np.uint64(COUNTED))):
        for p, own in _dealt(place):
            yield pa.RecordBatch.from_pylist([{"kind": kind, "place": p, "word": None, "n": int(counts[own].sum()), "keys": _packed(keys[own]), "counts": _packed(counts[own].astype(np.uint64))}], schema=_COUNTS_ARROW)


def _packed(x: np.ndarray) -> bytes:
    """Differences of ascending keys (or counts as they are), compressed: few bytes each."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


_EDGES = "kind int, place int, n long, keys binary, counts binary"


def _sum_edges(batches):
    """Edges of each (order, group) summed, by buckets; n is their number."""
    here, own = None, _Sum()

    def rows():
        keys, counts = own.settle()
        for p, part in _dealt(_bucket(keys) if here[0] > LOW + 1 else np.zeros(len(keys), int)):
            yield pa.RecordBatch.from_pylist([{"kind": here[0], "place": p, "n": len(part), "keys": _packed(keys[part]), "counts": _packed(counts[part].astype(np.uint64))}], schema=pa.schema([("kind", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    for batch in batches:
        for kind, place, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (kind, place) != here:
                if here:
                    yield from rows()
                here, own = (kind, place), _Sum()
            own.add(_unpacked(keys), _unpacked(counts).astype(np.int64))
    if here:
        yield from rows()


class _Hash:
    """Open addressing over uint64 keys, all look-ups of a batch at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, ~np.uint64(0), np.uint64)
        self.values = np.zeros((1 << self.bits, values.shape[1]), np.float32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at[todo]] == ~np.uint64(0)
            place, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[place], self.values[place] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, at, -1)
        todo = np.flatnonzero((got != keys) & (got != ~np.uint64(0)))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (got != ~np.uint64(0))]
        return out


def _tagged(keys: np.ndarray, order: int) -> np.ndarray:
    return keys | np.uint64(order << 56)


class Model:
    """The trie with, per edge, log10 of its probability without exclusion and of its weight; per
    context, log10 of its escape without exclusion and, for its suffix with this context's symbols
    excluded, of the total weight and of the escape probability."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, n: np.ndarray, of: np.ndarray, order: int = ORDER):
        self.order, nodes, edges = order, [], []
        parent: dict | None = None
        self.left = math.log10(1 / 256)
        for k in range(order + 1):
            own = kind == k + 1
            by = np.argsort(key[own])
            keys, counts, of_k = key[own][by], n[own][by].astype(np.float64), of[own][by].astype(np.float64)
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, int)
            names, weight = context[first], 2 * counts - 1
            if not len(keys):
                break
            total = np.add.reduceat(weight, first)
            distinct = np.diff(np.append(first, len(keys))).astype(np.float64)
            kept = np.add.reduceat(counts, first)
            lost = 2 * (of_k[first] - kept)
            escape = distinct + lost
            number = np.repeat(np.arange(len(first)), distinct.astype(int))
            with np.errstate(divide="ignore"):
                value = np.stack([np.log10(weight / (total + escape)[number]), np.log10(weight)], 1)
                out = np.stack([np.log10(escape / (total + escape)), np.zeros(len(first)), np.zeros(len(first))], 1)
                if parent is None:
                    self.left = -math.log10(256 - distinct[0]) if distinct[0] < 256 else -np.inf
                else:
                    suffix = parent["find"](names & np.uint64((1 << (8 * (k - 1))) - 1 if k > 1 else 0))
                    shared = parent["weight"](keys & np.uint64((1 << (8 * k)) - 1))
                    rest = np.maximum(parent["total"][suffix] - np.add.reduceat(shared, first), 0)
                    new = np.maximum(parent["distinct"][suffix] - distinct, 0) + parent["lost"][suffix]
                    new = np.where(rest + new == 0, 1, new)
                    out[:, 1], out[:, 2] = np.log10(rest + new), np.log10(new / (rest + new))
            parent = {
                "find": lambda c, names=names: np.searchsorted(names, c), "weight": lambda e, keys=keys, weight=weight: weight[np.searchsorted(keys, e)],
                "total": total, "distinct": distinct, "lost": lost,
            }
            edges.append((_tagged(keys, k), value))
            nodes.append((_tagged(names, k), out))
        empty = [(np.zeros(0, np.uint64), np.zeros((0, 3)))]
        self.edges, self.nodes = (_Hash(np.concatenate([x[0] for x in t or empty]), np.concatenate([x[1] for x in t or empty])) for t in (edges, nodes))
        self.known = bool(edges)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after its context."""
        lp = np.zeros(len(keys))
        if not self.known:
            return lp - math.log10(256)
        todo, above = np.arange(len(keys)), np.full(len(keys), -1)
        for k in range(self.order, -1, -1):
            own = keys[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            edge, old = self.edges.find(_tagged(own, k)), above[todo]
            hit, fresh = edge >= 0, old < 0
            at = todo[hit & fresh]
            lp[at] += self.edges.values[edge[hit & fresh], 0]
            at = todo[hit & ~fresh]
            lp[at] += self.edges.values[edge[hit & ~fresh], 1] - self.nodes.values[old[hit & ~fresh], 1]
            todo, own, old = todo[~hit], own[~hit] >> np.uint64(8), old[~hit]
            if not len(todo):
                return lp
            node = self.nodes.find(_tagged(own, k))
            gone = old >= 0
            lp[todo[gone]] += self.nodes.values[old[gone], 2]
            begin = ~gone & (node >= 0)
            lp[todo[begin]] += self.nodes.values[node[begin], 0]
            above[todo] = node
        lp[todo] += self.left
        return lp


def train(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(word counts, edges of orders LOW and ORDER in packed buckets) of all rows of ``docs``."""
    counted = materialize(docs.select(F.col(text)).mapInArrow(tidy(_count_texts), _COUNTS), "ppm-counts")
    words = counted.filter("kind = 0").groupBy("word").agg(F.sum("n").alias("c"))
    blobs = counted.filter("kind > 0").select("kind", "place", "keys", "counts")
    edges = blobs.repartition(COUNTED, "kind", "place").sortWithinPartitions("kind", "place").mapInArrow(tidy(_sum_edges), _EDGES)
    return materialize(words, "ppm-words"), materialize(edges, "ppm-edges")


def _model(low: tuple[np.ndarray, np.ndarray], high: tuple[np.ndarray, np.ndarray]) -> Model:
    """The model of a range: the edges of order LOW of the whole trie, and those of ORDER of the range."""
    parts = [(k, *_masked(*(low if k <= LOW else high), k)) for k in range(ORDER + 1)]
    ofs = []
    for _, keys, counts in parts:
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, int)
        ofs.append(np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(keys)))) if len(keys) else counts)
    return Model(np.concatenate([np.full(len(keys), k + 1, np.int32) for k, keys, _ in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate(ofs))


def _cut(texts: list[bytes]):
    """(from, to) of the texts that are sent together."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > BATCH_BYTES or i - start == BATCH_TEXTS):
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield start, len(texts)


_ROW = "row struct<doc_id:long,held_out:boolean>, n_tokens long, n_known long, sum double, tail array<struct<w:binary,n:long>>"
#: part 0: the trie's edges of a range; 1: edges of a batch of texts, how often each occurs, and in which texts
#: (later ``texts`` is the range's part of each text's score); 2: the batch's rows, in ``texts``.
_SENT = "place int, part int, batch long, keys binary, counts binary, texts binary"
_TAIL_ARROW = pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())]))
_ROW_ARROW = pa.struct([("row", pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_())])), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("sum", pa.float64()), ("tail", _TAIL_ARROW)])
_SENT_ARROW = pa.schema([("place", pa.int32()), ("part", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())])
_SCORED = f"{_ROW}, score double"


def _sent(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f.name: values.get(f.name) for f in _SENT_ARROW}], schema=_SENT_ARROW)


def _squeezed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _released(b: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_texts(number: np.ndarray, n: np.ndarray) -> bytes:
    """The numbers of the texts of each edge, ascending: the first, then steps, those over 254 apart."""
    starts = np.cumsum(n) - n
    steps = np.diff(number, prepend=np.uint16(0))
    later = np.ones(len(steps), bool)
    later[starts] = False
    more = steps[later]
    parts = [_squeezed(number[starts]), _squeezed(np.minimum(more, 255).astype(np.uint8)), _squeezed(more[more >= 255])]
    return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts)


def _unpacked_texts(b: bytes, n: np.ndarray) -> np.ndarray:
    ends = 24 + np.cumsum(np.frombuffer(b[:24], np.int64))
    more = _released(b[ends[0] : ends[1]], np.uint8).astype(np.int64)
    more[more == 255] = _released(b[ends[1] :], np.uint16)
    starts = np.cumsum(n) - n
    steps = np.empty(n.sum(), np.int64)
    later = np.ones(len(steps), bool)
    later[starts] = False
    steps[starts], steps[later] = _released(b[24 : ends[0]], np.uint16), more
    whole = np.cumsum(steps)
    return whole - np.repeat(whole[starts] - steps[starts], n)


def _packed_rows(rows: list[dict]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema(list(_ROW_ARROW)), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(_ROW_ARROW))))
    return sink.getvalue().to_pybytes()


def _mixed(batch: int) -> int:
    return (batch >> 33) + batch % (1 << 33)


def _send(texts: list[bytes], batch: int, ranges: int, shares: int):
    """The edges of a batch of texts, by ranges."""
    keys, lengths = contexts(texts)
    both = (keys << np.uint64(16)) | np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    both.sort()
    keys, number = both >> np.uint64(16), both.astype(np.uint16)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, times = keys[first], np.diff(np.append(first, len(keys)))
    for p, own in _dealt(_bucket(keys) % np.uint64(ranges)):
        n = times[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield _sent(place=p * shares + _mixed(batch) % shares, part=1, batch=batch, keys=_packed(keys[own]), counts=_squeezed(n.astype(np.uint32)), texts=_packed_texts(number[at], n))


def _score_edges(low):
    """Of each range, the trie's edges come first, then those of the batches."""

    def run(batches):
        here, own, model = None, _Sum(), None
        for batch in batches:
            place, part = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                if part[i] == 2:
                    yield batch.slice(i, 1)
                    continue
                if place[i] != here:
                    here, own, model = place[i], _Sum(), None
                keys, counts = _unpacked(batch.column(3)[i].as_py()), batch.column(4)[i].as_py()
                if part[i] == 0:
                    own.add(keys, _unpacked(counts).astype(np.int64))
                    continue
                if model is None:
                    model = _model(low.value, own.settle())
                counts = _released(counts, np.uint32).astype(np.int64)
                number = _unpacked_texts(batch.column(5)[i].as_py(), counts)
                sums = np.bincount(number, np.repeat(model.score(keys), counts))
                yield _sent(place=here, part=1, batch=batch.column(2)[i].as_py(), texts=sums.tobytes())

    return run


def _add_up(batches):
    """Of each batch of texts, the ranges' parts come first, then its rows."""
    here, sums = None, np.zeros(0)
    for batch in batches:
        ids, part = batch.column(2).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            if ids[i] != here:
                here, sums = ids[i], np.zeros(0)
            if part[i] == 1:
                more = np.frombuffer(batch.column(5)[i].as_py())
                if len(more) > len(sums):
                    sums = np.append(sums, np.zeros(len(more) - len(sums)))
                sums[: len(more)] += more
                continue
            rows = pa.ipc.open_stream(batch.column(5)[i].as_py()).read_next_batch()
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sums)], names=["row", "n_tokens", "n_known", "sum", "tail", "score"])


def score_documents(docs: DataFrame, learn) -> DataFrame:
    """``docs``: doc_id, text. ``learn``: a boolean Column, the rows to learn from. One row per row of
    ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    words, edges = train(docs.filter(learn))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ranges = min(BUCKETS, max(RANGES, math.ceil((edges.filter(F.col("kind") > LOW + 1).agg(F.sum("n")).first()[0] or 0) / RANGE_EDGES)))
    got = edges.filter(F.col("kind") == LOW + 1).select("keys", "counts").toArrow().to_pylist()  # one row at most
    low = spark.sparkContext.broadcast(_summed(np.concatenate([np.zeros(0, np.uint64), *[_unpacked(r["keys"]) for r in got]]), np.concatenate([np.zeros(0, np.int64), *[_unpacked(r["counts"]).astype(np.int64) for r in got]])))
    shares = max(1, math.ceil(int(low.value[1].sum()) / (ranges * TASK_BYTES)))
    heavy_least = max(1, math.ceil(total / SHARE))
    heavy = words.filter(F.col("c") >= heavy_least).toArrow()  # SHARE rows at most
    counts = dict(zip(heavy["word"].to_pylist(), heavy["c"].to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast(counts)
    per = math.log10(total + 0.5 * (distinct + 1))

    def send(batches):
        logs = {w: math.log10(c + 0.5) - per for w, c in shared.value.items()}
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            all_texts = [lowered(t) for t in batch.column(2).to_pylist()]
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in _cut(all_texts):
                texts, rows = all_texts[start:end], []
                for t, doc_id, held_out in zip(texts, ids[start:end], held[start:end], strict=True):
                    own = t.split()
                    own.append(b"")
                    known = list(map(logs.get, own))
                    tail = Counter(w for w, x in zip(own, known, strict=True) if x is None)
                    rows.append({"row": {"doc_id": doc_id, "held_out": held_out}, "n_tokens": len(own), "n_known": len(own) - sum(tail.values()), "sum": math.fsum(x for x in known if x is not None), "tail": [{"w": w, "n": n} for w, n in tail.items()]})
                yield from _send(texts, number, ranges, shares)
                yield _sent(place=-1 - _mixed(number) % ranges, part=2, batch=number, texts=_packed_rows(rows))
                number += 1

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~learn, F.lit(True)).alias("held_out"), F.col("text"))
    nil = F.lit(None)
    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    trie = edges.filter(F.col("kind") > LOW + 1).select("*", share).select((F.col("place") % ranges * shares + F.col("share")).alias("place"), F.lit(0).alias("part"), nil.cast("long").alias("batch"), "keys", "counts", nil.cast("binary").alias("texts"))
    sent = trie.unionByName(source.mapInArrow(tidy(send), _SENT)).repartition(ranges * shares * 2, "place").sortWithinPartitions("place", "part")
    parts = sent.mapInArrow(tidy(_score_edges(low)), _SENT).repartition(ranges * shares * 2, "batch").sortWithinPartitions("batch", "part")
    scored = materialize(parts.mapInArrow(tidy(_add_up), _SCORED).withColumn("id", F.monotonically_increasing_id()), "ppm-scores")
    rare = words.filter(F.col("c") < heavy_least)
    tail = (
        scored.select("id", F.explode("tail").alias("t")).select("id", F.col("t.w").alias("word"), F.col("t.n").alias("n"))
        .join(rare, "word", "left")
        .groupBy("id")
        .agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * (F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5) - per)).alias("more"))
    )
    return scored.drop("tail").join(tail, "id", "left").select(
        "row.doc_id", "row.held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
