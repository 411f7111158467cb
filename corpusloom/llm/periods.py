"""Periodic runs of words, by string synchronising sets.

A run is a stretch of words with smallest period q, of ``max(LEAST, TIMES * q)`` words at least, that cannot be extended.

* Periods up to ``DIRECT`` are found by comparing each text with itself, shifted.
* For periods in (c/2, c], c = 16, 32, 64 and so on, positions are selected at scale c: of each c/2 positions in
  a row the one whose context, the c words from there on, has the least hash. Contexts that lie within a run of a
  period of c/4 at most, which the earlier scales have found, are left out, so that few positions are selected whatever the text; Fine and
  Wilf's theorem says that a run of a period beyond c/2 still has one in each c/2. What is selected depends on
  words nearby alone, so a run's position p and p + q are both selected; their contexts are equal, and none between is. So the
  distance of a selected position and the last one with an equal context proposes the period.
* A proposed period is extended both ways, word by word, and kept if the stretch is long enough and has no smaller period.

A proposal stands for a repetition of a word sequence, and a stretch already found for the same period isn't extended again, so the work
stays near the number of words times its logarithm. Contexts are compared by 64-bit hashes; runs by words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import let, numbers
from corpusloom.llm.store import only, tidy
from corpusloom.llm.suffixes import least_places
from corpusloom.llm.words import BLOCK, Lexicon, mix, numbered, split_words

LEAST, TIMES = 6, 4
DIRECT = 8

_AT, _STEP = (1 << 28) - 1, np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.uint64).max


def _primes(q: int) -> list[int]:
    return [d for d in range(2, q + 1) if q % d == 0 and all(d % k for k in range(2, int(d**0.5) + 1))]


def _has_period(words: np.ndarray, start: int, end: int, d: int) -> bool:
    return bool((words[start : end - d] == words[start + d : end]).all())


def _extended(words: np.ndarray, low: int, high: int, at: int, q: int) -> tuple[int, int]:
    """The maximal stretch of period q within [low, high) that contains ``at`` and ``at + q``."""
    start, end, step = at, at + q, 64
    while start > low:
        k = min(step, start - low)
        differ = np.flatnonzero(words[start - k : start] != words[start - k + q : start + q])
        if len(differ):
            start += int(differ[-1]) + 1 - k
            break
        start, step = start - k, step * 2
    step = 64
    while end < high:
        k = min(step, high - end)
        differ = np.flatnonzero(words[end : end + k] != words[end - q : end - q + k])
        if len(differ):
            end += int(differ[0])
            break
        end, step = end + k, step * 2
    return start, end


def _long_enough(words: np.ndarray, start: int, end: int, q: int) -> bool:
    return end - start >= max(LEAST, TIMES * q) and not any(_has_period(words, start, end, q // f) for f in _primes(q))


def _direct(words: np.ndarray, ends: np.ndarray, q: int):
    """Stretches (start, end) of period q, long enough to be runs; ``ends``: where the text of each word ends."""
    n = len(words) - q
    if n <= 0:
        return
    breaks = np.flatnonzero((words[:n] != words[q:]) | (np.arange(q, n + q) >= ends[:n]))
    edges = np.concatenate([[-1], breaks, [n]])
    for k in np.flatnonzero(np.diff(edges) - 1 >= max(LEAST, TIMES * q) - q).tolist():
        yield int(edges[k]) + 1, int(edges[k + 1]) + q


def find_runs(words: np.ndarray, names: np.ndarray, begins: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start and period. ``words``: numbers of the words of texts that stand one
    after another, equal for equal words; ``names``: their hashes; ``begins``: where each text begins, and the last ends."""
    lengths = np.diff(begins)
    found: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    ends = np.repeat(begins[1:], lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    for q in range(1, DIRECT + 1):
        for start, end in _direct(words, ends, q):
            if _long_enough(words, start, end, q):
                found[doc[start]].append((start - int(begins[doc[start]]), end - start, q))

    own, start = np.arange(len(lengths)), begins[:-1].astype(np.int64)  # the texts that are left, and where they begin in what is left
    name, at, size = names.copy(), np.arange(len(words)), 1  # of what is left: names of contexts of ``size``, places among all words
    c = 2 * DIRECT
    while True:
        keep = lengths[own] >= TIMES * (c // 2 + 1)
        if not keep.any():
            break
        if not keep.all():
            some = np.repeat(keep, lengths[own])
            name, at, own = name[some], at[some], own[keep]
            start = np.cumsum(lengths[own]) - lengths[own]
        while size < c:  # past a text's end the names mix texts; such contexts aren't looked at
            name = name * _STEP + np.concatenate([name[size:], np.zeros(min(size, len(name)), np.uint64)])
            name ^= name >> np.uint64(29)
            size *= 2
        _at_scale(c, words, begins, lengths, own, start, mix(name), at, found)
        c *= 2
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def _at_scale(c: int, words, begins, lengths, own, start, name, at, found) -> None:
    width = c // 2
    tail = np.repeat(start + lengths[own], lengths[own])
    out = np.arange(c, len(name) + c) > tail  # the context would end beyond the text
    marks = np.zeros(len(name) + 1, np.int64)
    for text, first in zip(own.tolist(), start.tolist(), strict=True):
        for s, length, q in found[text]:
            if 4 * q <= c <= length:
                marks[first + s] += 1
                marks[first + s + length - c + 1] -= 1
    out |= np.cumsum(marks[:-1]) > 0
    key = np.where(out, _NONE, (name & ~np.uint64(_AT)) | np.arange(len(name), dtype=np.uint64))
    least = least_places(key, width)
    least = least[least != _NONE]
    picked = np.unique((least & np.uint64(_AT)).astype(np.int64))
    text = np.searchsorted(start, picked, "right") - 1
    same = name[picked] + text.astype(np.uint64) * _STEP
    order = np.argsort(same, kind="stable")
    a, b = picked[order[:-1]], picked[order[1:]]
    pair = (same[order[:-1]] == same[order[1:]]) & (text[order[:-1]] == text[order[1:]]) & (b - a > width) & (b - a <= c)
    proposals = sorted(zip(text[order[:-1]][pair].tolist(), (b - a)[pair].tolist(), at[a[pair]].tolist(), strict=True))
    last = (-1, 0, 0)
    for t, q, p in proposals:
        if (t, q) == last[:2] and p + q < last[2]:
            continue
        low = int(begins[own[t]])
        s, e = _extended(words, low, low + int(lengths[own[t]]), p, q)
        last = (t, q, e)
        if _long_enough(words, s, e, q):
            found[own[t]].append((s - low, e - s, q))


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _runs_of_texts(batches):
    """Rows: doc_id, text. Groups of texts of some ``BLOCK`` words are worked on together."""
    lexicon = Lexicon()
    for batch in batches:
        first = 0
        while first < batch.num_rows:
            group, held, k = [], 0, first
            while k < batch.num_rows and held < BLOCK:
                group.append(split_words(batch.column(1)[k].as_py()))
                held += len(group[-1])
                k += 1
            words, names, begins = numbered(group, lexicon)
            runs = find_runs(words, names[0], begins)
            collapsed, hashes = [], []
            for own, found in zip(group, runs, strict=True):
                gone = np.zeros(len(own), bool)
                for s, length, q in found:
                    gone[s + q : s + length] = True
                kept = b" ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g) if found else b" ".join(own)
                collapsed.append(kept.decode("utf-8", "surrogatepass") if found else None)
                hashes.append(hashlib.sha256(kept).hexdigest())
            found = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in runs]
            sizes = np.diff(begins)
            yield pa.RecordBatch.from_arrays([batch.column(0)[first:k], pa.array(sizes, pa.int64()), pa.array(found, _RUN), pa.array(collapsed, pa.string()), pa.array(hashes)], names=["doc_id", "n_words", "runs", "collapsed", "collapsed_sha256"])
            if lexicon.full():
                lexicon = Lexicon()
            first = k


def detect_runs(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, text. Per row: doc_id, n_words, runs (start, length and period in words, by start and period), collapsed (the
    words without those that a run contains after its first period; null where there is no run) and collapsed_sha256.

    Defined results: a null or empty text has no words and no runs; rows that are equal, or share an id, are told apart as rows; a null id
    stays null; other columns of ``docs`` are not looked at, whatever their names; an empty table gives none. Each row is worked on alone, by one task, with memory in
    proportion to its text; nothing is shuffled."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(tidy(_runs_of_texts), f"doc_id {id_kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string, collapsed_sha256 string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, with a periodic end in those whose crc32 of the id is divisible by ten: words from a on repeat the p words from a, for
    a and p that the same number gives."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.transform(numbers(n - a, 0), lambda i: F.element_at(words, a + i % p + 1))), " ")

    text = let(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda words: F.when(F.size(words) > 0, changed(words)).otherwise(""))
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    best = F.aggregate("runs", F.element_at("runs", 1), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )
