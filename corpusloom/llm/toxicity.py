"""Toxic passages by maximum-scoring segment search, with extreme-value calibration.

1. Each token, and each beginning of ``STEM`` letters, gets the log-odds of toxic against clean
   labelled texts (a text counts each once), under a Dirichlet prior that the counts of both
   together inform; where the log-likelihood ratio of the counts is small, odds count as none. A
   token without odds of its own has those of its beginning.
2. A text is a sequence of token scores, each less a drift so that clean text sinks. All maximal
   scoring segments are found in one linear scan.
3. By extreme-value theory the best segment of a clean text of m tokens exceeds s with probability
   1 - exp(-K m exp(-lambda s)), where lambda solves E[exp(lambda * score)] = 1 over clean tokens and K is the
   likeliest for the best segments of clean labelled texts that gave no odds. What
   segments say is summed up as -log of these probabilities, and a logistic curve, fitted on
   labelled texts that gave no odds, makes that the probability of label 1.

The classifier is fitted on a bounded sample: at most ``MAX_LABELS`` labelled rows, in the order of a
hash of their ids; half of them (by another hash) give the odds and half the curve. Every term of that sample
whose ratio is large enough gets odds. All texts are scored, as a whole.

Defined results: a null or empty text has no segment and gets the score of a text without evidence;
labels that are null, or of unknown documents, are ignored; a document labelled twice is toxic if
one label says so; without labels of both classes, the score is the share of toxic labels (or 0). Repeated rows get
equal scores, each its own row; a null doc_id is scored by its text, and is no training row."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import tidy

MAX_LABELS = 65_536
#: Words kept by a worker, as a memo or to be counted together.
MEMO = 150_000
#: What the prior is worth, as a share of the counts; least likelihood ratio (G) of odds; drift per
#: token; K of the extreme values where no clean text tells it; letters of a beginning.
PRIOR, LEAST_G, DRIFT, K, STEM = 0.05, 22.0, 0.15, 0.1, 5
THRESHOLD = 0.3

_EDGES = bytes(b for b in range(128) if not chr(b).isalnum())


def token(word: bytes) -> bytes:
    return word.strip(_EDGES)


def stem(term: bytes) -> bytes:
    """The beginning of a term, marked by a byte that no term has; empty for short terms."""
    letters = term.decode("utf-8", "replace")
    return b"\xff" + letters[:STEM].encode() if len(letters) > STEM else b""


def terms_of(words: list[bytes]) -> set[bytes]:
    own = set(map(token, words))
    own.update([*map(stem, own)])
    own.discard(b"")
    return own


@dataclass(frozen=True)
class Model:
    """odds: of the terms that have any; unseen: the score of other tokens; curve: of the evidence."""

    odds: dict[bytes, float]
    unseen: float
    scale: float  # lambda
    curve: tuple[float, float]
    k: float = K


class _Scores(dict):
    """Token scores by raw word."""

    def __init__(self, odds: dict[bytes, float], unseen: float):
        super().__init__()
        self.odds, self.unseen = odds, unseen

    def __missing__(self, word: bytes) -> float | None:
        if len(self) > MEMO:
            self.clear()
        term = token(word)
        x = self.odds.get(term, self.odds.get(stem(term)))
        self[word] = x = None if x is None else x + self.unseen
        return x


def segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of consecutive items (start, end, score), in linear time. Candidates
    stand in order, each with the sums before and after it and the number of the last candidate with a smaller sum
    before, so that none of those between is looked at again; a new one takes in what it completes."""
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, number of the last lower one
    total = 0.0
    for start, end, x in scores:
        before, total = total, total + x
        if x <= 0:
            continue
        left, low = start, before
        at = len(stack) - 1
        while at >= 0 and stack[at][2] >= low:
            at = stack[at][4]
        while at >= 0 and stack[at][3] < total:
            left, _, low, _, lower = stack[at]
            del stack[at:]
            at = lower
        stack.append((left, end, low, total, at))
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def _segments_of(words: list[bytes], scores: _Scores) -> list[tuple[int, int, float]]:
    """Maximal segments of a text; words without a score of their own count together, between those with one."""
    items, last = [], 0
    for i, x in enumerate(map(scores.__getitem__, words)):
        if x is not None:
            if i > last:
                items.append((last, i, (i - last) * scores.unseen))
            items.append((i, i + 1, x))
            last = i + 1
    return segments(items)


def evidence(words: list[bytes], scores: _Scores, scale: float, k: float = K) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of -log probabilities of the segments under clean text, and the significant segments (word
    start, end, -log probability)."""
    total, out = 0.0, []
    for a, b, s in _segments_of(words, scores):
        log_e = math.log(k * len(words)) - scale * s  # log of the expected number of such segments
        rare = -math.log(-math.expm1(-math.exp(log_e))) if log_e > -30 else -log_e
        if rare > 1:
            total += rare
            out.append((a, b, rare))
    return total, out


def _labelled(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame | None:
    """docs with ``toxic`` and ``half`` for the sampled labels; the sample is small and bounded."""
    spark = docs.sparkSession
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    rows = rows.filter(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS).toArrow()
    if not sample.num_rows:
        return None
    small = spark.createDataFrame(sample).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(small), "doc_id")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count(batches):
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def rows():
        for toxic, own in counts.items():
            items = list(own.items())
            own.clear()
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([toxic] * len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())], names=["term", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[int(toxic == 1)].update(terms_of(_words(text)))
        if sum(map(len, counts.values())) > MEMO:
            yield from rows()
    yield from rows()


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """``learn``: a Column on doc_id of the rows whose labels may be used."""
    known = _labelled(docs, labels, learn)
    empty = Model({}, -DRIFT, 1.0, (-20.0, 0.0))
    if known is None:
        return empty
    counts = known.filter("half = 0").select("text", "toxic").mapInArrow(tidy(_count), "term binary, toxic int, n long")
    counts = counts.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("y0")).filter("y1 + y0 > 1 ")
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("y1"), F.sum("y0")).first())
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    if not n1 or not n0:
        return Model({}, -DRIFT, 1.0, (_logit(share), 0.0))
    a = (F.col("y1") + F.col("y0")) * PRIOR
    prior = PRIOR * (n1 + n0)
    p1, p0 = F.col("y1") + a, F.col("y0") + a
    odds = F.log(p1 / (n1 + prior - p1)) - F.log(p0 / (n0 + prior - p0))
    def part(y, n):  # of G: y log(observed / expected), 0 for none
        return F.when(y > 0, y * F.log(y * (n1 + n0) / ((F.col("y1") + F.col("y0")) * n))).otherwise(0.0)

    terms = (
        counts.select("term", odds.alias("odds"), (2 * (part(F.col("y1"), n1) + part(F.col("y0"), n0))).alias("g"), (F.col("y0") / n0).alias("clean"))
        .filter(F.col("g") >= LEAST_G)
        .toArrow()  # terms of the bounded sample
    )
    weights = terms["odds"].to_numpy()
    scale = _lambda(weights - DRIFT, np.maximum(terms["clean"].to_numpy(), 0.5 / n0), -DRIFT)
    own = dict(zip(terms["term"].to_pylist(), weights.tolist(), strict=True))
    k = fitted_k(known.filter("half = 1 and toxic = 0"), own, scale)
    model = Model(own, -DRIFT, scale, (0.0, 0.0), k)
    seen = score_documents(known.filter("half = 1"), model, keep=("toxic",)).select("toxic", "evidence").toArrow()
    return Model(model.odds, model.unseen, scale, _logistic(seen["evidence"].to_numpy(), (seen["toxic"].to_numpy() == 1).astype(float)), k)


def fitted_k(clean: DataFrame, odds: dict[bytes, float], scale: float) -> float:
    """K of the extreme values by maximum likelihood over clean texts: their number over the sum of m exp(-lambda s), s
    being the best segment of m tokens."""
    shared = clean.sparkSession.sparkContext.broadcast(odds)

    def run(batches):
        scores = _Scores(shared.value, -DRIFT)
        for batch in batches:
            n, total = 0, 0.0
            for words in filter(None, map(_words, batch.column(0).to_pylist())):
                n += 1
                total += len(words) * math.exp(-scale * max((s for _, _, s in _segments_of(words, scores)), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    n, total = clean.select("text").mapInArrow(tidy(run), "n long, total double").agg(F.sum("n"), F.sum("total")).first()
    return n / total if total else K


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def _lambda(scores: np.ndarray, shares: np.ndarray, rest: float) -> float:
    """The positive root of sum p exp(x s) = 1, by bisection; 1 where there is none."""
    left = max(0.0, 1 - shares.sum())
    if not len(scores) or scores.max() <= 0:
        return 1.0

    def over(x: float) -> bool:
        return float(np.sum(shares * np.exp(np.minimum(x * scores, 500)))) + left * math.exp(x * rest) > 1

    low, high = 1e-6, 1.0
    if over(low):
        return 1.0
    while not over(high):
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope, by Newton steps with a little ridge; x is dampened by a logarithm."""
    x = np.log1p(x)
    w = np.zeros(2)
    design = np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -5, 5)
    return float(w[0]), max(0.0, float(w[1]))


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``evidence``, ``score`` (0 to 1) and ``passages`` array<struct<start,end,rarity>> in
    words. Narrow: no shuffle."""
    source = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    passages = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rarity", pa.float64())]))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("__text").schema)
    schema = f"{columns}, evidence double, score double, passages array<struct<start:long,end:long,rarity:double>>"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of the bounded sample

    def run(batches):
        own = shared.value
        scores = _Scores(own.odds, own.unseen)
        a, b = own.curve
        for batch in batches:
            got = [evidence(_words(t), scores, own.scale, own.k) for t in batch.column(batch.num_columns - 1).to_pylist()]
            total = np.array([x for x, _ in got])
            lists = pa.array([[{"start": i, "end": j, "rarity": r} for i, j, r in s] for _, s in got], passages)
            score = 1 / (1 + np.exp(-(a + b * np.log1p(total))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total, pa.float64()), pa.array(score, pa.float64()), lists], names=[*batch.schema.names[:-1], "evidence", "score", "passages"])

    return source.mapInArrow(tidy(run), schema)


def trained_rows(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2
