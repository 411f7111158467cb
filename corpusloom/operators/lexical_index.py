"""A stored index of terms for lexical search, and exact top-k that leaves out postings which cannot matter.

Three tables: ``texts`` (point_id, size, norm, terms), ``postings`` (term, point_id, size) and ``terms`` (term, how many texts have it,
the least size of one), the last two in directories by a hash of the term and sorted by it, so a search opens the directories of its
terms, and within their files Parquet's statistics leave out other terms. A term that a third of all texts has spans several files.

A text's score grows with each term that it shares with the query, by ``0.45 / q + 0.10 / sqrt(q * size)`` at most the same with the
term's least size. So the rarest terms of a query are looked up first; the k-th best of what these give is a score that has to be reached.
Common terms that together stay below it are not looked up, but for the texts that other terms or phrases have brought in and that can still
reach it. Phrases are found by terms that contain their longest word, and then looked for in the text."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions import text as T
from corpusloom.operators.retrieval import LEXICAL_QUERIES, QUERY_BYTES, phrase_weights, query_blocks, ranked
from corpusloom.sources.scratch import written

BUCKETS = 64
#: Postings that the first look at the rarest terms reads for each hit that is asked for.
FIRST_LOOK = 16
#: Scores are rounded to nine places; a bound must be lower by more than that to leave something out.
SLACK = 1e-8

_RUN = re.compile(r"[A-Za-z0-9_./:-]+|[ก-๙]+")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/texts").schema["point_id"].dataType.simpleString()
    columns = {"postings": f"point_id {kind}, size int, term string, bucket int", "terms": "term string, n long, least int, bucket int"}
    return spark.read.schema(columns[name]).parquet(f"{path}/{name}")


def build_lexical_index(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """``chunks``: point_id, text. Texts are cut into terms once, here."""
    norm = T.lexical_norm(F.coalesce("text", F.lit("")))
    own = chunks.select("point_id", F.inline(F.array(F.struct(norm.alias("norm"), T.tokens(norm).alias("own")))))  # a barrier: texts are cut once
    own = own.select("point_id", "norm", T.contentful(F.col("own")).alias("terms")).withColumn("size", F.size("terms"))
    own.write.parquet(f"{path}/texts")
    spark = chunks.sparkSession
    rows = spark.read.parquet(f"{path}/texts").select("point_id", "size", F.explode("terms").alias("term")).withColumn("bucket", _bucket(F.col("term"), buckets))
    order = ("bucket", "term", "size", "point_id")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/postings")
    terms = _read(spark, path, "postings").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"))
    terms.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")


def _score(n: Column, q_size: Column, size: Column, weight: Column) -> Column:
    overlap = F.when(q_size == 0, 0.0).otherwise(0.45 * n / F.greatest(q_size, F.lit(1)) + 0.10 * n / F.sqrt((q_size * F.greatest(size, F.lit(1))).cast("double")))
    return F.round(F.least(F.lit(1.0), overlap + weight), 9)


def anchor(phrase: str) -> str | None:
    """The longest word of a phrase that any text with the phrase must have a term around: of two characters at least, and in no
    stop word. None if there is none."""
    words = [w for w in _RUN.findall(phrase) if len(w) >= 2 and not any(w in s for s in rules.STOPWORDS)]
    return max(words, key=lambda w: (len(w), w), default=None)


class LexicalIndex:
    """An index that :func:`build_lexical_index` wrote. ``among``: a table of point_ids; the others are not there for a search."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, among: DataFrame | None = None):
        self.path, self.buckets = path, buckets
        self.texts, self.postings, self.terms = spark.read.parquet(f"{path}/texts"), _read(spark, path, "postings"), _read(spark, path, "terms")
        if among is not None:
            ids = written(among.select("point_id").distinct(), "among")
            self.texts, self.postings = (x.join(ids, "point_id", "left_semi") for x in (self.texts, self.postings))

    def of_terms(self, asked: DataFrame, known: list[int]) -> DataFrame:
        """The postings of a few (query_id, bucket, term), read from the directories ``known``."""
        return self.postings.filter(F.col("bucket").isin(known)).join(F.broadcast(asked), ["bucket", "term"])

    def _phrase_hits(self, block: DataFrame) -> DataFrame | None:
        """(query_id, point_id, size, weight) of texts that hold phrases of the queries."""
        weights = written(block.select("query_id", F.explode("q_phrases").alias("p")).groupBy("query_id", "p.phrase").agg(F.sum("p.weight").alias("weight")), "phrases")
        phrases = [r[0] for r in weights.select("phrase").distinct().collect()]  # of a block of queries
        if not phrases:
            return None
        anchors = {p: anchor(p) for p in phrases}
        rows = [(p, a, a != p or not re.search(r"[._/:]|--", p)) for p, a in anchors.items() if a]
        parts = []
        if rows:
            by = F.from_json(F.lit(json.dumps([{"phrase": p, "word": a, "check": c} for p, a, c in rows])), "array<struct<phrase:string,word:string,check:boolean>>")
            near = written(self.terms.select("bucket", "term", F.explode(F.filter(by, lambda x: F.contains(F.col("term"), x["word"]))).alias("x")).select("bucket", "term", "x.phrase", "x.check"), "phrase-terms")
            known = [r[0] for r in near.select("bucket").distinct().collect()]
            found = self.postings.filter(F.col("bucket").isin(known)).join(near, ["bucket", "term"]).select("phrase", "check", "point_id", "size").distinct()
            parts.append(found.filter("not check").select("phrase", "point_id", "size"))
            if any(c for _, _, c in rows):
                held = found.filter("check").select("phrase", "point_id").join(self.texts.select("point_id", "size", "norm"), "point_id")
                parts.append(held.filter(F.contains("norm", F.col("phrase"))).select("phrase", "point_id", "size"))
        if rest := [p for p, a in anchors.items() if not a]:  # no word to go by: each text is looked through
            all_of = F.from_json(F.lit(json.dumps(rest)), "array<string>")
            parts.append(self.texts.select(F.explode(F.filter(all_of, lambda p: F.contains(F.col("norm"), p))).alias("phrase"), "point_id", "size"))
        hits = reduce(DataFrame.unionByName, parts).join(F.broadcast(weights), "phrase")
        return written(hits.groupBy("query_id", "point_id").agg(F.max("size").alias("size"), F.sum("weight").alias("weight")), "phrase-hits")

    def plan_terms(self, block: DataFrame, k: int, phrase_hits: DataFrame | None) -> tuple[DataFrame, list[int]]:
        """For each query and term that the index knows: n, whether its postings must be read (``needed``), what the terms that
        need not be can add together (``rest``, and how many they are, ``left``), and the score to be reached (``theta``); the directories."""
        asked = block.select("query_id", F.size("q_terms").alias("q_size"), F.explode("q_terms").alias("term")).withColumn("bucket", _bucket(F.col("term"), self.buckets))
        known = sorted(r[0] for r in asked.select("bucket").distinct().collect())  # buckets are few
        stats = self.terms.filter(F.col("bucket").isin(known)).join(F.broadcast(asked), ["bucket", "term"])
        bound = 0.45 / F.col("q_size") + 0.10 / F.sqrt((F.col("q_size") * F.greatest("least", F.lit(1))).cast("double"))
        rare = Window.partitionBy("query_id").orderBy("n", "term").rowsBetween(Window.unboundedPreceding, -1)
        stats = written(stats.withColumns({"bound": bound, "first": F.coalesce(F.sum("n").over(rare), F.lit(0)) < FIRST_LOOK * k}), "terms-asked")
        looked = self.of_terms(stats.filter("first").select("query_id", "bucket", "term"), known).select("query_id", "point_id", "size", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("weight"))
        if phrase_hits is not None:
            looked = looked.unionByName(phrase_hits.withColumn("n", F.lit(0).cast("long")))
        looked = looked.groupBy("query_id", "point_id").agg(F.max("size").alias("size"), F.sum("n").alias("n"), F.sum("weight").alias("weight")).join(F.broadcast(block.select("query_id", F.size("q_terms").alias("q_size"))), "query_id")
        low = looked.select("query_id", "point_id", _score(F.col("n").cast("double"), F.col("q_size"), F.col("size"), F.col("weight")).alias("score"))
        theta = ranked(low, k, F.desc("score"), F.asc("point_id")).filter(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))
        common = Window.partitionBy("query_id").orderBy(F.desc("n"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
        planned = stats.join(F.broadcast(theta), "query_id", "left").withColumn("needed", F.coalesce(F.sum("bound").over(common) >= F.col("theta") - SLACK, F.lit(True)))
        return written(planned.select("query_id", "q_size", "bucket", "term", "n", "bound", "needed", "theta"), "terms-planned"), known

    def _found(self, block: DataFrame, k: int) -> DataFrame:
        block = written(block, "queries")
        phrase_hits = self._phrase_hits(block)
        terms, known = self.plan_terms(block, k, phrase_hits)
        pairs = self.of_terms(terms.filter("needed").select("query_id", "bucket", "term"), known).select("query_id", "point_id", "size", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("weight"))
        if phrase_hits is not None:
            pairs = pairs.unionByName(phrase_hits.withColumn("n", F.lit(0).cast("long")))
        pairs = pairs.groupBy("query_id", "point_id").agg(F.max("size").alias("size"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
        left = terms.groupBy("query_id").agg(F.count_if(~F.col("needed")).alias("left"), F.max("theta").alias("theta"))
        sizes = block.select("query_id", F.size("q_terms").alias("q_size")).join(left, "query_id", "left")
        pairs = pairs.join(F.broadcast(sizes), "query_id")
        most = _score((F.col("n") + F.coalesce("left", F.lit(0))).cast("double"), F.col("q_size"), F.col("size"), F.col("weight"))
        pairs = written(pairs.filter(F.coalesce(most >= F.col("theta") - SLACK, F.lit(True))), "candidates")
        more = self.of_terms(terms.filter("not needed").select("query_id", "bucket", "term"), known).select("query_id", "point_id")
        ids = pairs.filter("left > 0").select("query_id", "point_id")
        few = ids.count() * 32 <= QUERY_BYTES
        more = more.join(F.broadcast(ids) if few else ids, ["query_id", "point_id"], "left_semi").groupBy("query_id", "point_id").agg(F.count(F.lit(1)).alias("more"))
        pairs = pairs.join(more, ["query_id", "point_id"], "left").withColumn("matched", F.col("n") + F.coalesce("more", F.lit(0)))
        score = _score(F.col("matched").cast("double"), F.col("q_size"), F.col("size"), F.col("weight"))
        hits = pairs.select("query_id", "point_id", score.alias("score"), "matched").filter("score > 0")
        return ranked(hits, k, F.desc("score"), F.desc("matched"), F.asc("point_id"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``queries``: query_id, query. The rows that :func:`retrieval.lexical_search` over the texts gives."""
        cut = queries.select("query_id", T.contentful(T.tokens(T.lexical_norm(F.coalesce("query", F.lit(""))))).alias("q_terms"), phrase_weights(F.coalesce("query", F.lit(""))).alias("q_phrases"))
        return reduce(DataFrame.unionByName, [self._found(block, k) for block in query_blocks(cut, LEXICAL_QUERIES)])
