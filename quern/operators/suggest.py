"""Spelling suggestions: candidates by shared trigrams, then by prefix, ranked by edit distance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import analysis
from quern.operators.index import Index
from quern.plans.parser import tokenize

PENALTY = 3


def _ranked(candidates: DataFrame, ascii_query: str, scripts: list[str], max_distance: int) -> DataFrame:
    """(word, doc_count, score): edit distance of the ASCII forms, 3 more for a word in other scripts; never the word itself."""
    distance = F.levenshtein(F.lit(ascii_query), F.col("ascii_word"), max_distance)
    own = F.array(*[F.lit(s) for s in scripts])
    score = distance + F.when(F.arrays_overlap(own, analysis.scripts(F.col("word"))), 0).otherwise(PENALTY)
    return candidates.where((F.length("word") >= 2) & distance.between(1, max_distance)).select("word", "doc_count", score.alias("score"))


def shared_trigrams(tri: DataFrame, ascii_query: str) -> DataFrame:
    """(word, ascii_word, shared, doc_count, avg_docs) of the words that share at least two trigrams with the query."""
    wanted = analysis.trigrams_py(ascii_query)
    shared = tri.where(F.col("trigram").isin(wanted)).groupBy("word", "ascii_word").agg(F.count("*").alias("shared"), F.max("doc_count").alias("doc_count"), F.avg("doc_count").alias("avg_docs"))
    return shared.where(F.col("shared") >= min(2, len(wanted)))


def trigram_candidates(tri: DataFrame, ascii_query: str, limit: int | None = None) -> DataFrame:
    """(word, ascii_word, doc_count) of words that share at least two trigrams with the query; the most frequent 3 * limit."""
    found = shared_trigrams(tri, ascii_query).select("word", "ascii_word", "doc_count")
    return found.orderBy(F.desc("doc_count"), "word").limit(3 * limit) if limit else found


def prefix_candidates(vocab: DataFrame, ascii_query: str, limit: int | None = None) -> DataFrame:
    """(word, ascii_word, doc_count) of words that begin with the query's first two letters; the most frequent ``limit``."""
    found = vocab.where(F.startswith("ascii_word", F.lit(ascii_query[:2]))).select("word", "ascii_word", "doc_count")
    return found.orderBy(F.desc("doc_count"), "word").limit(limit) if limit else found


@dataclass(frozen=True)
class Hooks:
    """What an application may put in place of a step: candidates (index, ASCII query) -> (word, ascii_word, doc_count)."""

    trigram: Callable[[Index, str], DataFrame] = lambda index, q: trigram_candidates(index.table("vocab_tri"), q)
    prefix: Callable[[Index, str], DataFrame] = lambda index, q: prefix_candidates(index.table("vocab"), q, index.config.vocab_limit)
    before: Callable[[str], str] = lambda query: query
    after: Callable[[DataFrame], DataFrame] = lambda found: found


def suggest_term(index: Index, query: str, max_distance: int = 2, limit: int = 5, hooks: Hooks = Hooks()) -> DataFrame:
    """(word, phase, score, doc_count), best first: trigram candidates before prefix candidates."""
    spark = index.rows.sparkSession
    query = hooks.before(query)
    if len(query.strip()) < 2:
        return spark.createDataFrame([], "word string, phase int, score int, doc_count long")
    ascii_query, scripts = analysis.transliterate_py(query), analysis.scripts_py(query)
    one = _ranked(hooks.trigram(index, ascii_query), ascii_query, scripts, max_distance).withColumn("phase", F.lit(1))
    two = _ranked(hooks.prefix(index, ascii_query), ascii_query, scripts, max_distance).withColumn("phase", F.lit(2))
    best = one.unionByName(two).groupBy("word").agg(F.min("phase").alias("phase"), F.min("score").alias("score"), F.max("doc_count").alias("doc_count"))
    return hooks.after(best).orderBy("phase", "score", F.desc("doc_count"), "word").limit(limit)


def did_you_mean(index: Index, query: str, max_distance: int = 2, limit: int = 5) -> list[str]:
    """Suggestions for each word of a query, merged, distinct, ``limit`` at most (a handful of rows)."""
    max_distance, limit = max(1, min(max_distance, 5)), max(1, min(limit, 20))
    out: list[str] = []
    for term in tokenize(query):
        if term.upper() not in ("AND", "OR", "NOT", "NEAR"):
            out += [r["word"] for r in suggest_term(index, term.strip('"*'), max_distance, limit).collect()]
    return list(dict.fromkeys(out))[:limit]


def suggest_many(vocab: DataFrame, queries: DataFrame, max_distance: int = 2, limit: int = 5) -> DataFrame:
    """(query, place, word, score) for a table of misspelt words: one equi-join on trigrams, no loop.

    vocab: (word, ascii_word, doc_count).  Candidates share at least two trigrams with the query.
    """
    asked = queries.select(F.col(queries.columns[0]).alias("query")).distinct().withColumn("ascii_query", analysis.transliterate(F.col("query")))
    left = asked.select("query", "ascii_query", F.explode(analysis.trigrams(F.col("ascii_query"))).alias("trigram"))
    right = vocab.select("word", "ascii_word", "doc_count", F.explode(analysis.trigrams(F.col("ascii_word"))).alias("trigram"))
    shared = left.join(right, "trigram").groupBy("query", "ascii_query", "word", "ascii_word").agg(F.count("*").alias("n"), F.max("doc_count").alias("doc_count"))
    distance = F.levenshtein("ascii_query", "ascii_word", max_distance)
    same = F.arrays_overlap(analysis.scripts(F.col("query")), analysis.scripts(F.col("word")))
    scored = shared.where((F.col("n") >= 2) & distance.between(1, max_distance)).select("query", "word", "doc_count", (distance + F.when(same, 0).otherwise(PENALTY)).alias("score"))
    w = Window.partitionBy("query").orderBy("score", F.desc("doc_count"), "word")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query", "place", "word", "score")
