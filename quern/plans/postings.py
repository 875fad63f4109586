"""Parsed queries over postings: terms are found in their sorted files, and rows are read only for what matches.

A term is a range of the sorted terms, so that the scan of the postings skips the files and row groups of all others.
One aggregate by document tells which terms it holds and how often.  Phrases and NEAR need the order of tokens:
documents with all of their words are candidates, whose rows are then held against the whole query.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans import compile as plan
from quern.plans.parser import ParsedQuery, Term
from quern.spec import Config


def _ordered(term: Term) -> bool:
    return len(term.tokens) > 1


def _here(term: Term, column_weight: dict[str, int]) -> list[Column]:
    """For each part of a term that a document must hold, the test of a posting."""
    word = F.col("term")
    if _ordered(term):
        tests = [word == F.lit(t) for t in term.tokens]
    else:
        tests = [word == F.lit(term.tokens[0]) if term.phrase else F.startswith(word, F.lit(term.tokens[0]))]
    if term.column in column_weight:
        tests = [t & (F.col("w") == column_weight[term.column]) for t in tests]
    return tests


def needs_rows(query: ParsedQuery) -> bool:
    return bool(query.near) or any(_ordered(t) for t in (*query.positive, *query.exclude))


def matching(query: ParsedQuery, postings: DataFrame, config: Config, column_weight: dict[str, int], ranked: bool = False) -> DataFrame:
    """(doc_id, and if ranked: f<i>_<w> occurrences of word i in bucket w, b<i> tokens that begin with it).

    The documents that match, or, where the order of tokens matters, those that may.
    """
    terms = list(dict.fromkeys((*query.positive, *query.exclude)))
    tests = {t: _here(t, column_weight) for t in terms}
    wanted = [test for own in tests.values() for test in own]
    flags, sums = [], []
    for i, t in enumerate(terms):
        flags += [F.max(F.coalesce(test, F.lit(False))).alias(f"m{i}_{j}") for j, test in enumerate(tests[t])]
    if ranked:
        for i, word in enumerate(query.words()):
            begins = F.startswith("term", F.lit(word))
            wanted.append(begins)
            sums += [F.sum(F.when((F.col("term") == word) & (F.col("w") == w), F.col("tf")).otherwise(0)).alias(f"f{i}_{w}") for w in plan.buckets(config)]
            sums.append(F.sum(F.when(begins, F.col("tf")).otherwise(0)).alias(f"b{i}"))
    by_doc = postings.where(reduce(or_, wanted)).groupBy("doc_id").agg(*flags, *sums)
    holds = {t: reduce(and_, [F.col(f"m{i}_{j}") for j in range(len(tests[t]))]) for i, t in enumerate(terms)}
    found = reduce(or_, [holds[t] for t in query.positive]) if query.should else reduce(and_, [holds[t] for t in query.must])
    for t in query.exclude:
        if not _ordered(t):
            found = found & ~holds[t]
    names = [c for c in by_doc.columns if not c.startswith("m")]
    return by_doc.where(found).select(*names)


def rank(query: ParsedQuery, df: dict[str, int], docs: int, avgdl: float, config: Config) -> Column:
    """The rank of rows of ``matching`` joined with the rows' lengths."""
    words = query.words()
    fields = {w: [F.col(f"f{i}_{w}") for i in range(len(words))] for w in plan.buckets(config)}
    lengths = {w: F.col(f"len_w{w}") for w in plan.buckets(config)}
    exact = [reduce(lambda a, b: a + b, [F.col(f"f{i}_{w}") for w in plan.buckets(config)]) for i in range(len(words))]
    counts = [(exact[words.index(t.tokens[0])], F.col(f"b{words.index(t.tokens[0])}")) for t in query.positive if not _ordered(t)]
    return plan.rank_of(fields, lengths, {w: F.col(f"len_w{w}").isNotNull() for w in plan.buckets(config)}, words, plan.quick_of(counts), df, docs, avgdl, config)
