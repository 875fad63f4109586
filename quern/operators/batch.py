"""Many queries at once: documents are scored a slice at a time against all queries, and each task keeps its best.

What leaves a task is k rows a query; pairs of query and document are never listed.  Only a table of very many queries,
or an index whose rows have no keys, is joined to postings instead, with one shuffle by (query, document).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.functions import analysis
from quern.operators.index import Index
from quern.plans import compile as plan

#: A query table of up to this many terms is sent to the tasks.
BROADCAST_TERMS = 200_000
#: Documents and tokens of a slice, and pairs of its documents with queries, that a worker holds at once.
SLICE_DOCS, SLICE_TOKENS, SLICE_PAIRS = 4000, 1_000_000, 2_000_000
#: Candidates that a task keeps until it drops all but the best of each query.
HELD = 200_000


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, term, n_terms): the distinct tokens of each query."""
    toks = F.array_distinct(analysis.tokens(analysis.analyze(F.col(text))))
    return queries.select(F.col(key).alias("query_id"), toks.alias("t")).select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term"))


def batch_topk(index: Index, queries: DataFrame, key: str = "query_id", text: str = "query", k: int = 10, mode: str = "and") -> DataFrame:
    """(query_id, place, doc_id, rank) for every query: documents with all its words (mode ``or``: any), by BM25.

    Exact words only.
    """
    terms = query_terms(queries, key, text)
    df = index.table("term_df").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = terms.join(df, "term")
    few = terms.count() <= BROADCAST_TERMS
    if few and index.rows.where(F.col("doc_id").isNull()).isEmpty():
        ranked = _by_slices(index, weighed, k, mode)
    else:
        ranked = _by_postings(index, F.broadcast(weighed) if few else weighed, mode)
    w = Window.partitionBy("query_id").orderBy(F.desc("rank"), "doc_id")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "place", "doc_id", "rank")


def _by_postings(index: Index, side: DataFrame, mode: str) -> DataFrame:
    """(query_id, doc_id, rank) of all matches."""
    config = index.config
    docs, avg = float(index.doc_count), float(index.avg_len or 1.0)
    hits = index.table("postings").join(side, "term")
    part = plan.bm25_field([F.col("tf")], [plan.idf(F.col("df"), F.lit(docs))], F.col("dl"), avg, config)
    weights = range(1, config.max_weight + 1)
    by_doc = hits.groupBy("query_id", "doc_id").agg(
        F.max("n_terms").alias("n_terms"),
        F.countDistinct("term").alias("found"),
        *[F.sum(F.when(F.col("w") == w, part)).alias(f"s{w}") for w in weights],
    )
    if mode == "and":
        by_doc = by_doc.where("found = n_terms")
    lengths = index.rows.select("doc_id", *[(F.col(f"text_w{w}") != "").alias(f"has{w}") for w in weights])
    scored = by_doc.join(lengths, "doc_id") if len(index.spec.columns) > 1 else by_doc.withColumns({f"has{w}": F.lit(w == min(max(index.spec.columns[0].weight, 1), config.max_weight)) for w in weights})
    total = reduce(add, [F.when(F.col(f"has{w}"), w * F.coalesce(F.col(f"s{w}"), F.lit(0.0))).otherwise(0.0) for w in weights])
    weight = reduce(add, [F.when(F.col(f"has{w}"), w).otherwise(0) for w in weights])
    return scored.select("query_id", "doc_id", plan.normalized(total / weight, F.lit(docs), config).alias("rank"))


def _by_slices(index: Index, weighed: DataFrame, k: int, mode: str) -> DataFrame:
    """(query_id, doc_id, rank): of each query's matches the best k of every task."""
    config, spark = index.config, index.rows.sparkSession
    docs = float(index.doc_count)
    rows = weighed.select("query_id", "n_terms", "term", plan.idf(F.col("df"), F.lit(docs)).alias("idf")).groupBy("query_id").agg(F.max("n_terms").alias("n"), F.collect_list(F.struct("term", "idf")).alias("t")).collect()
    if mode == "and":  # words that no document has were lost in the join
        rows = [r for r in rows if len({x["term"] for x in r["t"]}) == r["n"]]
    words = sorted({x["term"] for r in rows for x in r["t"]})
    place, idf = {t: i for i, t in enumerate(words)}, np.zeros(len(words))
    asked = []
    for r in rows:
        times: dict[int, int] = defaultdict(int)
        for x in r["t"]:
            times[place[x["term"]]] += 1
            idf[place[x["term"]]] = x["idf"]
        asked.append(dict(times))
    weights = range(1, config.max_weight + 1)
    own = {min(max(c.weight, 1), config.max_weight) for c in index.spec.columns}
    has = [(F.col(f"text_w{w}") != "" if len(index.spec.columns) > 1 else F.lit(w in own)).alias(f"has{w}") for w in weights]
    top = math.log(1 + (docs + 0.5) / 0.5) * (config.k1 + 1) * config.max_weight
    task = _scored(words, idf, asked, mode == "and", k, config.k1, config.b, float(index.avg_len or 1.0), top)
    best = index.rows.select("doc_id", *[f"tok_w{w}" for w in weights], *has).mapInArrow(task, "q int, doc_id string, rank double")
    names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], T.StructType().add("q", T.IntegerType()).add(weighed.schema["query_id"]))
    return best.join(F.broadcast(names), "q").select("query_id", "doc_id", "rank")


def _scored(words: list[str], idf: np.ndarray, asked: list[dict[int, int]], every: bool, k: int, k1: float, b: float, avg: float, top: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best k documents for each of the queries, which are given as how often each word counts."""
    by_word: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for q, own in enumerate(asked):
        for t, n in own.items():
            by_word[t].append((q, n))
    takers = {t: (np.array([q for q, _ in x]), np.array([n for _, n in x], float)) for t, x in by_word.items()}

    def parts_of(column: pa.ListArray, known: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The documents with each word, and what the word adds to their score in this bucket."""
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        of, bits = np.repeat(np.arange(len(sizes)), sizes), len(sizes).bit_length()
        if not len(flat):
            return {}
        empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # between the columns of a bucket
        length = np.bincount(of[~empty], minlength=len(sizes))
        found = pc.index_in(flat, value_set=known)
        there = found.is_valid().to_numpy(zero_copy_only=False) & ~empty
        keys = pc.fill_null(found, 0).to_numpy()[there].astype(np.int64) << bits | of[there]
        keys.sort()
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        tf = np.diff(at, append=len(keys)).astype(float)
        term, doc = keys[at] >> bits, keys[at] & ((1 << bits) - 1)
        part = idf[term] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length[doc] / avg))
        cuts = np.flatnonzero(np.diff(term, prepend=-1))
        return {int(term[i]): (doc[i:j], part[i:j]) for i, j in zip(cuts, [*cuts[1:], len(term)], strict=True)}

    def with_any(buckets: list, n: int, lo: int, hi: int) -> np.ndarray:
        """The weighted sums of the queries lo to hi, by document; 0 where none of a query's words is."""
        total = np.zeros((hi - lo, n))
        for w, parts in enumerate(buckets, 1):
            own = np.zeros((hi - lo, n)) if parts else 0.0
            for t, (doc, part) in parts.items():
                q, times = takers[t]
                i, j = np.searchsorted(q, (lo, hi))
                if i < j:
                    own[(q[i:j] - lo)[:, None], doc] += times[i:j, None] * part
            total += w * own
        return total

    def with_all(buckets: list, n: int, lo: int, hi: int) -> np.ndarray:
        total = np.zeros((hi - lo, n))
        where = {t: reduce(np.union1d, [p[t][0] for p in buckets if t in p]) for t in {t for p in buckets for t in p}}
        for q in range(lo, hi):
            if not all(t in where for t in asked[q]):
                continue
            common = None
            for t in sorted(asked[q], key=lambda t: len(where[t])):
                common = where[t] if common is None else np.intersect1d(common, where[t], True)
                if not len(common):
                    break
            if common is not None and len(common):
                for w, parts in enumerate(buckets, 1):
                    own = np.zeros(n)
                    for t, times in asked[q].items():
                        if t in parts:
                            own[parts[t][0]] += times * parts[t][1]
                    total[q - lo, common] += w * own[common]
        return total

    def slice_of(batches: list[pa.RecordBatch], weights: range, known: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows = pa.Table.from_batches(batches).combine_chunks().sort_by("doc_id")
        ids, n = rows.column(0).to_pylist(), rows.num_rows
        one = lambda c: pa.concat_arrays(rows.column(c).chunks)
        buckets = [parts_of(one(f"tok_w{w}"), known) for w in weights]
        weight = sum(w * one(f"has{w}").to_numpy(zero_copy_only=False).astype(float) for w in weights)
        ids = np.array(ids, object)
        step = max(1, SLICE_PAIRS // n)
        for lo in range(0, len(asked), step):
            hi = min(lo + step, len(asked))
            total = (with_all if every else with_any)(buckets, n, lo, hi)
            tenths = np.minimum(np.floor(total / np.maximum(weight, 1) / top * 100 * 10 + 0.5), 1000)
            order = np.where(total > 0, tenths * n + (n - 1 - np.arange(n)), -1)  # of equal ranks the least key
            best = np.argpartition(order, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), order.shape)
            q, place = np.nonzero(np.take_along_axis(order, best, 1) >= 0)
            doc = best[q, place]
            yield q + lo, tenths[q, doc], ids[doc]

    def best_of(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, tenths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(ids, kind="stable")
        order = order[np.lexsort((-tenths[order], q[order]))]  # stable, so that equal ranks stay in the order of their keys
        own = q[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        kept = order[np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own))) < k]
        return q[kept], tenths[kept], ids[kept]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, waiting, docs, tokens = pa.array(words, pa.string()), [], [], 0, 0

        def add_slice() -> None:
            weights = range(1, (waiting[0].num_columns - 1) // 2 + 1)
            held.extend(slice_of(waiting, weights, known))
            if len(held) > 1 and sum(len(h[0]) for h in held) > max(HELD, 4 * k * len(asked)):
                held[:] = [best_of(held)]
            waiting.clear()

        for batch in batches if asked else ():
            if batch.num_rows:
                waiting.append(batch)
                docs += batch.num_rows
                tokens += sum(len(c.values) for c in batch.columns if pa.types.is_list(c.type))
                if docs >= SLICE_DOCS or tokens >= SLICE_TOKENS:
                    add_slice()
                    docs = tokens = 0
        if waiting:
            add_slice()
        if held:
            q, tenths, ids = best_of(held)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids, pa.string()), pa.array(tenths / 10)], ["q", "doc_id", "rank"])

    return task


def intersect(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id) of the documents in the posting lists of all terms."""
    return postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(set(terms))).select("doc_id")


def union(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id) of the documents in the posting list of any term."""
    return postings.where(F.col("term").isin(terms)).select("doc_id").distinct()
