"""Posting lists cut by slices of documents: what a task shuffles is a row for each term of a slice, not one for each posting."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a slice, which a worker holds at once; postings of a file, at the most about so many.
SLICE_TOKENS, FILE_POSTINGS = 2_000_000, 3_000_000
#: Fewer postings than this aren't worth a file of their own.
LEAST_POSTINGS = 200_000
#: Tokens looked at, and taken, to find where the ranges of terms begin.
LOOKED_AT, TAKEN = 1_000_000, 50_000
SCHEMA = "part int, term string, w int, docs array<string>, tf array<int>, dl array<int>"


class _Sorted:
    """A sorted Arrow array of strings for bisect."""

    def __init__(self, values: pa.Array):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, k: int) -> str:
        return self.values[k].as_py()


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _blocks(batches: list[pa.RecordBatch], weights: range, bounds: list[str]) -> Iterator[pa.RecordBatch]:
    docs = pa.concat_arrays([b.column(0) for b in batches])
    for k, w in enumerate(weights, 1):
        column = pa.concat_arrays([b.column(k) for b in batches])
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(len(docs)), sizes)
        coded = column.flatten().dictionary_encode()
        if not len(coded):
            continue
        order = pc.sort_indices(coded.dictionary)
        terms, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        codes = rank[coded.indices.to_numpy()]
        if terms[0].as_py() == "":  # between the columns of a bucket
            of, codes = of[codes > 0], codes[codes > 0]
        lengths = np.bincount(of, minlength=len(docs)).astype(np.int32)
        bits = len(docs).bit_length()
        keys = codes << bits | of
        keys.sort()
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        tf = np.diff(at, append=len(keys)).astype(np.int32)
        term, row = keys[at] >> bits, keys[at] & ((1 << bits) - 1)
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        offsets, own = np.append(begins, len(at)), term[begins]
        parts = np.searchsorted(np.array([bisect_left(_Sorted(terms), b) for b in bounds], np.int64), own, "right").astype(np.int32)
        columns = [pa.array(parts), terms.take(pa.array(own)), pa.array(np.full(len(own), w, np.int32))]
        columns += [_lists(v, offsets) for v in (docs.take(pa.array(row)), pa.array(tf), pa.array(lengths[row]))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "term", "w", "docs", "tf", "dl"])


def _task(weights: range, bounds: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for batch in batches:
            held.append(batch)
            tokens += sum(len(batch.column(k).values) for k in range(1, batch.num_columns))
            if tokens >= SLICE_TOKENS:
                yield from _blocks(held, weights, bounds)
                held, tokens = [], 0
        if held:
            yield from _blocks(held, weights, bounds)

    return task


def ranges(index: DataFrame, words: Column, tokens: int) -> list[str]:
    """The terms at which ranges of about as many postings begin; they say where postings are kept, not what they are."""
    cores = index.sparkSession.sparkContext.defaultParallelism
    n = max(min(cores, tokens // LEAST_POSTINGS), -(-tokens // FILE_POSTINGS))
    if n <= 1:
        return []
    own = index.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, tokens // LOOKED_AT))) == 0).select(F.explode(F.array_distinct(words)).alias("term"))
    found = sorted(r[0] for r in own.sample(min(1.0, TAKEN / LOOKED_AT), seed=1).collect())  # some 50,000 words
    return sorted({found[k * len(found) // n] for k in range(1, n)}) if found else []


def sorted_postings(index: DataFrame, weights: range, bounds: list[str]) -> DataFrame:
    """(term, doc_id, w, tf, dl) of index rows with keys of their own, in partitions by ranges of terms, sorted by term."""
    blocks = index.select("doc_id", *[f"tok_w{w}" for w in weights]).mapInArrow(_task(weights, bounds), SCHEMA)
    ranged = blocks.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("term", "w")
    rows = ranged.select("term", "w", "tf", "dl", F.posexplode("docs").alias("k", "doc_id"))
    return rows.select("term", "doc_id", "w", F.get("tf", "k").alias("tf"), F.get("dl", "k").alias("dl"))
