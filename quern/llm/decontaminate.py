"""Benchmark decontamination by Wu-Manber search for the test strings of a benchmark.

A test string is a window of ``window`` consecutive words of an item (an item with fewer words is one string as a
whole), lower-cased, punctuation dropped.  A document that holds one holds at least that much of the item word for
word.  The search runs over each text, folded alike, once:

* a **shift table**, indexed by a hash of a block of 8 characters, tells how far the search may jump when the
  window ends in that block: as far as no test string could end before (collisions only shorten jumps);
* where the shift is 0, a **bucket** of the hash of the last block of the strings' common length selects test
  strings, a hash of their first block sorts most of them out, and a **direct comparison** of all characters
  confirms an occurrence.

The cursors of many stretches of text move at once in numpy, so that a step costs nanoseconds, not an interpreter
loop; each stretch overlaps the next by the length of a window, so that no occurrence falls between two.  The
strings go to the workers in groups of at most ``group`` items, one pass over the documents for each group: the
memory a worker needs doesn't depend on the size of the benchmark.

Defined cases: null and empty texts and texts without words hold nothing; items without a word match nothing; items
or documents that repeat are reported row by row; a row with a null doc_id or item_id is reported with the null; in
``keep`` each row stays or goes by its own text, whatever its doc_id; a text of any length is searched in whole; only
doc_id and text of the documents and item_id and text of the benchmark are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import kernel as K
from quern.llm.common import cut, map_arrow, pick, prepare, texts_of

WINDOW, GROUP = 13, 20_000
_BLOCK, _STRETCH, _BITS = 8, 512, 21
_MULT = (np.uint32(0x9E3779B1) * np.arange(1, 2 * _BLOCK, 2, dtype=np.uint32)) | np.uint32(1)

SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
      FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, CAST(len(w) - least(13, len(w)) + 2 AS BIGINT))) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
      FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k))
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS hits, CAST(min(i) - 1 AS BIGINT) AS first_word
FROM g JOIN p USING (k, gram) GROUP BY doc_id, item_id
"""


def stream(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters with one 0 before, between and after words; the places in cps that they come from."""
    w = K.fold(cps)
    keep = w != 0
    after = np.zeros(len(w), bool)
    after[1:] = keep[:-1] & ~keep[1:]
    at = np.flatnonzero(keep | after)
    out = np.zeros(len(at) + 1, np.uint32)
    out[1:] = w[at]
    return out, np.concatenate([[0], at])


def block_hash(chars: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the 8 characters that end at each place."""
    h = chars[end - (_BLOCK - 1)] * _MULT[0]
    for k in range(1, _BLOCK):
        h += chars[end - (_BLOCK - 1) + k] * _MULT[k]
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x85EBCA6B)


class Searcher:
    """The shift table and buckets of a group of test strings."""

    def __init__(self, items: list[str], window: int):
        strings: dict[bytes, list[int]] = {}
        for i, text in enumerate(items):
            cps, _ = K.code_points([text])
            chars, _ = stream(cps)
            gaps = np.flatnonzero(chars == 0)
            size = min(window, len(gaps) - 1)
            if size > 0:
                for a, b in zip(gaps[: len(gaps) - size], gaps[size:], strict=True):
                    strings.setdefault(chars[a : b + 1].tobytes(), []).append(i)
        # strings too short for a block are looked for one by one
        self.strings = [np.frombuffer(s, np.uint32) for s in strings]
        self.items = [sorted(set(v)) for v in strings.values()]
        self.tiny = [k for k, s in enumerate(self.strings) if len(s) < _BLOCK]
        self.length = m = min((len(s) for s in self.strings if len(s) >= _BLOCK), default=0)
        if not m:
            return
        self.own = [k for k, s in enumerate(self.strings) if len(s) >= _BLOCK]
        heads = np.stack([self.strings[k][:m] for k in self.own])
        flat = heads.ravel()
        self.shift = np.full(1 << _BITS, m - _BLOCK + 1, np.uint16)
        base = np.arange(len(self.own)) * m
        for j in range(_BLOCK - 1, m):
            np.minimum.at(self.shift, block_hash(flat, base + j) >> np.uint32(32 - _BITS), np.uint16(min(m - 1 - j, 65535)))
        last = block_hash(flat, base + m - 1)
        first = block_hash(flat, base + _BLOCK - 1)
        order = np.argsort(last, kind="stable")
        self.buckets, start = np.unique(last[order], return_index=True)
        self.start = np.append(start, len(order))
        self.order, self.first = order, first[order]

    def find(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, string) of every occurrence in chars."""
        starts, which = [], []
        m = self.length
        if m and len(chars) >= m:
            begin = np.arange(m - 1, len(chars), _STRETCH)
            end = np.minimum(begin + _STRETCH, len(chars))
            at, stop = begin, end
            found = []
            while len(at):
                h = block_hash(chars, at)
                step = self.shift[h >> np.uint32(32 - _BITS)]
                zero = step == 0
                if zero.any():
                    found.append((at[zero], h[zero]))
                at = at + np.maximum(step, 1)
                on = at < stop
                at, stop = at[on], stop[on]
            if found:
                at, h = (np.concatenate(x) for x in zip(*found, strict=True))
                b = np.searchsorted(self.buckets, h)
                b[b == len(self.buckets)] = 0
                hit = self.buckets[b] == h
                at, b = at[hit], b[hit]
                head = block_hash(chars, at - m + _BLOCK)
                n = self.start[b + 1] - self.start[b]
                at, head = np.repeat(at, n), np.repeat(head, n)
                k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[b], n)
                ok = self.first[k] == head
                for p, s in zip((at[ok] - m + 1).tolist(), self.order[k[ok]].tolist(), strict=True):
                    string = self.strings[self.own[s]]
                    if np.array_equal(chars[p : p + len(string)], string):
                        starts.append(p)
                        which.append(self.own[s])
        for k in self.tiny:
            s = self.strings[k]
            n = len(chars) - len(s) + 1
            if n > 0:
                ok = np.ones(n, bool)
                for j, c in enumerate(s):
                    ok &= chars[j : j + n] == c
                for p in np.flatnonzero(ok).tolist():
                    starts.append(p)
                    which.append(k)
        return np.array(starts, np.int64), np.array(which, np.int64)


def search(searcher: Searcher, texts: list[str]) -> list[tuple[int, int, int, int]]:
    """(text, item, windows found, first of their words in the text) for each text and item with an occurrence."""
    out = []
    for a, b in K.slices(texts):
        cps, bounds = K.code_points(texts[a:b])
        chars, place = stream(cps)
        start, string = searcher.find(chars)
        if not len(start):
            continue
        lens = np.array([len(s) for s in searcher.strings])[string]
        head, tail = place[start + 1], place[start + lens - 2]
        doc = np.searchsorted(bounds, head, "right") - 1
        inside = doc == np.searchsorted(bounds, tail, "right") - 1
        gaps = np.flatnonzero(chars[:-1] == 0)  # a word begins after each
        word = np.searchsorted(gaps, start)
        origin = np.searchsorted(place[gaps + 1], bounds[:-1])
        best: dict[tuple[int, int], list[int]] = {}
        for d, s, w in zip(doc[inside].tolist(), string[inside].tolist(), (word - origin[doc])[inside].tolist(), strict=True):
            for item in searcher.items[s]:
                have = best.setdefault((d, item), [0, w])
                have[0] += 1
                have[1] = min(have[1], w)
        out += [(a + d, item, n, w) for (d, item), (n, w) in best.items()]
    return out


def _task(var):
    def task(batches):
        searcher, items = var.value
        for batch in batches:
            found = search(searcher, texts_of(batch))
            rows = pa.array([f[0] for f in found], pa.int64())
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(rows)
            yield pa.RecordBatch.from_arrays(
                [ids, items.take(pa.array([f[1] for f in found], pa.int64())), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())],
                ["doc_id", "item_id", "hits", "first_word"],
            )

    return task


def _keep_task(var, names):
    def task(batches):
        searcher, _ = var.value
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            stays[[f[0] for f in search(searcher, texts_of(batch))]] = False
            yield batch.select(names).filter(pa.array(stays))

    return task


def _searchers(items: DataFrame, window: int, group: int):
    """Broadcast test strings, group by group, with the ids of their items."""
    spark = items.sparkSession
    groups = max(1, -(-items.count() // group))
    for k in range(groups):
        own = items if groups == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == k)
        table = own.toArrow()
        searcher = Searcher([t or "" for t in table["text"].to_pylist()], window)
        yield spark.sparkContext.broadcast((searcher, table["item_id"].combine_chunks())), k == groups - 1


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(doc_id, item_id, hits, first_word) for each document that holds ``window`` words of an item in a row.

    hits: occurrences of the item's windows; first_word: where the first of them begins, in words from 0.
    """
    prepare(docs.sparkSession)
    docs = pick(docs, doc_id="doc_id", text="text").where("text is not null")
    items = pick(benchmark, item_id="item_id", text="text").where("text is not null")
    kinds = [t.simpleString() for t in (docs.schema["doc_id"].dataType, items.schema["item_id"].dataType)]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, hits long, first_word long"
    found = None
    for var, last in _searchers(items, window, group):
        part = map_arrow(docs, _task(var), schema)
        if not last or found is not None:
            part = cut(part)
            var.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def keep(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """docs without the rows that hold a test string: one pass over them for each group of items, and no shuffle."""
    prepare(docs.sparkSession)
    items = pick(benchmark, item_id="item_id", text="text").where("text is not null")
    out = docs
    for var, last in _searchers(items, window, group):
        out = out.mapInArrow(_keep_task(var, docs.columns), docs.schema)
        if not last:
            out = cut(out)
            var.unpersist()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item's words, with the item, over both whole tables."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
