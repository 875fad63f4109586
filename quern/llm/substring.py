"""Substring dedup by hashing lines and their sentences.

A unit is a sentence of a line: units begin at the start of the text, after a line feed, and after the white space
that follows a full stop, exclamation or question mark.  (Whole lines alone would miss a passage pasted into the
middle of a paragraph.)  A unit's words are folded (lower case, no punctuation, one space) and hashed to 128 bits;
units of fewer than ``min_words`` words are too common to mean anything and are left alone.  Of all units with one
digest, over all documents, the one of the lowest doc_id, and in it the first, is kept and the rest repeat it.  What
repeats is removed if it is a passage: units of ``min_words`` words that follow one another, with no such unit
between them that doesn't repeat, and have at least ``min_run`` words together.  A sentence that half of a crawl
shares ("All rights reserved to their owners.") is no passage; removing it would touch every other document.
Offsets are those of the original text, in characters.

The digests are grouped by a partial and a final aggregate, so a passage with millions of copies is no hot key;
only digests that occur twice come back to the units, broadcast if there are few of them.  Only repeating units are
shuffled by text, to find their runs.

Defined cases: null and empty texts have no units; rows with a null doc_id can't be named and take no part; rows that
share a doc_id with different texts are different texts, each with its own spans (of equal places in them the one of
the lesser 128-bit key of the text comes first); of rows that repeat a doc_id and a text, one occurrence can't be told
from the other, so both are that occurrence, and it is reported once; a text of any length is read in whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import kernel as K
from quern.llm.common import column, cut, map_arrow, new_name, pick, prepare, row_key, small, texts_of

MIN_WORDS, MIN_RUN = 5, 20
_SPACE = np.array([9, 10, 12, 13, 32], np.uint32)
_STOP = np.array([33, 46, 63], np.uint32)

SQL = r"""
WITH u AS (
  SELECT doc_id, p, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY p) - length(s) AS before
  FROM (SELECT doc_id, unnest(l) AS s, unnest(range(1, CAST(len(l) + 1 AS BIGINT))) AS p
        FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?][ \t\n\f\r]+|\n)', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents WHERE doc_id IS NOT NULL))),
n AS (
  SELECT doc_id, before + length(s) - length(ltrim(s, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) AS start,
         before + length(rtrim(s, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) AS stop,
         regexp_extract_all(lower(s), '[\p{L}\p{N}\p{M}]+') AS w FROM u),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, start) AS kept_doc_id,
         first_value(start) OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, start) AS kept_start
  FROM n WHERE len(w) >= 5),
g AS (SELECT *, sum(CASE WHEN doc_id <> kept_doc_id OR start <> kept_start THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM k),
r AS (SELECT *, sum(len(w)) OVER (PARTITION BY doc_id, run) AS total FROM g WHERE doc_id <> kept_doc_id OR start <> kept_start)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(len(w) AS BIGINT) AS n_words,
       kept_doc_id, CAST(kept_start AS BIGINT) AS kept_start
FROM r WHERE total >= 20
"""


def units_of(texts: list[str], min_words: int) -> tuple[np.ndarray, ...]:
    """text, digest (two words of 64 bits), start, stop and number of words of each unit with enough words."""
    parts = []
    for a, b in K.slices(texts):
        cps, bounds = K.code_points(texts[a:b])
        h, ws, _ = K.words(cps)
        if len(h) < min_words:
            continue
        space = np.isin(cps, _SPACE) if len(cps) < 64 else (cps == 32) | (cps == 10) | (cps == 9) | (cps == 12) | (cps == 13)
        solid = np.flatnonzero(~space)
        if not len(solid):
            continue
        # a unit begins at the first solid character after a line feed, and after white space behind a stop
        gap = np.flatnonzero(np.diff(solid) > 1)
        feeds = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(cps == 10, out=feeds[1:])
        left, right = solid[gap], solid[gap + 1]
        new = (feeds[right] > feeds[left]) | np.isin(cps[left], _STOP)
        start = np.concatenate([solid[:1], right[new]])
        stop = np.concatenate([left[new] + 1, solid[-1:] + 1])
        first, last = np.searchsorted(ws, start), np.searchsorted(ws, stop)
        ok = last - first >= min_words
        start, stop, first, last = start[ok], stop[ok], first[ok], last[ok]
        doc = np.searchsorted(bounds, start, "right") - 1
        parts.append((a + doc, K.run_hashes(h, first, last, 1), K.run_hashes(h, first, last, 2), start - bounds[doc], stop - bounds[doc], last - first))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _task(min_words: int):
    def task(batches):
        for batch in batches:
            text, h0, h1, start, stop, n = units_of(texts_of(batch), min_words)
            rows = pa.array(text)
            keys = [batch.column(batch.schema.get_field_index(c)).take(rows) for c in ("doc_id", "t0", "t1")]
            at = np.arange(len(text)) - np.searchsorted(text, text)  # the unit's number in its text
            numbers = [pa.array(x) for x in (h0.view(np.int64), h1.view(np.int64), at, start, stop, n)]
            yield pa.RecordBatch.from_arrays([*keys, *numbers], ["doc_id", "t0", "t1", "h0", "h1", "at", "start", "stop", "n_words"])

    return task


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t0, t1, h0, h1, at, start, stop, n_words): each unit, t being a key of its text and at its number there."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    t = row_key(F.col("text"))
    named = docs.where("doc_id is not null and text is not null").select("doc_id", "text", t[0].alias("t0"), t[1].alias("t1"))
    return map_arrow(named, _task(min_words), f"doc_id {kind}, t0 long, t1 long, h0 long, h1 long, at long, start long, stop long, n_words long")


def _repeats(docs: DataFrame, min_words: int, min_run: int) -> DataFrame:
    prepare(docs.sparkSession)
    u = units(pick(docs, doc_id="doc_id", text="text"), min_words)
    place = ["doc_id", "start", "t0", "t1"]
    first = u.groupBy("h0", "h1").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1").select("h0", "h1", "first")
    first = cut(first)
    both = u.join(small(first, first.count()), ["h0", "h1"]).where(F.struct(*place) != F.col("first"))
    # repeated rows have the same units
    once = both.groupBy("doc_id", "t0", "t1", "at").agg(*[F.first(c).alias(c) for c in ("start", "stop", "n_words", "first")])
    of_text = Window.partitionBy("doc_id", "t0", "t1")
    runs = once.withColumn("run", F.col("at") - F.row_number().over(of_text.orderBy("at")))
    total = F.sum("n_words").over(Window.partitionBy("doc_id", "t0", "t1", "run"))
    return runs.withColumn("total", total).where(F.col("total") >= min_run)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, start, stop, n_words, kept_doc_id, kept_start): the units to remove, and the occurrence that stays."""
    found = _repeats(docs, min_words, min_run)
    return found.select("doc_id", "start", "stop", "n_words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))


def _cut_task(names, spans_name):
    def task(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            spans = batch.column(batch.schema.get_field_index(spans_name)).to_pylist()
            out = []
            for t, s in zip(texts, spans, strict=True):
                for x in sorted(s or [], key=lambda x: -x["start"]):
                    t = t[: x["start"]] + t[x["stop"] :]
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names], names)

    return task


def clean(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """docs, each text without the passages that repeat an earlier one; no row goes."""
    keys, held = [new_name("id"), new_name("t0"), new_name("t1")], new_name("spans")
    found = _repeats(docs, min_words, min_run).groupBy("doc_id", "t0", "t1").agg(F.collect_set(F.struct("start", "stop")).alias(held))
    spans = cut(found.toDF(*keys, held))
    own = [column(docs, "doc_id"), *row_key(column(docs, "text"))]
    same = (own[0] == F.col(keys[0])) & (own[1] == F.col(keys[1])) & (own[2] == F.col(keys[2]))
    joined = docs.join(small(spans, spans.count(), 100_000), same, "left").drop(*keys)
    return joined.mapInArrow(_cut_task(docs.columns, held), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units to remove from all documents, and the occurrence of each that stays."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
