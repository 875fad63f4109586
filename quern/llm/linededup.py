"""Line dedup with a log-template tree.

Lines are parsed like log messages (a Drain tree of fixed depth): a line goes down the tree by its number of words
and its first ``depth`` words, in which a word with a digit counts as a variable, to a leaf.  There it joins the
first template that agrees with it in at least ``similarity`` of its words, whose differing words become variables;
else it founds a template.  Lines of a leaf are taken in a fixed order: the most frequent first, then by hash.  A line
isn't held against every template of its leaf: of any of its words, one more than may differ, at least one is the same
in a template that it joins, and templates are looked up by those words that the fewest of them have.

A template recurs if at least ``min_docs`` documents hold lines of it; the lines of recurring templates are dropped
from all documents.  Of the documents of which such lines make up half or more of the words, those with the same
set of lines (a line that has a template stands for it) are copies of one page and count once towards ``min_docs``
(what to do with them is up to document dedup): so a page that is copied a thousand times doesn't lose its text,
while a passage on ten different pages is dropped everywhere, whatever share of them it makes up.

The tree is spread over the cluster by leaf.  Leaves with fewer than ``min_docs`` lines can't recur, so most text
never leaves the scan: only the distinct lines of busy leaves are shuffled, and only hashes of the rest.  A leaf is
never divided, however many lines it has, since that would part lines of one template: it is one task's, which holds
some 24 bytes for each word of its distinct lines that isn't the same in all of them.

Defined cases: a text of any length is parsed in whole; an empty table stays empty; columns besides doc_id and text are
passed on as they are; null text stays null, empty text stays empty; lines without a word are kept; a line that repeats
within a document counts once; rows that repeat a doc_id count as one document; rows with a null doc_id don't count
towards ``min_docs`` but lose their recurring lines like others.  A document may end up with an empty text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import arrays
from quern.llm import kernel as K
from quern.llm.common import cut, delete, map_arrow, own_folder, pick, prepare, small, texts_of

DEPTH, SIMILARITY, MIN_DOCS = 3, 0.75, 10
#: Leaves of up to this many distinct lines have their templates compared one by one, with the same result.
FEW_LINES = 48
_U = np.uint64
_VARIABLE = _U(0x2A2A2A2A2A2A2A2B)


def lines_of(texts: list[str], depth: int) -> dict[str, np.ndarray]:
    """Every line of the texts with a word: its text, place, number of words, leaf and hash; tokens and their bounds."""
    cps, bounds = K.code_points(texts)
    h, ws, we = K.words(cps)
    digits = np.zeros(len(cps) + 1, np.int32)
    np.cumsum((cps >= 48) & (cps <= 57), out=digits[1:])
    token = np.where(digits[we] > digits[ws], _VARIABLE, h)
    feeds = np.flatnonzero(cps == 10)  # the last line of a text ends with the one between texts
    start = np.concatenate([[0], feeds[:-1] + 1]) if len(feeds) else np.zeros(0, np.int64)
    first, last = np.searchsorted(ws, start), np.searchsorted(ws, feeds)
    n = last - first
    leaf = K.run_hashes(token, first, np.minimum(first + depth, last), 3) ^ (n.astype(_U) * _U(0x9E3779B97F4A7C15))
    line = K.run_hashes(token, first, last, 4)
    doc = np.searchsorted(bounds, start, "right") - 1
    return {"doc": doc, "start": start, "end": feeds, "first": first, "n": n, "leaf": K.mix(leaf), "line": line, "token": token, "bounds": bounds}


def _lines_task(depth: int):
    def task(batches):
        for batch in batches:
            texts = texts_of(batch)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, b in K.slices(texts):
                x = lines_of(texts[a:b], depth)
                total = np.bincount(x["doc"], weights=x["n"], minlength=b - a).astype(np.int64)
                some = np.flatnonzero(x["n"] > 0)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(a + x["doc"][some])), pa.array(x["leaf"][some].view(np.int64)), pa.array(x["line"][some].view(np.int64)), pa.array(x["n"][some].astype(np.int32)), pa.array(total[x["doc"][some]].astype(np.int32))],
                    ["doc_id", "leaf", "line", "n", "total"],
                )

    return task


def _tokens_task(depth: int):
    def task(batches):
        for batch in batches:
            texts = texts_of(batch)
            for a, b in K.slices(texts):
                x = lines_of(texts[a:b], depth)
                some = np.flatnonzero(x["n"] > 0)
                some = some[np.unique(x["line"][some], return_index=True)[1]]
                n = x["n"][some]
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(n, out=offsets[1:])
                flat = np.repeat(x["first"][some] - offsets[:-1], n) + np.arange(offsets[-1])
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x["token"][flat].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(x["leaf"][some].view(np.int64)), pa.array(x["line"][some].view(np.int64)), tokens], ["leaf", "line", "tokens"])

    return task


def drain(tokens: np.ndarray, similarity: float, few: int | None = None) -> np.ndarray:
    """For each line of a leaf, in order, the index of the line that founded its template.

    Leaves of more than ``few`` lines (FEW_LINES) have their templates looked up, others compared one by one.
    """
    need = similarity * tokens.shape[1] - 1e-9
    if len(tokens) > (FEW_LINES if few is None else few):
        return _drain_by_words(tokens, math.ceil(need))
    templates = np.empty_like(tokens)
    founder: list[int] = []
    out = np.empty(len(tokens), np.int64)
    for i, t in enumerate(tokens):
        k = len(founder)
        fit = np.flatnonzero(np.count_nonzero(templates[:k] == t, axis=1) >= need) if k else ()
        if len(fit):
            j = fit[0]
            templates[j][templates[j] != t] = np.int64(_VARIABLE)
            out[i] = founder[j]
        else:
            templates[k] = t
            founder.append(i)
            out[i] = i
    return out


def _drain_by_words(tokens: np.ndarray, need: int) -> np.ndarray:
    varying = [c for c in range(tokens.shape[1]) if (tokens[:, c] != tokens[0, c]).any()]  # the leaf's own words never differ
    n, width = len(tokens), len(varying)
    probes = tokens.shape[1] - need + 1  # of so many words at least one is the same
    if width < probes:
        return np.zeros(n, np.int64)  # no two lines differ in more words than may
    words = np.empty((n, width), np.int32)  # the number of each word, counted over all columns
    slot, ends, variable = [np.zeros(1, np.int64)], 0, np.full(width, -1, np.int32)
    for k, c in enumerate(varying):
        values, of, many = np.unique(tokens[:, c], return_inverse=True, return_counts=True)
        words[:, k] = of + ends
        at = np.searchsorted(values, np.int64(_VARIABLE))
        if at < len(values) and values[at] == np.int64(_VARIABLE):
            variable[k] = at + ends
        ends += len(values)
        slot.append(many)
    start = np.cumsum(np.concatenate(slot))  # of each word's templates: as many as lines with it at most
    holds, held = np.empty(n * width, np.int32), np.zeros(ends, np.int32)
    changed: dict[int, list[int]] = {int(v): [] for v in variable if v >= 0}  # templates that came to have a variable
    templates, founder, out = np.empty((n, width), np.int32), np.empty(n, np.int64), np.empty(n, np.int64)
    need, made = need - (tokens.shape[1] - width), 0
    for i in range(n):
        t = words[i]
        many = held[t]
        for w in changed.keys() & set(t.tolist()) if changed else ():
            many[t == w] += len(changed[w])
        best = t[np.argpartition(many, probes - 1)[:probes]] if probes < width else t
        near = [holds[start[w] : start[w] + held[w]] for w in best.tolist() if held[w]] + [np.array(own, np.int32) for w in best.tolist() if (own := changed.get(w))]
        fit = np.concatenate(near) if near else holds[:0]
        if len(fit):
            fit = fit[np.count_nonzero(templates[fit] == t, axis=1) >= need]
        if len(fit):
            j = int(fit.min())
            for c in np.flatnonzero(templates[j] != t).tolist():
                if templates[j, c] != variable[c]:
                    templates[j, c] = variable[c]
                    if variable[c] >= 0:
                        changed[int(variable[c])].append(j)
        else:
            j = made
            made += 1
            templates[j], founder[j] = t, i
            holds[start[t] + held[t]] = j
            held[t] += 1
        out[i] = founder[j]
    return out


def _drain_task(similarity: float, few: int | None):
    def leaf_templates(rows: pa.Table):
        line = rows["line"].to_numpy()
        if len(line) == 1:
            return line, line
        lists = rows["tokens"].combine_chunks()
        width = len(lists[0])
        tokens = lists.flatten().to_numpy().reshape(len(line), width)
        return line, line[drain(tokens, similarity, few)]

    def task(batches):
        # rows come sorted by leaf; the last leaf of a batch may go on in the next
        held: list[pa.Table] = []
        schema = ["line", "template"]

        def done(table: pa.Table):
            leaf = table["leaf"].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
            parts = [leaf_templates(table.slice(a, b - a)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in (0, 1)], schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            leaf = table["leaf"].to_numpy()
            if held and held[0]["leaf"][0].as_py() != leaf[0]:
                yield done(pa.concat_tables(held))
                held = []
            begin = int(np.flatnonzero(leaf != leaf[-1])[-1]) + 1 if leaf[0] != leaf[-1] else 0
            if begin:
                yield done(pa.concat_tables([*held, table.slice(0, begin)]))
                held = []
            held.append(table.slice(begin))
        if held:
            yield done(pa.concat_tables(held))

    return task


def further_copies(lines: DataFrame, some: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id): of the documents in some (doc_id), all but the least of each set of lines."""
    own = lines.join(small(some, some.count()), "doc_id", "left_semi").select("doc_id", "line").distinct()
    keys = own.join(small(templates, templates.count()), "line", "left").select("doc_id", F.coalesce("template", "line").alias("key")).distinct()
    of_set = [F.count("*").alias("lines"), F.bit_xor(F.xxhash64("key")).alias("mix"), F.sum(F.xxhash64("key", F.lit(1)).cast("decimal(38,0)")).alias("total")]
    sets = cut(keys.groupBy("doc_id").agg(*of_set))
    least = sets.groupBy("lines", "mix", "total").agg(F.min("doc_id").alias("doc_id"))
    return sets.join(least, "doc_id", "left_anti").select("doc_id")


def recurring(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, leaf_lines: int | None = None) -> DataFrame:
    """(line, template): hashes of the lines whose templates recur; docs has doc_id and text.  leaf_lines: drain's few."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.where("doc_id is not null and text is not null")
    folder = own_folder(spark, "lines")
    map_arrow(named, _lines_task(depth), f"doc_id {kind}, leaf long, line long, n int, total int").write.parquet(folder)
    lines = spark.read.parquet(folder)
    leaves = cut(lines.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"))
    busy = small(leaves, leaves.count())
    hot = cut(lines.join(busy, "leaf", "left_semi").drop("leaf"))
    times = hot.groupBy("line").count()
    texts = map_arrow(named.select("text"), _tokens_task(depth), "leaf long, line long, tokens array<bigint>").join(busy, "leaf", "left_semi")
    distinct = cut(texts.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens")).join(times, "line").select("leaf", "line", "tokens", "count"))
    by_leaf = distinct.repartition("leaf").sortWithinPartitions("leaf", F.desc("count"), "line").select("leaf", "line", "tokens")
    templates = cut(map_arrow(by_leaf, _drain_task(similarity, leaf_lines), "line long, template long"))
    held = cut(hot.join(small(templates, templates.count()), "line").groupBy("doc_id", "template").agg(F.sum("n").alias("n"), F.max("total").alias("total")))
    often = held.groupBy("template").count().where(F.col("count") >= min_docs).select("template")
    copies = held.join(often, "template", "left_semi").groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("total").alias("total")).where("n * 2 >= total").select("doc_id")
    pages = held.join(further_copies(lines, cut(copies), templates), "doc_id", "left_anti")
    recur = pages.groupBy("template").count().where(F.col("count") >= min_docs).select("template")
    found = cut(templates.join(recur, "template", "left_semi").select("line", "template"))
    delete(spark, folder)
    return found


def _drop_task(folder: str, files: list[dict], names: list[str], depth: int, counter: str | None):
    def task(batches):
        gone = arrays.SortedSet(folder, files)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            dropped = np.zeros(len(texts), np.int64)
            whole = [t or "" for t in texts]
            for a, b in K.slices(whole):
                x = lines_of(whole[a:b], depth)
                hit = gone.has(x["line"].view(np.int64)) & (x["n"] > 0)
                for d in np.unique(x["doc"][hit]):
                    own = np.flatnonzero(x["doc"] == d) if len(x["doc"]) < 64 else np.arange(*np.searchsorted(x["doc"], [d, d + 1]))
                    texts[a + d] = "\n".join(line for line, h in zip(whole[a + d].split("\n"), hit[own], strict=True) if not h)
                    dropped[a + d] = np.count_nonzero(hit[own])
            columns = {"text": pa.array(texts, pa.string())}
            if counter:
                columns[counter] = pa.array(batch.column(batch.schema.get_field_index(counter)).to_numpy() + dropped)
            yield pa.RecordBatch.from_arrays([columns[n] if n in columns else batch.column(batch.schema.get_field_index(n)) for n in names], names)

    return task


def drop_lines(docs: DataFrame, lines: DataFrame, depth: int = DEPTH, counter: str | None = None, per_file: int = arrays.SET_ROWS) -> DataFrame:
    """docs, each text without the lines whose hashes are in ``lines``; the column ``counter``, if given, goes up by their number.

    The hashes lie in sorted files of the shared folder, which the workers map: none comes to the driver.
    """
    folder = own_folder(docs.sparkSession, "hashes")
    files = arrays.write_set(lines.select("line"), lines.count(), folder, per_file)
    return docs.mapInArrow(_drop_task(folder, files, docs.columns, depth, counter), docs.schema)


def clean(docs: DataFrame, **parameters) -> DataFrame:
    """docs without their recurring lines, all other columns and all rows as they were."""
    prepare(docs.sparkSession)
    return drop_lines(docs, recurring(pick(docs, doc_id="doc_id", text="text"), **parameters))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining text and the number of lines it lost."""
    prepare(spark)
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    return drop_lines(docs.withColumn("n_dropped", F.lit(0).cast("long")), recurring(docs), counter="n_dropped")
