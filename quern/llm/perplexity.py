"""Quality rule: n-gram perplexity under a modified Kneser-Ney model of each language.

The model is a character 5-gram model.  Characters, not words: on a crawl the table of word n-grams is about as
large as the crawl itself and remembers copied documents by heart, while character n-grams tell prose from
symbol noise, shouting, lists and repetition, and copies hardly move them.

* **Counting.**  Every document of the table is read in whole.  Each task turns its texts into packed 5-grams of
  symbols (12 bits each), sorts and counts them in numpy, and Spark adds the counts up by (language, n-gram).  A
  character up to U+077C is one symbol, any other two, which no other character shares: so Chinese text is judged by
  two and a half characters at a time, and no two characters are confused.
* **Smoothing.**  Continuation counts, discounts D1, D2, D3+ and interpolation weights of all orders are Spark
  aggregates and joins over the table of distinct n-grams.
* **Model.**  The n-grams of each language and order are sorted by a 64-bit hash over the cluster and written to the
  shared folder as arrays of hashes, log-probabilities and back-off weights with an index by leading bits, a file for
  each range of at most ``segment`` hashes.  Workers map the files into memory; the driver holds their names only.
  Nothing is pruned.
* **Bands.**  A document's score is its mean negative log-probability a symbol in nats, shrunk towards its
  language's mean as if ``prior_chars`` more symbols had been seen, so that short texts aren't rejected for
  their shortness.  The bands of a language are median - ``low`` and median + ``high`` times the median absolute
  deviation, over all its documents; perplexity is exp(score).

Defined cases: a null or unknown language counts as language ``und``; null and empty texts have no perplexity and
are rejected; every row is judged by itself, whatever its doc_id, so repeated rows get equal scores, and of rows that
share a doc_id or have none each stays or goes by its own text; a text of any length is scored in whole; a language
of fewer than ``least_docs`` texts has no bands and keeps all; an empty table gives an empty result; columns besides
doc_id, text and lang are passed on as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import arrays
from quern.llm import kernel as K
from quern.llm.common import column, cut, delete, map_arrow, new_name, own_folder, pick, prepare, row_key, texts_of, without_rows

ORDER = 5
_BITS = 12
_BOS, _EOS = 1, 2
PRIOR_CHARS, LOW, HIGH, LEAST_DOCS = 400, 8.0, 4.5, 50
#: Hashes of one file of the model; at least FILES ranges are made if they have LEAST_HASHES each.
SEGMENT, FILES, LEAST_HASHES = 4_000_000, 12, 100_000
_DIRECT, _LEAD, _TRAIL = 1917, 1920, 3008
_U = np.uint64


def symbols(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The symbols of code points, all above 2, and how many each has (None: one)."""
    wide = cps >= _DIRECT
    if not wide.any():
        return cps.astype(_U) + _U(3), None
    n = 1 + wide.astype(np.int64)
    first = np.cumsum(n) - n
    out = np.empty(len(cps) + np.count_nonzero(wide), _U)
    out[first] = np.where(wide, _LEAD + (cps >> 10), cps + 3)
    out[first[wide] + 1] = _TRAIL + (cps[wide] & 1023)
    return out, n


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed 5-gram that ends at each symbol and at the end of each text; bounds of the texts in them.

    A run of one repeated character that isn't a letter, digit or mark counts as one: "!!!" isn't three events.
    """
    pad = ORDER - 1
    cps, starts = K.code_points(texts)
    once = np.ones(len(cps), bool)
    once[1:] = (cps[1:] != cps[:-1]) | (K.fold(cps[1:]) != 0)
    ends = starts[1:] - 1
    once[ends] = True
    once[starts[:-1]] = True
    sym, n = symbols(cps[once])
    each = once.astype(np.int64)
    if n is not None:
        each[once] = n
    kept = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(each, out=kept[1:])
    bounds = kept[starts]
    sym[bounds[1:] - 1] = _EOS
    padded = np.full(bounds[-1] + pad * len(texts), _BOS, _U)
    at = np.arange(bounds[-1]) + np.repeat(np.arange(1, len(texts) + 1) * pad, np.diff(bounds))
    padded[at] = sym
    g = padded[at]
    for k in range(1, ORDER):
        g |= padded[at - k] << _U(_BITS * k)
    return g, bounds


def _count(sorted_grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], sorted_grams[1:] != sorted_grams[:-1]]))
    if weights is None:
        return sorted_grams[first], np.diff(np.append(first, len(sorted_grams)))
    return sorted_grams[first], np.add.reduceat(weights, first)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(g, kind="stable")
    return _count(g[order], n[order])


def by_language(batch: pa.RecordBatch) -> dict[str, list[int]]:
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(batch.column(batch.schema.get_field_index("lang")).to_pylist()):
        rows.setdefault(lang or "und", []).append(i)
    return rows


def _count_task(batches):
    have: dict[str, list] = {}
    held = 0

    def out(parts):
        for lang, x in parts.items():
            g, n = _merge(x)
            for a in range(0, len(g), 100_000):
                part = g[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part.astype(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64))], ["lang", "g", "n"])

    for batch in batches:
        texts = texts_of(batch)
        for lang, rows in by_language(batch).items():
            own = [texts[i] for i in rows if texts[i]]
            for a, b in K.slices(own):
                have.setdefault(lang, []).append(_count(np.sort(grams(own[a:b])[0])))
        held += 1
        if held % 4 == 0 or sum(len(p[0]) for x in have.values() for p in x) > 3_000_000:
            have = {lang: [_merge(x)] for lang, x in have.items()}
            if sum(len(x[0][0]) for x in have.values()) > 6_000_000:
                yield from out(have)
                have = {}
    yield from out(have)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, g, n): occurrences of every 5-gram of every text; docs has text and lang."""
    partial = map_arrow(docs.select("text", "lang"), _count_task, "lang string, g long, n long")
    return partial.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _discounts(row) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (float(row[f"t{i}"] or 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(k, lang, g, lp, bow): interpolated log-probability of each k-gram of the counts, and its weight as a context.

    ``counts`` holds the highest order and is read several times, so it should be written.
    """
    spark = counts.sparkSession
    tables, n = {ORDER: counts}, counts
    for k in range(ORDER - 1, 0, -1):
        n = n.groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << _BITS * k) - 1)).alias("g")).agg(F.count("*").alias("n"))
        n = tables[k] = cut(n)
    of_counts = None
    for k, t in tables.items():
        c = t.groupBy("lang").agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"t{i}") for i in (1, 2, 3, 4)], F.count("*").alias("types")).withColumn("k", F.lit(k))
        of_counts = c if of_counts is None else of_counts.unionByName(c)
    rows = of_counts.collect()  # languages x orders
    if not rows:
        return spark.createDataFrame([], "k int, lang string, g long, lp double, bow double")
    consts = F.broadcast(spark.createDataFrame([(r["k"], r["lang"], *_discounts(r), int(r["types"])) for r in rows], "k int, lang string, d1 double, d2 double, d3 double, types long"))
    lower, all_orders = None, None
    for k in range(1, ORDER + 1):
        c = consts.where(F.col("k") == k).drop("k")
        own = Window.partitionBy("lang", "ctx")
        d = lambda n: F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        t = tables[k].withColumn("ctx", F.shiftright("g", _BITS)).join(c, "lang")
        total, taken = F.sum("n").over(own), F.sum(d(F.col("n"))).over(own)
        t = t.select("lang", "g", "ctx", ((F.col("n") - d(F.col("n"))) / total).alias("own"), (taken / total).alias("gamma"), "types")
        if lower is None:
            t = t.withColumn("p", F.col("own") + F.col("gamma") / (F.col("types") + 1))
        else:
            suffix = F.col("g").bitwiseAND(F.lit((1 << _BITS * (k - 1)) - 1))
            low = lower.select("lang", F.col("g").alias("suffix"), F.col("p").alias("q"))
            t = t.withColumn("suffix", suffix).join(low, ["lang", "suffix"]).withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        t = cut(t.select("lang", "g", "ctx", "gamma", "p"))
        if lower is not None or k > 1:  # the weight of a context is kept with the context's own entry, one order below
            bow = t.groupBy("lang", F.col("ctx").alias("g")).agg(F.first("gamma").alias("gamma"))
            kept = lower.select("lang", "g", "p").join(bow, ["lang", "g"], "full")
            level = kept.select(F.lit(k - 1).alias("k"), "lang", "g", F.log("p").alias("lp"), F.log("gamma").alias("bow"))
            all_orders = level if all_orders is None else all_orders.unionByName(level)
        else:
            base = t.groupBy("lang").agg(F.first("gamma").alias("gamma"), F.count("*").alias("v"))
            all_orders = base.select(F.lit(0).alias("k"), "lang", F.lit(0).cast("long").alias("g"), F.log(F.lit(1.0) / (F.col("v") + 1)).alias("lp"), F.log("gamma").alias("bow"))
        lower = t
    return all_orders.unionByName(lower.select(F.lit(ORDER).alias("k"), "lang", "g", F.log("p").alias("lp"), F.lit(None).cast("double").alias("bow")))


class SortedHashes:
    """Values under 64-bit hashes in sorted arrays, found through an index of the leading bits of their range."""

    @staticmethod
    def layout(h: np.ndarray, *values: np.ndarray) -> tuple[list[np.ndarray], dict[str, int]]:
        """The arrays of sorted hashes and their values, and what a reader must know of them."""
        width = int(h[-1] - h[0])
        bits = min(len(h).bit_length(), 26)
        shift = max(0, width.bit_length() - bits)
        index = np.searchsorted((h - h[0]) >> _U(shift), np.arange((width >> shift) + 2, dtype=_U)).astype(np.int32)
        return [h, *[v.astype(np.float32) for v in values], index], {"n": len(h), "lo": int(h[0].view(np.int64)), "hi": int(h[-1].view(np.int64)), "shift": shift, "slots": len(index)}

    def __init__(self, folder: str, rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["lo"] % 2**64)
        self.low = np.array([r["lo"] % 2**64 for r in rows], _U)
        self.high = [_U(r["hi"] % 2**64) for r in rows]
        self.shift = [_U(r["shift"]) for r in rows]
        self.parts = [arrays.read(folder, r["file"], [(_U, r["n"]), (np.float32, r["n"]), (np.float32, r["n"]), (np.int32, r["slots"])]) for r in rows]

    def _part(self, p: int, h: np.ndarray, value: int) -> np.ndarray:
        keys, index = self.parts[p][0], self.parts[p][3]
        out = np.full(len(h), np.nan, np.float32)
        some = np.flatnonzero((h >= self.low[p]) & (h <= self.high[p]))
        own = h[some]
        at = index[((own - self.low[p]) >> self.shift[p]).astype(np.int64)]
        left = np.flatnonzero(keys[at] < own)
        while len(left):  # the last key of the range is not less than any of these
            at[left] += 1
            left = left[keys[at[left]] < own[left]]
        hit = keys[at] == own
        out[some[hit]] = self.parts[p][1 + value][at[hit]]
        return out

    def find(self, h: np.ndarray, value: int) -> np.ndarray:
        """The first (0) or second (1) value of each hash; NaN where there is none."""
        if len(self.parts) == 1:
            return self._part(0, h, value)
        of = np.maximum(np.searchsorted(self.low, h, "right") - 1, 0)
        out = np.full(len(h), np.nan, np.float32)
        for p in range(len(self.parts)):
            own = np.flatnonzero(of == p)
            if len(own):
                out[own] = self._part(p, h[own], value)
        return out


_FILES = "lang string, k int, n long, lo long, hi long, shift int, slots long, file string"
_SIGN = np.int64(-(2**63))


def _hash_task(batches):
    for batch in batches:
        g = batch.column(batch.schema.get_field_index("g")).to_numpy()
        h = K.mix(g.view(_U)).view(np.int64) ^ _SIGN  # in the order of signed numbers
        yield pa.RecordBatch.from_arrays([pa.array(h) if c == "g" else batch.column(i) for i, c in enumerate(batch.schema.names)], ["h" if c == "g" else c for c in batch.schema.names])


def _write_task(folder: str, segment: int):
    def task(batches):
        held: list[pa.Table] = []
        key = None

        def done():
            if not held:
                return
            t = pa.concat_tables(held).combine_chunks()
            held.clear()
            for a in range(0, t.num_rows, segment):
                part = t.slice(a, segment)
                h = (part["h"].to_numpy() ^ _SIGN).view(_U)
                data, about = SortedHashes.layout(h, part["lp"].to_numpy(), part["bow"].to_numpy())
                yield {"lang": key[0], "k": key[1], **about, "file": arrays.write(folder, data)}

        rows = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lang, k = np.array(table["lang"].to_pylist(), object), table["k"].to_numpy()
            edge = [0, *(np.flatnonzero((lang[1:] != lang[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), len(k)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if a == b:
                    continue
                if key != (lang[a], int(k[a])):
                    rows += done()
                    key = (lang[a], int(k[a]))
                held.append(table.slice(a, b - a))
        rows += done()
        kinds = {"lang": pa.string(), "k": pa.int32(), "shift": pa.int32(), "file": pa.string()}
        yield pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.int64())) for c in _FILES.split(", ")]))

    return task


def write_model(model: DataFrame, folder: str, segment: int = SEGMENT) -> list[dict]:
    """The model's rows as sorted hash arrays in folder: what to know of each file."""
    entries = model.count()
    parts = max(1, -(-entries // segment), min(FILES, entries // LEAST_HASHES))
    hashed = map_arrow(model.select("lang", "k", "g", F.col("lp").cast("float"), F.col("bow").cast("float")), _hash_task, "lang string, k int, h long, lp float, bow float")
    ranged = hashed.repartitionByRange(parts, "lang", "k", "h").sortWithinPartitions("lang", "k", "h")
    return [r.asDict() for r in map_arrow(ranged, _write_task(folder, segment), _FILES).collect()]  # a row a file


_OPEN: dict[str, dict[str, dict[int, SortedHashes]]] = {}


def open_model(folder: str, files: list[dict]) -> dict[str, dict[int, SortedHashes]]:
    """The model of some files, by language and order; a worker keeps the last one open."""
    if folder not in _OPEN:
        _OPEN.clear()
        rows: dict[tuple[str, int], list[dict]] = {}
        for r in files:
            rows.setdefault((r["lang"], r["k"]), []).append(r)
        model: dict[str, dict[int, SortedHashes]] = {}
        for (lang, k), own in rows.items():
            model.setdefault(lang, {})[k] = SortedHashes(folder, own)
        _OPEN[folder] = model
    return _OPEN[folder]


def log_probability(model: dict[int, SortedHashes], g: np.ndarray) -> np.ndarray:
    """Natural log-probability of the last symbol of each packed 5-gram, backing off where it is unseen."""
    lp = np.zeros(len(g), np.float32)
    todo, penalty = None, None
    for k in range(ORDER, -1, -1):
        mask = _U((1 << _BITS * k) - 1)
        x = g if todo is None else g[todo]
        if k < ORDER:  # the weight of the context of the order above, if that context was seen
            w = model[k].find(K.mix((x >> _U(_BITS)) & mask), 1)
            w[np.isnan(w)] = 0
            penalty = w if penalty is None else penalty + w
        v = model[k].find(K.mix(x & mask), 0)
        seen = ~np.isnan(v)
        if todo is None:
            lp[seen] = v[seen]
            todo = np.flatnonzero(~seen)
        else:
            lp[todo[seen]] = v[seen] + penalty[seen]
            todo, penalty = todo[~seen], penalty[~seen]
        if not len(todo):
            break
    return lp


def _score_task(folder, files, columns):
    def task(batches):
        model = open_model(folder, files)
        for batch in batches:
            texts = texts_of(batch)
            nll = np.zeros(len(texts))
            n = np.zeros(len(texts), np.int64)
            for lang, rows in by_language(batch).items():
                rows = [i for i in rows if texts[i]]
                own = [texts[i] for i in rows]
                for a, b in K.slices(own):
                    g, bounds = grams(own[a:b])
                    lp = log_probability(model[lang], g)
                    n[rows[a:b]] = np.diff(bounds) - 1
                    nll[rows[a:b]] = -K.segment_sums(lp.astype(np.float64), bounds)
            keys = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(nll), pa.array(n)], [*columns, "nll", "n"])

    return task


def scores(docs: DataFrame, folder: str, files: list[dict]) -> DataFrame:
    """docs without their text (text, lang and others), with nll in nats over n symbols and the end."""
    docs = docs.withColumn("lang", F.when(F.col("lang") != "", F.col("lang")).otherwise("und"))
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(docs, _score_task(folder, files, names), f"{schema}, nll double, n long")


def _judged(own: DataFrame, prior_chars: int = PRIOR_CHARS, low: float = LOW, high: float = HIGH, least_docs: int = LEAST_DOCS, segment: int = SEGMENT) -> DataFrame:
    spark = own.sparkSession
    folder = own_folder(spark, "ngrams")
    files = write_model(cut(kneser_ney(cut(ngram_counts(own)))), folder, segment)
    scored = cut(scores(own, folder, files))
    delete(spark, folder)
    mean = scored.where("n > 0").groupBy("lang").agg((F.sum("nll") / F.sum(F.col("n") + 1)).alias("mu"), F.count("*").alias("docs"))
    x = (F.col("nll") + prior_chars * F.col("mu")) / (F.col("n") + 1 + prior_chars)
    shrunk = scored.join(F.broadcast(mean), "lang", "left").withColumn("score", F.when(F.col("n") > 0, x))
    middle = shrunk.groupBy("lang").agg(F.percentile_approx("score", 0.5, 10000).alias("med"))
    spread = shrunk.join(F.broadcast(middle), "lang").groupBy("lang", "med").agg(F.percentile_approx(F.abs(F.col("score") - F.col("med")), 0.5, 10000).alias("mad"))
    bands = spread.select("lang", (F.col("med") - low * F.col("mad")).alias("lo"), (F.col("med") + high * F.col("mad")).alias("hi"))
    out = shrunk.join(F.broadcast(bands), "lang", "left")
    inside = F.col("score").between(F.col("lo"), F.col("hi")) | (F.col("docs") < least_docs)
    names = [c for c in own.columns if c not in ("lang", "text")]
    return out.select(*names, "lang", F.exp("score").alias("perplexity"), F.exp("lo").alias("lower"), F.exp("hi").alias("upper"), F.coalesce(F.col("score").isNotNull() & inside, F.lit(False)).alias("kept"))


def judged(docs: DataFrame, **parameters) -> DataFrame:
    """Each row of docs (doc_id, text, lang) with its perplexity, its language's bands and whether it is kept.

    (doc_id, lang, perplexity, lower, upper, kept); parameters: prior_chars, low, high, least_docs, segment.
    """
    prepare(docs.sparkSession)
    return _judged(pick(docs, doc_id="doc_id", text="text", lang="lang"), **parameters)


def keep(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the rows that the perplexity bands reject."""
    prepare(docs.sparkSession)
    keys = row_key(column(docs, "text"), column(docs, "lang"))
    k = [new_name("key"), new_name("key")]
    own = docs.select(column(docs, "text").alias("text"), column(docs, "lang").alias("lang"), *[x.alias(n) for x, n in zip(keys, k, strict=True)])
    return without_rows(docs, ("text", "lang"), _judged(own, **parameters).where("not kept").select(*k))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their perplexity and bands."""
    kept = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.where("kept").drop("kept")
