"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to ``BUCKETS`` embeddings of ``DIM`` numbers, and so are their beginnings of 3, 4, 5 and 7 letters:
a word's vector is the sum of the five, so that forms of a stem that training never saw are still known.  Filters of widths 1, 2 and 3 run over a document's
whole word sequence, each filter's maximum over all places is one feature, and a logistic layer on the features
gives the score.  One coordinate of a bucket's embedding starts from how much likelier the bucket is in toxic
training texts, which a maximum over hundreds of random words would take long to find out.

Training happens on the driver, on a bounded sample: at most ``train_rows`` labelled documents of either class, drawn
evenly by language in the order of a hash of their ids.  Of each language's part a third is held out of training, or
``least`` documents if that is more and leaves half.  These and all labelled documents outside the sample are scored
in one pass; on them each language gets the threshold with the best F1, clean documents weighted to their share of
the language's labels.  What comes to the driver is counts by language, class and 1/256 of the score's logit.  A
language with fewer than ``least`` toxic documents that were not trained on gets the threshold over all languages.

Scoring reads every document in whole, in one pass without a shuffle.

Defined cases: null and empty texts and texts without a word score 0 and are never flagged; a null language counts
as ``und``; labels without doc_id or toxic value are ignored, and of contradictory labels of one document ``1``
counts; repeated rows are scored alike; without labels of both classes nothing is flagged; a text of any length is
scored in whole; empty tables give an empty result; of the documents doc_id, text and lang are read, of the labels
doc_id and toxic, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import kernel as K
from quern.llm.common import BROADCAST_ROWS, map_arrow, pick, prepare, small, texts_of

BITS, DIM, WIDTHS, FILTERS = 17, 8, (1, 2, 3), 8
BUCKETS = 1 << BITS
BEGINNINGS = (3, 4, 5, 7)
PARTS = 1 + len(BEGINNINGS)
TRAIN_ROWS, EPOCHS, BATCH, RATE, LEAST = 4000, 6, 32, 0.01, 15


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, PARTS) buckets of all words, two paddings after each text; where each text begins and ends in them.

    BUCKETS is the bucket of paddings and of a beginning that is the whole word; its embedding is 0.
    """
    pad = max(WIDTHS) - 1
    cps, bounds = K.code_points(texts)
    w = K.fold(cps)
    h, ws, we = K.words(cps)
    first = np.searchsorted(ws, bounds)
    n = np.diff(first)
    start = first[:-1] + np.arange(len(texts)) * pad
    out = np.full((len(h) + pad * len(texts), PARTS), BUCKETS, np.int32)
    place = np.arange(len(h)) + np.repeat(np.arange(len(texts)) * pad, n)
    out[place, 0] = h >> np.uint64(64 - BITS)
    sums = K.running(w)
    for k, size in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(we - ws > size)
        out[place[longer], k] = K.range_hashes(sums, ws[longer], ws[longer] + size) >> np.uint64(64 - BITS)
    return out, start, start + n


def vectors(embedding: np.ndarray, seq: np.ndarray) -> np.ndarray:
    x = embedding[seq[:, 0]]
    for k in range(1, PARTS):
        x += embedding[seq[:, k]]
    return x


class Network:
    def __init__(self, embedding: np.ndarray, filters: list[np.ndarray], bias: list[np.ndarray], out: np.ndarray, offset: float):
        self.embedding, self.filters, self.bias, self.out, self.offset = embedding, filters, bias, out, offset

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of each text; 0 for one without words."""
        result = np.zeros(len(texts))
        wide = np.concatenate([w.reshape(-1, DIM, FILTERS)[o] for w in self.filters for o in range(len(w) // DIM)], axis=1)
        for a, b in K.slices(texts):
            seq, start, end = sequences(texts[a:b])
            some = np.flatnonzero(end > start)
            if not len(some):
                continue
            y = vectors(self.embedding, seq) @ wide
            features, at = [], 0
            edges = np.stack([start[some], end[some]], axis=1).ravel()
            for w, bias in zip(WIDTHS, self.bias, strict=True):
                z = y[:, at : at + FILTERS]
                for o in range(1, w):
                    part = y[:, at + o * FILTERS : at + (o + 1) * FILTERS]
                    z = z[:-1] + part[len(y) - len(z) + 1 :]
                at += w * FILTERS
                z = np.concatenate([z, np.full((len(y) + 1 - len(z), FILTERS), -np.inf, np.float32)])
                features.append(np.maximum(np.maximum.reduceat(z, edges, axis=0)[::2] + bias, 0))
            logit = np.concatenate(features, axis=1) @ self.out + self.offset
            result[a + some] = 1 / (1 + np.exp(-logit.astype(np.float64)))
        return result


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    docs: list[np.ndarray] = []  # each text's buckets with its paddings
    df = np.zeros((2, BUCKETS), np.int64)
    for lo, hi in K.slices(texts):
        seq, start, _ = sequences(texts[lo:hi])
        docs += [x.copy() for x in np.split(seq, start[1:])]
    for x, c in zip(docs, toxic, strict=True):
        df[int(c), np.unique(x[x < BUCKETS])] += 1
    odds = np.log((df[1] + 4) / (np.sum(toxic == 1) + 8)) - np.log((df[0] + 4) / (np.sum(toxic == 0) + 8))
    e = np.zeros((BUCKETS + 1, DIM), np.float32)
    e[:-1] = rng.normal(0, 0.02, (BUCKETS, DIM))
    e[:-1, 0] = np.clip(odds, -4, 4) / 2
    params = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for p, w in zip(params, WIDTHS, strict=True):
        p[::DIM] = np.abs(p[::DIM]) + 0.3 / w
    bias = [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS]
    out = rng.normal(0.2, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    dense = [*params, *bias, out, np.zeros(1, np.float32)]
    mean, square = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            step += 1
            grads = [np.zeros_like(p) for p in dense]
            rows, updates = [], []
            for i in order[k : k + BATCH]:
                seq = docs[i]
                n = len(seq) - max(WIDTHS) + 1
                if n <= 0:
                    continue
                x = vectors(e, seq)
                features, places = [], []
                for w, p, b in zip(WIDTHS, params, bias, strict=True):
                    windows = np.concatenate([x[o : o + n] for o in range(w)], axis=1)
                    z = windows @ p + b
                    top = z.argmax(axis=0)
                    places.append((windows, top))
                    features.append(np.maximum(z[top, np.arange(FILTERS)], 0))
                f = np.concatenate(features)
                error = 1 / (1 + np.exp(-float(f @ dense[-2] + dense[-1][0]))) - float(toxic[i])
                grads[-2] += error * f
                grads[-1] += error
                back = error * dense[-2] * (f > 0)
                for j, (w, (windows, top)) in enumerate(zip(WIDTHS, places, strict=True)):
                    g = back[j * FILTERS : (j + 1) * FILTERS].astype(np.float32)
                    grads[j] += windows[top].T * g
                    grads[len(WIDTHS) + j] += g
                    deep = (params[j] * g).T.reshape(FILTERS, w, DIM)
                    for o in range(w):
                        rows.append(seq[top + o].ravel())
                        updates.append(np.repeat(deep[:, o], PARTS, axis=0))
            for p, g, m, v in zip(dense, grads, mean, square, strict=True):
                g /= BATCH
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            if rows:
                np.subtract.at(e, np.concatenate(rows), RATE * np.concatenate(updates))
                e[-1] = 0
    return Network(e, params, bias, dense[-2], float(dense[-1][0]))


def threshold(bins: np.ndarray, low: np.ndarray, high: np.ndarray, toxic: np.ndarray, counts: np.ndarray) -> float:
    """The score with the best F1, halfway to the next lower one; of each row a bin of scores, its ends, class and weight."""
    place = np.unique(-bins, return_inverse=True)[1]  # the highest scores first
    least, most = np.full(place.max() + 1, np.inf), np.full(place.max() + 1, -np.inf)
    np.minimum.at(least, place, low)
    np.maximum.at(most, place, high)
    right, wrong = (np.cumsum(np.bincount(place, np.where(toxic == c, counts, 0.0))) for c in (1, 0))
    best = int(np.argmax(2 * right / (right + wrong + right[-1])))
    return float((least[best] + most[best + 1]) / 2 if best + 1 < len(least) else least[best] / 2)


class Classifier:
    def __init__(self, network: Network | None, thresholds: dict[str, float], overall: float):
        self.network, self.thresholds, self.overall = network, thresholds, overall

    def limit(self, lang: str) -> float:
        return self.thresholds.get(lang, self.overall)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, least: int = LEAST) -> Classifier:
    """The classifier of a bounded sample of the labelled documents; None as its network if a class is missing."""
    spark = docs.sparkSession
    prepare(spark)
    own = pick(docs, doc_id="doc_id", text="text", lang="lang").where("text is not null")
    known = pick(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    langs = own.where("doc_id is not null").select("doc_id", F.when(F.col("lang") == "", None).otherwise(F.col("lang")).alias("lang")).groupBy("doc_id").agg(F.min(F.coalesce("lang", F.lit("und"))).alias("lang"))
    labelled = known.join(langs, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    turn = labelled.withColumn("turn", F.row_number().over(Window.partitionBy("toxic", "lang").orderBy(*order))).where(F.col("turn") <= train_rows)
    first = [turn.where(F.col("toxic") == c).orderBy("turn", *order).limit(train_rows).select("doc_id", "toxic") for c in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * train_rows ids
    rows = own.join(chosen, "doc_id").orderBy(*order, "text", "lang").limit(2 * train_rows).toArrow()
    texts, toxic = rows["text"].to_pylist(), rows["toxic"].to_numpy()
    groups: dict[tuple, dict] = {}  # ids by language and class, in order
    for i, x, c in zip(rows["doc_id"].to_pylist(), rows["lang"].to_pylist(), toxic.tolist(), strict=True):
        groups.setdefault((x or "und", c), {})[i] = None
    taken = {i for ids in groups.values() for i in list(ids)[: max(len(ids) // 3, min(least, len(ids) // 2))]}
    held = np.array([i in taken for i in rows["doc_id"].to_pylist()], bool)
    if min(np.sum(toxic[~held] == c) for c in (0, 1)) == 0:
        return Classifier(None, {}, 1.0)
    network = train([t for t, h in zip(texts, held, strict=True) if not h], toxic[~held])
    trained = spark.createDataFrame(pa.table({"doc_id": rows["doc_id"].filter(pa.array(~held))})).distinct()  # at most 2 * train_rows ids
    count = known.count()
    some = own.join(small(known.select("doc_id"), count), "doc_id", "left_semi") if count <= BROADCAST_ROWS else own  # no text is shuffled
    var = spark.sparkContext.broadcast(network)
    kind = own.schema["doc_id"].dataType.simpleString()
    marks = map_arrow(some, _bins_task(var), f"doc_id {kind}, lang string, score double, bin long").join(small(known, count), "doc_id")
    marks = marks.join(F.broadcast(trained.withColumn("fitted", F.lit(1))), "doc_id", "left")
    table = marks.groupBy("lang", "toxic", "bin", F.col("fitted").isNull().alias("held")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n")).toArrow()
    lang, (c, bins, low, high, n, free) = np.array(table["lang"].to_pylist(), object), (table[k].to_numpy() for k in ("toxic", "bin", "low", "high", "n", "held"))

    def limit(own: np.ndarray) -> float:
        """The threshold of the held-out rows among own, clean ones weighted to the share of clean labels in own."""
        part = own & free
        clean, hit = (np.sum(n[part & (c == k)]) for k in (0, 1))
        weight = max(1.0, np.sum(n[own & (c == 0)]) / np.sum(n[own & (c == 1)])) * hit / clean if clean else 1.0
        return threshold(bins[part], low[part], high[part], c[part], np.where(c[part] == 0, n[part] * weight, n[part]))

    if min(np.sum(n[free & (c == k)]) for k in (0, 1)) == 0:
        return Classifier(None, {}, 1.0)
    limits = {x: limit(lang == x) for x in sorted(set(lang)) if np.sum(n[free & (c == 1) & (lang == x)]) >= least}
    return Classifier(network, limits, limit(np.ones(len(n), bool)))


def _bins_task(var):
    def task(batches):
        for batch in batches:
            scores = var.value.scores(texts_of(batch))
            inside = np.clip(scores, 1e-18, 1 - 1e-16)
            bins = np.floor(256 * (np.log(inside) - np.log1p(-inside))).astype(np.int64)
            langs = [x or "und" for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(langs, pa.string()), pa.array(scores), pa.array(bins)], ["doc_id", "lang", "score", "bin"])

    return task


def _task(var):
    def task(batches):
        model = var.value
        for batch in batches:
            langs = [x or "und" for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()]
            scores = model.network.scores(texts_of(batch)) if model.network else np.zeros(len(langs))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(langs, pa.string()), pa.array(scores), pa.array([model.limit(x) for x in langs], pa.float64())], ["doc_id", "lang", "toxicity", "threshold"])

    return task


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, lang, toxicity, threshold) of every row of docs; at or over the threshold a document is toxic."""
    prepare(docs.sparkSession)
    own = pick(docs, doc_id="doc_id", text="text", lang="lang")
    var = docs.sparkSession.sparkContext.broadcast(classifier)  # 4 MB, whatever the data
    return map_arrow(own, _task(var), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang string, toxicity double, threshold double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier flags."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).where("toxicity >= threshold and toxicity > 0")
