"""Retrieval-quality metrics over a judged query set made of the benchmark table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.catalogue import register
from quern.functions import analysis
from quern.operators import batch, metrics
from quern.queries.base import D, begins, documents, find, toks
from quern.sources.io import table

# A ranking of documents for each source-language pair: by length, judged by their labels.
_R = """r AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents),
g AS (SELECT DISTINCT lang AS query_id, doc_id, 1 + quality + 2 * toxic * quality AS gain FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
j AS (SELECT query_id, doc_id, place, coalesce(gain, 0) AS gain FROM r LEFT JOIN g USING (query_id, doc_id)),
t AS (SELECT query_id, count(*) AS relevant FROM g GROUP BY query_id)"""


def _tables(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    ranked = docs.select(F.col("lang").alias("query_id"), "doc_id", F.row_number().over(w).alias("place"))
    good = docs.join(labels, "doc_id").where("quality = 1").select(F.col("lang").alias("query_id"), "doc_id", (1 + F.col("quality") + 2 * F.col("toxic") * F.col("quality")).alias("gain")).distinct()
    return metrics.judged(ranked, good), good.groupBy("query_id").agg(F.count("*").alias("relevant")), docs.select(F.col("lang").alias("query_id")).distinct()


def _rounded(df):
    return df.select("query_id", F.round("value", 6).alias("value"))


_P = "SELECT query_id, avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END) AS value FROM j WHERE place <= {k} GROUP BY query_id"
_RC = "SELECT t.query_id, coalesce(sum(CASE WHEN gain > 0 AND place <= {k} THEN 1 ELSE 0 END), 0) / max(relevant) AS value FROM t LEFT JOIN j ON j.query_id = t.query_id GROUP BY t.query_id"


@register("met_precision", f"WITH {_R} SELECT query_id, round(value, 6) AS value FROM ({_P.format(k=20)})")
def precision(spark, sf):
    return _rounded(metrics.precision_at(_tables(spark, sf)[0], 20))


@register("met_precision_at_1", f"WITH {_R} SELECT query_id, round(value, 6) AS value FROM ({_P.format(k=1)})")
def precision_at_1(spark, sf):
    return _rounded(metrics.precision_at(_tables(spark, sf)[0], 1))


@register("met_recall", f"WITH {_R} SELECT query_id, round(value, 6) AS value FROM ({_RC.format(k=20)})")
def recall(spark, sf):
    j, totals, _ = _tables(spark, sf)
    return _rounded(metrics.recall_at(j, totals, 20))


@register("met_f1", f"WITH {_R} SELECT query_id, round(CASE WHEN p.value + r.value > 0 THEN 2 * p.value * r.value / (p.value + r.value) ELSE 0 END, 6) AS value FROM ({_P.format(k=20)}) p JOIN ({_RC.format(k=20)}) r USING (query_id)")
def f1(spark, sf):
    j, totals, _ = _tables(spark, sf)
    return _rounded(metrics.f1_at(j, totals, 20))


@register("met_ndcg", f"""WITH {_R}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, place) AS best FROM j WHERE place <= 20)
SELECT query_id, round(CASE WHEN sum(gain / log2(best + 1)) > 0 THEN sum(gain / log2(place + 1)) / sum(gain / log2(best + 1)) ELSE 0 END, 6) AS value FROM b GROUP BY query_id""")
def ndcg(spark, sf):
    return _rounded(metrics.ndcg_at(_tables(spark, sf)[0], 20))


@register("met_first_relevant", f"WITH {_R} SELECT query_id, CAST(min(place) AS INT) AS place FROM j WHERE gain > 0 GROUP BY query_id")
def first_relevant(spark, sf):
    return metrics.first_relevant(_tables(spark, sf)[0])


@register("met_average_precision", f"""WITH {_R}, h AS (SELECT *, sum(CASE WHEN gain > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY place) AS hits FROM j WHERE place <= 20)
SELECT query_id, round(CASE WHEN count(*) FILTER (gain > 0) > 0 THEN sum(CASE WHEN gain > 0 THEN hits / place ELSE 0 END) / least(count(*) FILTER (gain > 0), 20) ELSE 0 END, 6) AS value FROM h GROUP BY query_id""")
def average_precision(spark, sf):
    return _rounded(metrics.average_precision_at(_tables(spark, sf)[0], 20))


@register("met_reciprocal_rank", f"WITH {_R} SELECT query_id, round(coalesce(1.0 / min(place) FILTER (gain > 0), 0), 6) AS value FROM j GROUP BY query_id")
def reciprocal_rank(spark, sf):
    j, _, queries = _tables(spark, sf)
    return _rounded(metrics.reciprocal_rank(j, queries))


@register("met_mean_reciprocal_rank", f"WITH {_R} SELECT round(avg(v), 6) AS value FROM (SELECT coalesce(1.0 / min(place) FILTER (gain > 0), 0) AS v FROM j GROUP BY query_id)")
def mean_reciprocal_rank(spark, sf):
    j, _, queries = _tables(spark, sf)
    return metrics.mean(metrics.reciprocal_rank(j, queries)).select(F.round("value", 6).alias("value"))


@register("met_suggestions", """
WITH e AS (SELECT DISTINCT lower(p_type) AS expected, substr(lower(p_type), 2) AS query FROM part), w AS (SELECT DISTINCT lower(p_type) AS word FROM part),
s AS (SELECT query, expected, word, row_number() OVER (PARTITION BY query ORDER BY word) AS place FROM e, w),
q AS (SELECT query,
  avg(CASE WHEN place <= 5 THEN CASE WHEN levenshtein(query, word) <= 2 THEN 1.0 ELSE 0.0 END END) AS p,
  avg(CASE WHEN place <= 5 THEN CASE WHEN levenshtein(query, word) <= 2 THEN least(1.0, (2 - levenshtein(query, word)) / 2 + 0.2) ELSE 0.0 END END) AS sp,
  max(CASE WHEN place = 1 AND word = expected THEN 1.0 ELSE 0.0 END) AS t, 1.0 AS a,
  max(CASE WHEN levenshtein(query, word) <= 2 THEN 1.0 ELSE 0.0 END) AS c, max(CASE WHEN word = expected THEN 1.0 ELSE 0.0 END) AS x, 1.0 / min(place) FILTER (word = expected) AS m FROM s GROUP BY query)
SELECT round(avg(p), 6) AS precision, round(avg(sp), 6) AS script_precision, round(avg(t), 6) AS top1, round(avg(a), 6) AS coverage_any, round(avg(c), 6) AS coverage_correct, round(avg(x), 6) AS coverage_expected, round(avg(m), 6) AS mrr FROM q""")
def suggestions(spark, sf):
    types = table(spark, sf, "part").select(F.lower("p_type").alias("word")).distinct()
    expected = types.select(F.expr("substring(word, 2)").alias("query"), F.col("word").alias("expected"))
    # every word is shown for every query: the words as one list a row (the types of a catalogue are a few)
    words = types.agg(F.sort_array(F.collect_set("word")).alias("words")).select("words", F.lit(1).alias("k"))
    shown = expected.select("query", F.lit(1).alias("k")).join(F.broadcast(words), "k").select("query", F.posexplode("words").alias("place", "word"))
    return metrics.suggestion_metrics(shown.withColumn("place", F.col("place") + 1), expected)


@register("met_latency_percentiles", """
SELECT max(value) FILTER (k = ceil(n * 0.5)) AS p50, max(value) FILTER (k = ceil(n * 0.95)) AS p95, max(value) FILTER (k = ceil(n * 0.99)) AS p99
FROM (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events)""")
def latency_percentiles(spark, sf):
    return metrics.percentiles(table(spark, sf, "events"), "value")


@register("met_mean_sigma", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sigma FROM events GROUP BY event_type")
def mean_sigma(spark, sf):
    return metrics.mean_and_sigma(table(spark, sf, "events"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"))


@register("met_empty_rate", rf"""
WITH {D}, q AS (SELECT item_id AS query_id, list_distinct({toks('text')}) AS qt FROM benchmark),
qt AS (SELECT query_id, len(qt) AS n, unnest(qt) AS term FROM q), po AS (SELECT DISTINCT doc_id, unnest(tok) AS term FROM d),
a AS (SELECT DISTINCT query_id FROM qt WHERE term IN (SELECT term FROM po)),
h AS (SELECT DISTINCT query_id FROM (SELECT query_id, doc_id FROM qt JOIN po USING (term) GROUP BY query_id, doc_id, n HAVING count(*) = n))
SELECT round(coalesce(avg(CASE WHEN h.query_id IS NULL THEN 1.0 ELSE 0.0 END), 0), 6) AS value FROM a LEFT JOIN h USING (query_id)""")
def empty_rate(spark, sf):
    index, items = documents(spark, sf), table(spark, sf, "benchmark")
    answered = batch.batch_topk(index, items, "item_id", "text", 1, "and")
    queries = items.select(F.col("item_id").alias("query_id"), analysis.analyze(F.col("text")).alias("query"))
    return metrics.empty_rate(queries, answered, index.table("term_df")).select(F.round("value", 6).alias("value"))


_PAIRS = [("étré", "etre"), ("WORTHLESS", "worthless"), ("idiot", "clown")]


@register("met_accent_tolerance", f"WITH {D} SELECT * FROM (VALUES ('étré', true), ('WORTHLESS', true), ('idiot', (SELECT count(*) = 0 FROM d WHERE ({begins('idiot')}) <> ({begins('clown')})))) t(query, tolerant)")
def accent_tolerance(spark, sf):
    index, found = documents(spark, sf), None
    for q in dict.fromkeys(x for p in _PAIRS for x in p):
        one = find(index, q).ids().select(F.lit(q).alias("query"), "doc_id")
        found = one if found is None else found.unionByName(one)
    return metrics.tolerance(spark.createDataFrame(_PAIRS, "query string, variant string"), found)


@register("met_text", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_type || ' ' || p_brand END AS text FROM part")
def metric_text(spark, sf):
    text = metrics.metric_text(F.when(F.col("p_size") > 25, F.col("p_name")), [F.lit(""), F.lit(" ")], [F.col("p_type"), F.col("p_brand")], None)
    return table(spark, sf, "part").select("p_partkey", text.alias("text"))


@register("met_capacity", """
SELECT p_partkey AS volume, p_retailprice AS queries_per_s, p_size * 1024 AS index_bytes, 10.0 + p_size AS docs_per_s,
  CAST(round(p_retailprice * 86400 * 0.30) AS BIGINT) AS requests_per_day, round(CAST(p_size AS DOUBLE) / p_partkey, 3) AS kb_per_doc, round(p_partkey / CAST(10.0 + p_size AS DOUBLE), 3) AS rebuild_s
FROM part WHERE p_partkey > 0""")
def capacity(spark, sf):
    rates = table(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("volume"), F.col("p_retailprice").alias("queries_per_s"), (F.col("p_size") * 1024).alias("index_bytes"), (F.lit(10.0) + F.col("p_size")).alias("docs_per_s"))
    return metrics.capacity(rates)


@register("met_scaled_data", "SELECT doc_id || '-' || copy AS doc_id, text || CASE WHEN copy > 0 THEN ' ' || copy ELSE '' END AS text FROM documents, range(3) r(copy)")
def scaled_data(spark, sf):
    return metrics.scaled(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 3)


@register("met_relevant", r"""
SELECT doc_id, len(list_filter(list_filter(['the', 'idiot'], lambda w: true), lambda w: NOT list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), w))) = 0 AS relevant FROM documents""")
def relevant(spark, sf):
    return table(spark, sf, "documents").select("doc_id", metrics.relevant(F.col("text"), F.lit("the idiot")).alias("relevant"))


@register("met_ranking_holds", """
WITH r AS (SELECT lang AS query_id, doc_id FROM documents WHERE n_chars > 2000), must AS (SELECT lang AS query_id, doc_id FROM documents WHERE n_chars > 20000), must_not AS (SELECT lang AS query_id, doc_id FROM documents WHERE n_chars < 10),
bad AS (SELECT DISTINCT query_id FROM (SELECT query_id FROM must EXCEPT ALL SELECT must.query_id FROM must JOIN r USING (query_id, doc_id) UNION ALL SELECT must_not.query_id FROM must_not JOIN r USING (query_id, doc_id)))
SELECT query_id, query_id NOT IN (SELECT query_id FROM bad) AS ok FROM (SELECT query_id FROM must UNION SELECT query_id FROM must_not)""")
def ranking_holds(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("query_id"), "doc_id", "n_chars")
    pick = lambda c: docs.where(c).select("query_id", "doc_id")
    return metrics.ranking_holds(pick("n_chars > 2000"), pick("n_chars > 20000"), pick("n_chars < 10"))
