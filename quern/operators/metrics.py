"""Retrieval quality over tables: ranked results joined with judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import analysis

_BY = "query_id"


def judged(results: DataFrame, judgements: DataFrame) -> DataFrame:
    """results (query_id, place, doc_id) with gain, 0 where there is no judgement (query_id, doc_id, gain)."""
    return results.join(judgements, [_BY, "doc_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))


def relevant(text: Column, query: Column) -> Column:
    """Whether every word of the query (2 letters or more) is a word of the text."""
    wanted = F.array_distinct(F.filter(analysis.tokens(query), lambda t: F.length(t) >= 2))
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, analysis.tokens(text))) == 0)


def precision_at(j: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, value): relevant among the first k, over those returned among them."""
    return j.where(F.col("place") <= k).groupBy(_BY).agg(F.avg((F.col("gain") > 0).cast("double")).alias("value"))


def recall_at(j: DataFrame, totals: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, value): relevant among the first k, over all relevant (query_id, relevant)."""
    found = j.where(F.col("place") <= k).groupBy(_BY).agg(F.sum((F.col("gain") > 0).cast("long")).alias("found"))
    return totals.join(found, _BY, "left").select(_BY, F.when(F.col("relevant") > 0, F.coalesce("found", F.lit(0)) / F.col("relevant")).otherwise(0.0).alias("value"))


def f1_at(j: DataFrame, totals: DataFrame, k: int = 5) -> DataFrame:
    p, r = precision_at(j, k).withColumnRenamed("value", "p"), recall_at(j, totals, k).withColumnRenamed("value", "r")
    both = r.join(p, _BY, "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return both.select(_BY, F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0).alias("value"))


def ndcg_at(j: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, value): discounted gain of the first k, over that of the same gains in the best order."""
    w = Window.partitionBy(_BY).orderBy(F.desc("gain"), "place")
    top = j.where(F.col("place") <= k).withColumn("best", F.row_number().over(w))
    dcg = top.groupBy(_BY).agg(F.sum(F.col("gain") / F.log2(F.col("place") + 1)).alias("dcg"), F.sum(F.col("gain") / F.log2(F.col("best") + 1)).alias("ideal"))
    return dcg.select(_BY, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("value"))


def first_relevant(j: DataFrame) -> DataFrame:
    """(query_id, place) of the first relevant result, for queries that have one."""
    return j.where("gain > 0").groupBy(_BY).agg(F.min("place").alias("place"))


def average_precision_at(j: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, value): mean of the precision at each relevant place among the first k."""
    w = Window.partitionBy(_BY).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("gain") > 0).cast("int")
    top = j.where(F.col("place") <= k).withColumn("hits", F.sum(hit).over(w)).withColumn("hit", hit)
    sums = top.groupBy(_BY).agg(F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("place")).otherwise(0.0)).alias("s"), F.sum("hit").alias("n"))
    return sums.select(_BY, F.when(F.col("n") > 0, F.col("s") / F.least("n", F.lit(k))).otherwise(0.0).alias("value"))


def reciprocal_rank(j: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, value): 1 / place of the first relevant result; 0 for a query without."""
    return queries.select(_BY).join(first_relevant(j), _BY, "left").select(_BY, F.coalesce(1 / F.col("place"), F.lit(0.0)).alias("value"))


def mean(values: DataFrame) -> DataFrame:
    return values.agg(F.avg("value").alias("value"))


def empty_rate(queries: DataFrame, results: DataFrame, existing: DataFrame) -> DataFrame:
    """(value): of the queries (query_id, query) with a word in ``existing`` (term), the share without a result."""
    words = queries.select(_BY, F.explode(F.array_distinct(analysis.tokens(F.col("query")))).alias("term"))
    asked = words.join(existing.select("term").distinct(), "term", "left_semi").select(_BY).distinct()
    answered = results.select(_BY).distinct().withColumn("hit", F.lit(1))
    return asked.join(answered, _BY, "left").agg(F.coalesce(F.avg(F.col("hit").isNull().cast("double")), F.lit(0.0)).alias("value"))


def percentiles(latencies: DataFrame, column: str, ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row with p50, p95, …: the nearest rank, not an interpolation.

    Values are counted and sorted over the cluster; what is summed up in order on the driver is a row a partition.
    """
    spark = latencies.sparkSession
    counted = latencies.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    part = F.spark_partition_id()
    ordered = counted.repartitionByRange("v").select("v", "n", part.alias("p"))
    sizes = sorted(map(tuple, ordered.groupBy("p").agg(F.min("v"), F.max("v"), F.sum("n")).collect()))
    total, out = sum(s[3] for s in sizes), {}
    for rank in ranks:
        want, before = max(1, -int(-total * rank // 1)), 0
        for _, low, high, n in sizes:
            if before + n >= want:
                own = counted.where(F.col("v").between(low, high)).withColumn("c", before + F.sum("n").over(Window.orderBy("v")))
                out[f"p{round(rank * 100)}"] = own.where(F.col("c") >= want).agg(F.min("v")).first()[0]
                break
            before += n
    kind = latencies.schema[column].dataType.simpleString()
    return spark.createDataFrame([tuple(out.get(f"p{round(r * 100)}") for r in ranks)], ", ".join(f"p{round(r * 100)} {kind}" for r in ranks))


def suggestion_metrics(suggestions: DataFrame, expected: DataFrame, max_distance: int = 2, k: int = 5) -> DataFrame:
    """One row over suggestions (query, place, word) and expected (query, expected):

    mean precision of the first k (words within the distance), the same weighted by closeness and script, share of
    queries whose first word is the expected one, with any word, with one within the distance, with the expected
    one, and the mean reciprocal place of the expected one.
    """
    near = F.levenshtein("query", "word", max_distance)
    ok = near >= 0
    same = F.arrays_overlap(analysis.scripts(F.col("query")), analysis.scripts(F.col("word")))
    closeness = F.when(ok, F.least(F.lit(1.0), (max_distance - near) / max_distance + F.when(same, 0.2).otherwise(0.0))).otherwise(0.0)
    is_it = F.lower("word") == F.lower("expected")
    joined = expected.join(suggestions, "query", "left")
    by_query = joined.groupBy("query").agg(
        F.coalesce(F.avg(F.when(F.col("place") <= k, ok.cast("double"))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg(F.when(F.col("place") <= k, closeness)), F.lit(0.0)).alias("script_precision"),
        F.coalesce(F.max(((F.col("place") == 1) & is_it).cast("double")), F.lit(0.0)).alias("top1"),
        F.max(F.col("word").isNotNull().cast("double")).alias("coverage_any"),
        F.coalesce(F.max(ok.cast("double")), F.lit(0.0)).alias("coverage_correct"),
        F.coalesce(F.max((F.col("word") == F.col("expected")).cast("double")), F.lit(0.0)).alias("coverage_expected"),
        F.coalesce(1 / F.min(F.when(is_it, F.col("place"))), F.lit(0.0)).alias("mrr"),
    )
    names = ["precision", "script_precision", "top1", "coverage_any", "coverage_correct", "coverage_expected", "mrr"]
    return by_query.agg(*[F.round(F.avg(n), 6).alias(n) for n in names])


def size_share(texts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(model, chars, share) of the text columns of some tables: a row a table."""
    every = None
    for name, (df, column) in texts.items():
        one = df.agg(F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("chars")).select(F.lit(name).alias("model"), "chars")
        every = one if every is None else every.unionByName(one)
    return every.withColumn("share", F.col("chars") / F.sum("chars").over(Window.partitionBy()))


def vocabulary_bands(index, frequent: float = 0.3, rare: float = 0.05) -> DataFrame:
    """(band, words): words in more than ``frequent`` of the documents, in at most ``rare`` of them, and between."""
    n = index.doc_count
    band = F.when(F.col("df") > frequent * n, "frequent").when(F.col("df") <= rare * n, "rare").otherwise("middle")
    return index.table("term_df").groupBy(band.alias("band")).agg(F.count("*").alias("words"))


def metric_text(search_text: Column | None, buckets: list[Column], named: list[Column], summary: Column | None) -> Column:
    """The text that relevance is judged by: the first that isn't empty of search text, buckets, named columns, summary."""
    joined = [F.concat_ws(" ", *c) for c in (buckets, named) if c]
    order = [c for c in (search_text, *joined, summary) if c is not None]
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in order], F.lit(""))


def tolerance(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(query, tolerant): whether a query and its variant (query, variant) find the same documents of found (query, doc_id)."""
    own = pairs.join(found, "query").select("query", "doc_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    other = pairs.join(found.withColumnRenamed("query", "variant"), "variant").select("query", "doc_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = own.unionByName(other).groupBy("query", "doc_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    same = both.groupBy("query").agg((F.min("a") + F.min("b") == 2).alias("same"))
    return pairs.select("query").distinct().join(same, "query", "left").select("query", F.coalesce("same", F.lit(False)).alias("tolerant"))


def capacity(rates: DataFrame) -> DataFrame:
    """Derived figures of (volume, queries_per_s, index_bytes, docs_per_s): requests a day at 30 % load, KB a document, seconds to rebuild."""
    return rates.select(
        "*",
        F.round(F.col("queries_per_s") * 86400 * 0.30).cast("long").alias("requests_per_day"),
        F.round(F.col("index_bytes") / 1024 / F.col("volume"), 3).alias("kb_per_doc"),
        F.round(F.col("volume") / F.col("docs_per_s"), 3).alias("rebuild_s"),
    )


def mean_and_sigma(runs: DataFrame, by: str, column: str) -> DataFrame:
    """(by, mean, sigma) over repetitions; the population's deviation."""
    return runs.groupBy(by).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sigma"))


def scaled(records: DataFrame, key: str, text: str, copies: int) -> DataFrame:
    """The records ``copies`` times, keys made distinct and texts numbered: a larger data set of the same shape."""
    n = records.sparkSession.range(copies).select(F.col("id").alias("copy"))
    suffix = F.when(F.col("copy") > 0, F.concat(F.lit(" "), F.col("copy").cast("string"))).otherwise("")
    return records.crossJoin(F.broadcast(n)).withColumn(text, F.concat(F.col(text), suffix)).withColumn(key, F.concat_ws("-", F.col(key).cast("string"), F.col("copy").cast("string"))).drop("copy")


def ranking_holds(results: DataFrame, must: DataFrame, must_not: DataFrame) -> DataFrame:
    """(query_id, ok): every pair of must (query_id, doc_id) is in the results, none of must_not is."""
    missing = must.join(results, [_BY, "doc_id"], "left_anti").select(_BY)
    wrong = results.join(must_not, [_BY, "doc_id"], "left_semi").select(_BY)
    bad = missing.unionByName(wrong).distinct().withColumn("bad", F.lit(True))
    return must.select(_BY).unionByName(must_not.select(_BY)).distinct().join(bad, _BY, "left").select(_BY, F.col("bad").isNull().alias("ok"))
