"""What a query costs follows its input: dealt out rows, bounded batches, blocks of postings, tables read once."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import analysis, texts
from quern.operators import batch, blocks
from quern.operators.store import IndexStore, spread
from quern.session import bound_batches
from quern.spec import SearchableSpec

SPEC = SearchableSpec.of("notes", "id", {"body": 1})
ODD = ["", None, "  a\tb\n<b>CD</b> e1 ", "é" * 40 + " Ångström ĳs ﬁn", "µ Ελλάς ΟΔΟΣ", "开发入门ab カナ", "الكتاب وكتابهم x", "naïve\xa0ß Œuvre", "x" * 33 + " y" * 3, "\x1c_-_ 0², ٣ ไทย", "<" * 3, "i̇İ"]


def notes(spark, n=400):
    words = [f"w{i % 37}" for i in range(9)] + ["common", "rare"]
    return [(i, " ".join(words[(i + k * k) % 11] for k in range(i % 13))) for i in range(n)]


def test_batches_of_texts_are_analysed_as_queries_are():
    for some in (ODD, ODD * 3, [t for t in ODD if t and t.isascii()]):
        found = texts.texts_and_tokens(pa.array(some, pa.string()))
        assert found.field("text").to_pylist() == [analysis.analyze_py(t or "") for t in some]
        assert found.field("tok").to_pylist() == [analysis.tokens_py(analysis.analyze_py(t or "")) for t in some]
    assert texts.tokens(pa.array(["a bc", None])).to_pylist() == [["bc"], None]
    assert texts.scripts(pa.array(["ab я", "12", None, "漢かカ"])).to_pylist() == [["Latin", "Cyrillic"], ["Common"], ["Common"], ["Han", "Hiragana", "Katakana"]]


def test_postings_are_shuffled_as_blocks_and_are_those_of_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_POSTINGS", 100)  # several ranges of terms
    monkeypatch.setattr(blocks, "SLICE_TOKENS", 500)  # several slices a task
    store, data = IndexStore(spark, f"file://{tmp_path}/ix"), notes(spark)
    store.rebuild(spark.createDataFrame([*data, (None, "lost common"), (None, "lost words")], "id long, body string"), SPEC)
    index = store.load(SPEC)
    own = index.rows.where("doc_id IS NOT NULL")
    bounds = blocks.ranges(own, F.col("tok_w1"), 2400)
    assert bounds == sorted(set(bounds)) and bounds
    want = Counter((t, str(i)) for i, body in data for t in body.split())
    found = {(r.term, r.doc_id): (r.tf, r.dl) for r in index.table("postings").where("doc_id IS NOT NULL").collect()}
    assert found == {(t, i): (n, len(data[int(i)][1].split())) for (t, i), n in want.items()}
    df = {r.term: r.df for r in index.table("term_df").collect()}
    assert df["lost"] == 1 and df["common"] == 1 + sum("common" in body.split() for _, body in data)
    files = [{r.term for r in spark.read.parquet(str(f)).select("term").distinct().collect()} for f in tmp_path.rglob("postings/*.parquet")]
    assert sum(map(len, files)) <= len(set().union(*files)) + 3  # but for those without a key a term is in one file
    rows = own.select("doc_id", "tok_w1", "tok_w2", "tok_w3").coalesce(1).mapInArrow(blocks._task(range(1, 4), bounds), blocks.SCHEMA).count()
    assert rows < len(want) / 2


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    spark.createDataFrame(notes(spark, 20000), "id long, body string").coalesce(1).write.option("compression", "none").parquet(f"{tmp_path}/one")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        one = spark.read.parquet(f"{tmp_path}/one")
        assert one.rdd.getNumPartitions() >= 4
        sizes = [r["count"] for r in spread(one, "id").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20000 and max(sizes) < 10000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_batches_are_bounded(spark):
    bound_batches(spark)

    @F.pandas_udf("long")
    def rows(s):
        return s * 0 + len(s)

    assert spark.range(5000).coalesce(1).select(rows("id").alias("n")).agg(F.max("n")).first()[0] <= 2000


def test_many_queries_are_scored_without_listing_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batch, "SLICE_DOCS", 70)
    monkeypatch.setattr(batch, "SLICE_PAIRS", 150)
    monkeypatch.setattr(batch, "HELD", 5)
    spec = SearchableSpec.of("notes", "id", {"head": 3, "body": 1, "tail": 1})
    data = [(i, f"w{i % 5} common" if i % 3 else "", body, f"w{i % 7}") for i, body in notes(spark)]
    store = IndexStore(spark, f"file://{tmp_path}/ix")
    store.rebuild(spark.createDataFrame(data, "id long, head string, body string, tail string"), spec)
    index = store.load(spec)
    asked = spark.createDataFrame([(1, "w1 common"), (2, "w3"), (2, "w3 rare"), (3, "w2 nowhere"), (4, ""), (None, "rare w4 w5 w5")], "q int, t string")
    for mode in ("or", "and"):
        found = batch.batch_topk(index, asked, "q", "t", 7, mode)
        got = sorted(map(tuple, found.collect()), key=str)
        weighed = batch.query_terms(asked, "q", "t").join(index.table("term_df").select("term", "df"), "term")
        every = batch._by_postings(index, weighed, mode)
        first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"), "doc_id"))
        want = every.withColumn("place", first).where("place <= 7").select("query_id", "place", "doc_id", "rank")
        assert got == sorted(map(tuple, want.collect()), key=str) and got
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "countDistinct" not in plan and "count(distinct" not in plan


def test_texts_are_dealt_out_to_all_cores(spark, tmp_path):
    from quern.queries import textual

    data = [(i, f"relational ponies {i}") for i in range(3000)]
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for query in (textual.stemming, textual.scripts, textual.tokens, textual.nfc, textual.arabic_stem):
        found = query(spark, str(tmp_path))
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 1500, query
    assert {r["text"] for r in textual.stemming(spark, str(tmp_path)).where("doc_id = 7").collect()} == {"relat poni 7"}
