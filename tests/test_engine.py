"""The engine's behaviour on small controlled records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import analysis
from quern.operators.cache import ResultCache
from quern.operators.index import Index
from quern.operators.search import search
from quern.operators.store import IndexStore
from quern.spec import Config, Relation, SearchableSpec
from quern.streaming import sync

SPEC = SearchableSpec.of("posts", "id", {"title": 3, "body": 1})
TOPICS = [(1, "kettle", "copper kettle steam"), (2, "violin", "bow and rosin"), (3, "harbour", "steam ferry rosin"), (4, "orchard", None)]


def posts(spark, data):
    return spark.createDataFrame(data, "id long, title string, body string")


def ids(found):
    return sorted(int(r.doc_id) for r in found.ids().collect())


@pytest.fixture(scope="module")
def index(spark):
    return Index.over(posts(spark, TOPICS), SPEC)


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("steam", [1, 3]),
        ("steam AND rosin", [3]),
        ("violin OR kettle", [1, 2]),
        ("steam NOT ferry", [1]),
        ('"copper kettle"', [1]),
        ('"kettle copper"', []),
        ("harb*", [3]),
        ("nonsense", []),
        ("", []),
        ("AND OR NOT", []),
        ("!!! ((( '--", []),
        ("<b>steam</b>", [1, 3]),
        ("x" * 800, []),
        ("steam\nrosin", [3]),
    ],
)
def test_boolean_queries(index, query, expected):
    assert ids(search(index).query(query)) == expected


def test_title_hits_rank_above_body_hits(spark):
    data = [(1, "lantern", "oil"), (2, "oil", "lantern"), (3, "lantern", "lantern"), (4, "wick", "oil")]
    found = {int(r.doc_id): r["rank"] for r in search(Index.over(posts(spark, data), SPEC)).query("lantern").ranked().collect()}
    assert set(found) == {1, 2, 3}
    assert max(found, key=found.get) in (1, 3)
    assert all(0 <= x <= 100 for x in found.values())
    assert found[2] < found[1]


def test_pages_partition_the_matches_and_carry_the_total(spark):
    index = Index.over(posts(spark, [(i, f"t{i}", "shared") for i in range(1, 6)]), SPEC)
    seen = []
    for page, size in ((1, 2), (2, 2), (3, 1)):
        got = search(index).query("shared").paginate(2, page)
        rows = got["rows"].collect()
        assert (len(rows), got["total"], got["last_page"]) == (size, 5, 3)
        assert {r.total_count for r in rows} == {5}
        seen += [r.doc_id for r in rows]
    assert sorted(seen) == ["1", "2", "3", "4", "5"]


def test_scripts_and_accents(spark):
    data = [(1, "Crème brûlée", ""), (2, "搜索引擎", ""), (3, "Поиск данных", ""), (4, "<i>plain</i>", "")]
    index = Index.over(posts(spark, data), SPEC)
    for query, expected in (("creme", [1]), ("brûlée", [1]), ("搜索", [2]), ("поиск", [3]), ("plain", [4])):
        assert ids(search(index).query(query)) == expected, query


def test_voiced_kana_and_arabic_are_analysed_as_queries_are(spark):
    texts = ["\u30ac\u30a4\u30c9 \u304c\u304e", "\u0627\u0644\u0643\u062a\u0627\u0628 \u0648\u0627\u0644\u0645\u0643\u062a\u0628\u0627\u062a", "plain  words"]
    data = [(i, text, "") for i, text in enumerate(texts, 1)]
    frame = spark.createDataFrame(data, "id long, t string, u string")
    got = [r[0] for r in frame.orderBy("id").select(analysis.analyze(F.col("t"))).collect()]
    assert got == [analysis.analyze_py(t) for t in texts]
    index = Index.over(posts(spark, data), SPEC)
    assert ids(search(index).query("\u30ac\u30a4\u30c9")) == [1]
    assert ids(search(index).query("\u0627\u0644\u0643\u062a\u0627\u0628")) == [2]


def test_an_empty_table_has_no_hits(spark):
    index = Index.over(posts(spark, []), SPEC)
    assert search(index).query("steam").get().collect() == []


def test_conditions_facets_and_nulls(spark):
    data = spark.createDataFrame([(1, "red lamp", 1, 10.0), (2, "blue lamp", 1, 25.0), (3, "old lamp", 2, None)], "id long, title string, category int, price double")
    index = Index.over(data, SearchableSpec.of("lamps", "id", {"title": 3}))
    lamp = search(index).query("lamp")
    assert ids(lamp.where("category", 1)) == [1, 2]
    assert ids(lamp.where("price", ">", 10)) == [2]
    assert ids(lamp.where_null("price")) == [3]
    assert ids(lamp.where_between("price", 5, 20)) == [1]
    assert ids(lamp.where("category", [2, 9])) == [3]
    assert [(r["value"], r["count"]) for r in lamp.aggregate("category").collect()] == [("1", 2), ("2", 1)]
    with pytest.raises(ValueError, match="operator"):
        lamp.where("price", "~", 1)


def test_relations(spark):
    books = spark.createDataFrame([(1, "Salt", 7), (2, "Ash", None)], "id long, title string, author_id long")
    authors = spark.createDataFrame([(7, "Ines Vidal")], "id long, name string")
    notes = spark.createDataFrame([(1, 1, "bitter"), (2, 1, ""), (3, 1, "bright")], "id long, book_id long, body string")
    spec = SearchableSpec.of("books", "id", {"title": 3, "author.name": 1, "notes.body": 1}, relations=(Relation("author", authors, "author_id", "id"), Relation("notes", notes, "id", "book_id", many=True, order_by="id")))
    index = Index.over(books, spec)
    assert ids(search(index).query("vidal")) == [1]
    assert ids(search(index).query("bright")) == [1]
    assert ids(search(index).query("ash")) == [2]


def test_tenants_do_not_see_each_other(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/ix")
    store.rebuild(posts(spark, [(1, "north", "")]), SPEC, "a")
    store.rebuild(posts(spark, [(1, "south", "")]), SPEC, "b")
    assert ids(search(store.load(SPEC, "a")).query("south")) == []
    assert ids(search(store.load(SPEC, "b")).query("south")) == [1]
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError, match="."):
            store.folder(bad, "posts")


def test_store_lifecycle(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/ix")
    assert store.check_schema([SPEC]) == {"posts": "missing"}
    store.rebuild(posts(spark, TOPICS), SPEC)
    assert store.integrity(SPEC) == []
    store.upsert(posts(spark, [(2, "cello", "rosin"), (5, "quarry", "")]), SPEC)
    now = store.load(SPEC)
    assert (ids(search(now).query("violin")), ids(search(now).query("cello")), now.doc_count) == ([], [2], 5)
    store.delete(spark.createDataFrame([(1,)], "id long"), SPEC)
    assert ids(search(store.load(SPEC)).query("kettle")) == []
    store.prune(SPEC, keep=2)
    assert sorted(r.doc_id for r in store.load(SPEC).rows.collect()) == ["4", "5"]
    store.prune(SPEC, keep=0)
    assert store.load(SPEC).doc_count == 2
    assert store.check_schema([SearchableSpec.of("posts", "id", {"title": 2})]) == {"posts": "drift"}
    assert store.drop_orphans([]) == ["posts"]


def test_changes_cost_what_they_change_and_writers_exclude_each_other(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/ix", max_segments=3)
    data = [(i, f"word{i % 50} common", "x" * 20 + f" body{i} " + "filler text " * 20) for i in range(2000)]
    store.rebuild(posts(spark, data), SPEC)
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    whole = size(tmp_path / "ix")
    fresh = [(5, "renewed kettle", "z"), (5, "renewed violin", "z"), (9999, "added", "z")]
    store.upsert(posts(spark, fresh), SPEC, order="title")  # a key given twice is indexed once, by its last row
    assert size(tmp_path / "ix") - whole < 0.2 * whole
    now = store.load(SPEC)
    assert ids(search(now).query("renewed")) == [5] and ids(search(now).query("violin")) == [5] and ids(search(now).query("body5")) == list(range(50, 60)) + list(range(500, 600))
    assert store.integrity(SPEC) == [] and now.doc_count == 2001
    folder = tmp_path / "ix/tenant=default/model=posts"
    (folder / "LOCK").write_text("0")
    with pytest.raises(RuntimeError, match="being written"):
        store.delete(spark.createDataFrame([(5,)], "id long"), SPEC)
    store.unlock("default", "posts")
    (folder / "_new-abc").write_text("half")  # a writer that stopped midway
    for k in (5, 6):
        store.delete(spark.createDataFrame([(k,)], "id long"), SPEC)
    assert len(store.meta("default", "posts")["segments"]) == 1  # written whole again
    assert store.load(SPEC).doc_count == 1999 and store.integrity(SPEC) == []
    assert not (folder / "_new-abc").exists() and len(store.versions("default", "posts")) == 2


def test_search_by_postings_equals_search_by_rows(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/ix")
    data = [*TOPICS, (5, "steam steam", "copper and steam"), (6, "Étude", "kettle"), (7, "", "")]
    store.rebuild(posts(spark, data), SPEC)
    rows, written = Index.over(posts(spark, data), SPEC), store.load(SPEC)
    assert written.written and not rows.written
    for query in ("steam", "ste", "steam AND rosin", "violin OR kettle", "steam NOT ferry", '"copper kettle"', '"steam"', "title:steam", "title:kettle OR ferry", "steam NEAR copper", 'kettle NOT "copper kettle"', "etude"):
        a, b = (sorted(map(tuple, search(i).query(query).ranked().collect())) for i in (rows, written))
        assert a == b, query
    plan = search(written).query("steam").explain()
    assert "StringStartsWith(term,steam)" in plan


def test_edges_of_searches(spark, index):
    steam = search(index).query("steam")
    lamps = Index.over(spark.createDataFrame([(1, "lamp", 3)], "id long, title string, price int"), SearchableSpec.of("lamps", "id", {"title": 3}))
    assert ids(search(lamps).query("lamp").where("price", ">", None)) == []
    assert search(lamps).query("").aggregate("price").collect() == [] and search(lamps).query("lamp").models("none").aggregate("price").collect() == []
    both = Index.over(posts(spark, TOPICS), SearchableSpec.of("posts", "id", {"title": 1, "body": 1}))
    with pytest.raises(ValueError, match="shares its weight"):
        search(both).query("title:steam").ids()
    assert len(steam.rows_within(60)) == 2
    with pytest.raises(ValueError, match="no scorer"):
        steam.scorer("none such")


def test_results_are_cached_by_version(spark, tmp_path):
    store, cache = IndexStore(spark, f"file://{tmp_path}/ix"), ResultCache()
    store.rebuild(posts(spark, TOPICS), SPEC)
    page = lambda: sorted(r.doc_id for r in cache.page(search(store.load(SPEC)).query("steam")).collect())
    assert (page(), page(), cache.hits) == (["1", "3"], ["1", "3"], 1)
    store.delete(spark.createDataFrame([(1,)], "id long"), SPEC)
    assert page() == ["3"] and cache.hits == 1


def test_stream_of_changes(spark, tmp_path):
    spec = SearchableSpec.of("notes", "doc_id", {"body": 1})
    store = IndexStore(spark, f"file://{tmp_path}/ix")
    schema = "op string, doc_id string, ts timestamp, body string"
    store.rebuild(spark.createDataFrame([("1", "alder"), ("2", "birch")], "doc_id string, body string"), spec)
    feed = f"{tmp_path}/feed"
    t = lambda s: F.to_timestamp(F.lit(f"2024-01-01 00:00:0{s}"))
    change = lambda op, key, at, body: spark.range(1).select(F.lit(op).alias("op"), F.lit(key).alias("doc_id"), t(at).alias("ts"), F.lit(body).alias("body"))
    changes = change("upsert", "2", 1, "cedar").unionByName(change("upsert", "2", 2, "elm")).unionByName(change("delete", "1", 1, None)).unionByName(change("upsert", "3", 1, "fir"))
    changes.coalesce(1).write.parquet(feed)
    sync.start(spark.readStream.schema(schema).parquet(feed), store, spec, f"{tmp_path}/cp").awaitTermination(120)
    now = store.load(spec)
    assert {q: ids(search(now).query(q)) for q in ("alder", "birch", "cedar", "elm", "fir")} == {"alder": [], "birch": [], "cedar": [], "elm": [2], "fir": [3]}


def test_authorisation(spark, index):
    acl = spark.createDataFrame([(3,)], "id long")
    assert ids(search(index).query("steam").with_authorization(acl)) == [3]
    assert ids(search(index).query("steam").with_authorization(acl.limit(0))) == []


def test_settings(spark):
    index = Index.over(posts(spark, TOPICS), SPEC, Config(operators=("AND",)))
    assert search(index).limit(0).rows == 1
    assert search(index).limit(10_000).rows == index.config.max_results
