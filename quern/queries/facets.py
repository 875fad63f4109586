"""Conditions on records, facets, boosts, authorisation, relations and projections."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quern.catalogue import register
from quern.functions.analysis import Analyzer
from quern.operators import index as ix
from quern.operators.index import Index
from quern.operators.search import register_scorer, search
from quern.queries.base import D, DOCUMENTS, P, WIDE, begins, built, documents, find, parts, ranked_sql, scaled, stats_sql, store, toks
from quern.sources.io import table
from quern.spec import Relation, SearchableSpec

_FROM = begins("from")


def _where(name: str, condition: str, build):
    @register(name, f"WITH {D} SELECT doc_id FROM d WHERE {_FROM} AND ({condition})")
    def run(spark, sf):
        return build(find(documents(spark, sf), "from")).ids().select("doc_id")


_where("whr_equals", "lang = 'de'", lambda s: s.where("lang", "de"))
_where("whr_not_equals", "lang <> 'de'", lambda s: s.where("lang", "!=", "de"))
_where("whr_greater", "n_chars > 3000", lambda s: s.where("n_chars", ">", 3000))
_where("whr_at_least", "n_chars >= 3000", lambda s: s.where("n_chars", ">=", 3000))
_where("whr_less", "n_chars < 500", lambda s: s.where("n_chars", "<", 500))
_where("whr_at_most", "n_chars <= 500", lambda s: s.where("n_chars", "<=", 500))
_where("whr_in", "source IN ('src1', 'src2')", lambda s: s.where("source", ["src1", "src2"]))
_where("whr_not_in", "source NOT IN ('src1', 'src2') OR source IS NULL", lambda s: s.where_not_in("source", ["src1", "src2"]))
_where("whr_between", "n_chars BETWEEN 500 AND 1500", lambda s: s.where_between("n_chars", 500, 1500))
_where("whr_conjunction", "lang = 'en' AND n_chars > 1000 AND source <> 'src0'", lambda s: s.where("lang", "en").where("n_chars", ">", 1000).where("source", "!=", "src0"))

_LABELLED = f"WITH {D}, l AS (SELECT d.doc_id, tok, quality, toxic FROM d LEFT JOIN labels ON d.doc_id = CAST(labels.doc_id AS VARCHAR))"


def labelled(spark, sf) -> Index:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    index = documents(spark, sf)
    return index.with_source(docs.join(labels, "doc_id", "left"))


@register("whr_null", f"{_LABELLED} SELECT doc_id FROM l WHERE {_FROM} AND quality IS NULL")
def where_null(spark, sf):
    return find(labelled(spark, sf), "from").where_null("quality").ids().select("doc_id")


@register("whr_not_null", f"{_LABELLED} SELECT doc_id FROM l WHERE {_FROM} AND quality IS NOT NULL")
def where_not_null(spark, sf):
    return find(labelled(spark, sf), "from").where_not_null("quality").ids().select("doc_id")


@register("agg_facet", f"{_LABELLED} SELECT coalesce(CAST(quality AS VARCHAR), 'unknown') AS value, CAST(count(*) AS BIGINT) AS count FROM l WHERE {_FROM} GROUP BY 1")
def facet(spark, sf):
    return find(labelled(spark, sf), "from").aggregate("quality")


@register("agg_facet_filtered", f"WITH {D} SELECT source AS value, CAST(count(*) AS BIGINT) AS count FROM d WHERE {_FROM} AND lang = 'en' GROUP BY 1")
def facet_filtered(spark, sf):
    return find(documents(spark, sf), "from").where("lang", "en").aggregate("source")


@register("auth_acl", f"WITH {D} SELECT doc_id FROM d WHERE {_FROM} AND doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 0)")
def authorised(spark, sf):
    acl = table(spark, sf, "labels").where("toxic = 0").select("doc_id")
    return find(documents(spark, sf), "from").with_authorization(acl=acl).ids().select("doc_id")


@register("auth_predicate", f"{_LABELLED} SELECT doc_id FROM l WHERE {_FROM} AND quality = 1")
def authorised_by_predicate(spark, sf):
    return find(labelled(spark, sf), "from").with_authorization(allowed=F.col("quality") == 1).ids().select("doc_id")


ORDERS = SearchableSpec.of("orders", "o_orderkey", {"o_orderpriority": 2, "o_orderstatus": 1})
_NOW = "2002-01-01 00:00:00"
_O = f"d AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderdate, {toks('o_orderpriority')} AS tok FROM orders)"


@register("sco_boost_recency", f"""
WITH {_O}, all_toks AS (SELECT list_concat({toks('o_orderpriority')}, {toks('o_orderstatus')}) AS tok FROM orders), {stats_sql(['urgent'], 'all_toks', ['tok'])},
raw AS (SELECT doc_id, o_orderdate, len(tok) AS dl, {begins('urgent')} AS hit FROM d),
r AS (SELECT doc_id, o_orderdate, {scaled("2 * (ln(1 + (s.n - s.df_urgent + 0.5) / (s.df_urgent + 0.5)) * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * dl / s.avgdl))) / (2 + (CASE WHEN os THEN 1 ELSE 0 END))")} AS rank
  FROM (SELECT raw.*, true AS os FROM raw) raw, s WHERE hit),
b AS (SELECT doc_id, least(rank * (1 + 0.5 * 3 * greatest(0.0, 30 - greatest(0.0, date_diff('microsecond', o_orderdate, TIMESTAMP '{_NOW}') / 86400000000.0)) / 30), 100.0) AS rank FROM r)
SELECT doc_id, round(rank, 6) AS rank FROM b""")
def boost(spark, sf):
    index = Index.over(table(spark, sf, "orders"), ORDERS, WIDE)
    return find(index, "urgent").boost("o_orderdate", 0.5, _NOW).ranked().select("doc_id", F.round("rank", 6).alias("rank"))


# --- relations and projections -----------------------------------------------------------------------------------


def customer_spec(spark, sf) -> SearchableSpec:
    nations = Relation("nation", table(spark, sf, "nation"), "c_nationkey", "n_nationkey")
    orders = Relation("orders", table(spark, sf, "orders"), "c_custkey", "o_custkey", many=True, order_by="o_orderkey", limit=5)
    return SearchableSpec.of("customer", "c_custkey", {"c_name": 3, "c_mktsegment": 1, "nation.n_name": 2, "orders.o_orderpriority": 1}, relations=(nations, orders))


@register("prj_relations", """
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS name, c_mktsegment AS segment, coalesce(n_name, '') AS nation, coalesce(o.p, '') AS priorities
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (
  SELECT o_custkey, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 5 GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def relations(spark, sf):
    doc = ix.document(table(spark, sf, "customer"), customer_spec(spark, sf))
    return doc.select("doc_id", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("`nation.n_name`").alias("nation"), F.col("`orders.o_orderpriority`").alias("priorities"))


@register("prj_json_path", "SELECT CAST(event_id AS VARCHAR) AS doc_id, coalesce(json_extract_string(props, '$.k'), '') AS k, event_type AS event_type FROM events")
def json_path(spark, sf):
    spec = SearchableSpec.of("events", "event_id", {"props->k": 1, "event_type": 1})
    return ix.document(table(spark, sf, "events"), spec).select("doc_id", F.col("`props->k`").alias("k"), "event_type")


@register("prj_buckets", "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, lower(p_type) || ' ' || replace(lower(p_brand), '  ', ' ') AS text_w1, '' AS text_w2, lower(p_name) AS text_w3 FROM part")
def weight_buckets(spark, sf):
    return parts(spark, sf).rows.select("doc_id", "text_w1", "text_w2", "text_w3")


@register("prj_title", "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_name AS title FROM part")
def title(spark, sf):
    return parts(spark, sf).rows.select("doc_id", "title")


@register("prj_computed", "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, lower(c_name || ' of ' || c_mktsegment) AS text FROM customer")
def computed(spark, sf):
    from quern.spec import ColumnSpec

    spec = SearchableSpec("customer", "c_custkey", (ColumnSpec("fullname", 2, expression=F.concat_ws(" of ", "c_name", "c_mktsegment")),))
    return ix.rows(table(spark, sf, "customer"), spec).select("doc_id", F.col("text_w2").alias("text"))


@register("flt_should_sync", f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id FROM orders WHERE o_orderstatus <> 'F' AND {begins('urgent', toks('o_orderpriority'))}")
def should_sync(spark, sf):
    spec = SearchableSpec.of("orders", "o_orderkey", {"o_orderpriority": 1}, should_sync=F.col("o_orderstatus") != "F")
    return find(Index.over(table(spark, sf, "orders"), spec, WIDE), "urgent").ids().select("doc_id")


@register("join_hydrate", f"WITH {D} SELECT d.doc_id, d.source, d.n_chars FROM d WHERE {_FROM} AND {begins('worthless')}")
def hydrate(spark, sf):
    return find(documents(spark, sf), "from worthless").records(["source", "n_chars"])


@register("ten_isolation", f"WITH {D} SELECT doc_id FROM d WHERE {_FROM} AND source = 'src3'")
def tenant_isolation(spark, sf):
    # two tenants with a model of one name: what a search of one finds is its own
    records = table(spark, sf, "documents")
    for owner in ("src3", "src4"):
        built(spark, sf, records.where(F.col("source") == owner), DOCUMENTS, WIDE, f"{sf.strip('/').replace('/', '_')}-{owner}")
    mine = built(spark, sf, records, DOCUMENTS, WIDE, f"{sf.strip('/').replace('/', '_')}-src3")
    return search(mine).query("from").ids().select("doc_id")


@register("prj_result_json", f"""WITH {D}, {stats_sql(['worthless'], 'd', ['tok'])}, r AS ({ranked_sql(['worthless'], begins('worthless'))}),
t AS (SELECT doc_id, rank, (SELECT CAST(count(*) AS BIGINT) FROM r) AS total FROM r ORDER BY rank DESC, doc_id LIMIT 20)
SELECT 'documents:' || doc_id AS id, rank, total FROM t""")
def result_json(spark, sf):
    from quern.operators.search import RESULT, results_json

    lines = results_json(find(documents(spark, sf), "worthless").limit(20).get())
    back = lines.select(F.from_json("json", RESULT).alias("r"))
    return back.select("r.id", "r.rank", F.col("r.total_count").alias("total"))


@register("prj_positional", "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, lower(p_name) AS first, lower(p_type) AS second, lower(p_brand) || ' ' || CAST(p_size AS VARCHAR) AS rest FROM part")
def positional_weights(spark, sf):
    spec = SearchableSpec.of("part", "p_partkey", ["p_name", "p_type", "p_brand", "p_size"]).positional()
    return ix.rows(table(spark, sf, "part"), spec).select("doc_id", F.col("text_w3").alias("first"), F.col("text_w2").alias("second"), F.col("text_w1").alias("rest"))


_OWN = Analyzer("shouting", lambda c: F.translate(F.upper(c), "AEIOU", ""), lambda t: t.upper().translate(str.maketrans("", "", "AEIOU")))


@register("flt_custom_analyzer", r"SELECT CAST(p_partkey AS VARCHAR) AS doc_id FROM part WHERE len(list_filter(regexp_split_to_array(lower(translate(upper(p_name), 'AEIOU', '')), '[^a-z0-9]+'), lambda t: starts_with(t, 'wdgt'))) > 0")
def custom_analyzer(spark, sf):
    index = Index.over(table(spark, sf, "part"), SearchableSpec.of("part", "p_partkey", {"p_name": 1}), replace(WIDE, analyzer=_OWN))
    return find(index, "widget").ids().select("doc_id")


_ARABIC = {"en": "الكتاب على الطاولة", "de": "وكتابهم جديد", "fr": "مدرسة المدينة"}


@register("flt_arabic", "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE lang = 'en'")
def arabic(spark, sf):
    # the word with its article is found by the bare word and the other way round, also in rows that were added later
    words = F.create_map(*[F.lit(x) for pair in _ARABIC.items() for x in pair])
    records = table(spark, sf, "documents").select("doc_id", "lang", F.coalesce(words[F.col("lang")], F.lit("plain")).alias("body"))
    own, spec, tenant = store(spark), SearchableSpec.of("arabic", "doc_id", {"body": 1}), f"arabic-{sf.strip('/').replace('/', '_')}"
    own.rebuild(records.where("lang <> 'en'"), spec, tenant)
    own.upsert(records.where("lang = 'en'"), spec, tenant)
    return search(own.load(spec, tenant)).query("كتاب").ids().select("doc_id")


@register("flt_duplicate_guard", f"WITH {D} SELECT 'documents' AS model, doc_id FROM d WHERE {_FROM}")
def duplicate_guard(spark, sf):
    return search(documents(spark, sf), documents(spark, sf)).query("from").ids()


@register("sco_custom", f"WITH {P} SELECT doc_id, CAST(len(tok3) + len(tok1) AS DOUBLE) AS rank FROM p WHERE {begins('small', 'tok3')} OR {begins('small', 'tok1')}")
def custom_scorer(spark, sf):
    register_scorer("length", lambda query, index: F.size(ix.words_of(index.config)))
    return find(parts(spark, sf), "small").scorer("length").ranked().select("doc_id", "rank")
