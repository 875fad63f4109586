"""Statistics, vocabulary, maintenance, increments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalogue import register
from quern.functions import analysis
from quern.operators import index as ix
from quern.operators import metrics, suggest
from quern.operators.index import Index
from quern.operators.store import IndexStore, integrity_figures
from quern.queries.base import D, P, WIDE, documents, messages, parts, store, toks
from quern.sources import io
from quern.sources.io import table
from quern.spec import Config, SearchableSpec
from quern.streaming.sync import merged

_DF = "SELECT term, CAST(count(*) AS BIGINT) AS df FROM (SELECT DISTINCT doc_id, unnest(tok) AS term FROM d) GROUP BY term"


@register("agg_document_frequency", f"WITH {D} {_DF}")
def document_frequency(spark, sf):
    return documents(spark, sf).table("term_df").select("term", "df")


@register("agg_index_stats", f"WITH {D} SELECT 'documents' AS model, CAST(count(*) AS BIGINT) AS doc_count, round(avg(len(tok)), 6) AS avg_len FROM d")
def index_stats(spark, sf):
    return documents(spark, sf).table("stats").select("model", "doc_count", F.round("avg_len", 6).alias("avg_len"))


@register("agg_models", "SELECT 'conversations' AS model, (SELECT CAST(count(*) AS BIGINT) FROM conversations) AS n UNION ALL SELECT 'documents', (SELECT CAST(count(*) AS BIGINT) FROM documents)")
def models(spark, sf):
    own = documents(spark, sf), messages(spark, sf)
    found = store(spark, Config()).status(own[0].tenant).where(F.col("model").isin([i.spec.model for i in own]))
    return found.select("model", F.col("documents").alias("n"))


@register("agg_size_share", """
WITH n AS (SELECT 'documents' AS model, sum(length(text)) AS c FROM documents UNION ALL SELECT 'conversations', sum(length(text)) FROM conversations)
SELECT model, CAST(c AS BIGINT) AS chars, round(c / sum(c) OVER (), 6) AS share FROM n""")
def size_share(spark, sf):
    return metrics.size_share({t: (table(spark, sf, t), "text") for t in ("documents", "conversations")}).select("model", "chars", F.round("share", 6).alias("share"))


@register("agg_vocabulary", f"WITH {D} SELECT term AS word, replace(term, 'ß', 'ss') AS ascii_word, df AS doc_count FROM ({_DF})")
def vocabulary(spark, sf):
    return documents(spark, sf).table("vocab").select("word", "ascii_word", "doc_count")


@register("agg_trigram_words", """
SELECT trigram, word, doc_count FROM (SELECT DISTINCT word, doc_count, substr('#' || word || '#', i, 3) AS trigram FROM (
  SELECT word, doc_count, unnest(range(1, CAST(length(word) + 1 AS BIGINT))) AS i FROM (
    SELECT word, CAST(count(DISTINCT k) AS BIGINT) AS doc_count FROM (SELECT p_partkey AS k, unnest(%s) AS word FROM part) GROUP BY word)))""" % f"list_concat({toks('p_name')}, list_concat({toks('p_type')}, {toks('p_brand')}))")
def trigram_words(spark, sf):
    return parts(spark, sf).table("vocab_tri").select("trigram", "word", "doc_count")


@register("agg_candidate_words", f"""
WITH {D}, df AS ({_DF}), t AS (SELECT DISTINCT term, df, substr('#' || replace(term, 'ß', 'ss') || '#', i, 3) AS g FROM (SELECT term, df, unnest(range(1, CAST(length(replace(term, 'ß', 'ss')) + 1 AS BIGINT))) AS i FROM df))
SELECT term AS word, CAST(count(*) AS BIGINT) AS shared, round(avg(df), 6) AS avg_docs FROM t WHERE g IN ('#mo', 'mor', 'oro', 'ron', 'on#') GROUP BY term HAVING count(*) >= 2""")
def candidate_words(spark, sf):
    found = suggest.shared_trigrams(documents(spark, sf).table("vocab_tri"), "moron")
    return found.select("word", "shared", F.round("avg_docs", 6).alias("avg_docs"))


@register("agg_vocabulary_bands", f"""
WITH {D}, df AS ({_DF}) SELECT CASE WHEN df > 0.3 * n THEN 'frequent' WHEN df <= 0.05 * n THEN 'rare' ELSE 'middle' END AS band, CAST(count(*) AS BIGINT) AS words
FROM df, (SELECT count(*) AS n FROM d) GROUP BY 1""")
def vocabulary_bands(spark, sf):
    return metrics.vocabulary_bands(documents(spark, sf))


@register("agg_postings", f"WITH {D} SELECT doc_id, term, CAST(count(*) AS INT) AS tf, CAST(max(dl) AS INT) AS dl FROM (SELECT doc_id, len(tok) AS dl, unnest(tok) AS term FROM d) GROUP BY doc_id, term")
def postings(spark, sf):
    return documents(spark, sf).table("postings").select("doc_id", "term", "tf", "dl")


@register("lim_prune", "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents ORDER BY documents.doc_id DESC LIMIT 150")
def prune(spark, sf):
    return ix.pruned(documents(spark, sf).rows, 150).select("doc_id")


_CHANGES = "SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id, ts, event_type FROM events"


@register("str_latest_change", f"SELECT doc_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS k FROM ({_CHANGES})) WHERE k = 1")
def latest_change(spark, sf):
    changes = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("doc_id"), "event_id", "ts", "event_type")
    return ix.latest_changes(changes, "doc_id", "ts", "event_id").select("doc_id", "event_id", "event_type")


@register("str_merge", rf"""
WITH last AS (SELECT doc_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS k FROM ({_CHANGES})) WHERE k = 1)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lower(strip_accents(source)) AS text FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT doc_id FROM last)
UNION ALL SELECT doc_id, lower(event_type) FROM last WHERE event_type <> 'error'""")
def merge(spark, sf):
    spec = SearchableSpec.of("m", "doc_id", {"source": 1})
    current = Index.over(table(spark, sf, "documents").select("doc_id", "source"), spec, WIDE).rows
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    changes = table(spark, sf, "events").select(op.alias("op"), F.col("user_id").alias("doc_id"), "ts", "event_id", F.col("event_type").alias("source"))
    return merged(current, changes, spec, WIDE, "default", "ts", "event_id").select("doc_id", F.col("text_w1").alias("text"))


@register("src_since", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01 00:00:00'")
def since(spark, sf):
    return io.since(table(spark, sf, "orders"), "o_orderdate", "1998-06-01 00:00:00").select("o_orderkey")


@register("src_by_key", "SELECT doc_id, source FROM documents WHERE doc_id IN (3, 5, 8, 100000000)")
def by_key(spark, sf):
    return io.by_key(table(spark, sf, "documents"), "doc_id", [3, 5, 8, 100000000]).select("doc_id", "source")


@register("src_first_then_rest", "SELECT CAST(1 AS INT) AS part, CAST(least(100, count(*)) AS BIGINT) AS n FROM documents UNION ALL SELECT 2, CAST(greatest(0, count(*) - 100) AS BIGINT) FROM documents")
def first_then_rest(spark, sf):
    first, rest = io.first_then_rest(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)
    return first.agg(F.count("*").alias("n")).select(F.lit(1).alias("part"), "n").unionByName(rest.agg(F.count("*").alias("n")).select(F.lit(2).alias("part"), "n"))


@register("set_word_difference", f"""
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(len(list_filter(list_distinct({toks('p_type')}), lambda t: NOT list_contains({toks('p_name')}, t))) AS BIGINT) AS added FROM part""")
def word_difference(spark, sf):
    added = analysis.word_difference(analysis.analyze(F.col("p_name")), analysis.analyze(F.col("p_type")))
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.size(added).cast("long").alias("added"))


@register("idx_integrity", "SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(count(DISTINCT doc_id) AS BIGINT) AS keys, CAST(sum(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM documents")
def integrity(spark, sf):
    return integrity_figures(documents(spark, sf).rows)


@register("join_orphans", "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf):
    return ix.orphans(documents(spark, sf).rows, table(spark, sf, "labels"), "doc_id").select("doc_id")


# --- an index that changes ---------------------------------------------------------------------------------------

_M = SearchableSpec.of("changing", "doc_id", {"source": 1})
_CHANGED: dict[tuple, IndexStore] = {}


def _tenant(sf: str, name: str) -> str:
    return f"{name}-{sf.strip('/').replace('/', '_')}"


def changed(spark, sf) -> Index:
    """documents by source; then an upsert of the last event of each user, with all its repeated keys; then a delete."""
    own, tenant = store(spark), _tenant(sf, "changed")
    if (spark.sparkContext.applicationId, sf) not in _CHANGED:
        own.rebuild(table(spark, sf, "documents").select("doc_id", "source"), _M, tenant)
        own.upsert(table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("source"), "event_id"), _M, tenant, order="event_id")
        own.delete(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), _M, tenant)
        _CHANGED[spark.sparkContext.applicationId, sf] = own
    return own.load(_M, tenant)


_STATE = """last AS (SELECT user_id AS doc_id, event_type AS source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1),
now AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lower(source) AS text FROM (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM last) UNION ALL FROM last)
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""
_STATE_TOKENS = r"""tok AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda t: length(t) >= 2))) AS term FROM now)"""


@register("idx_changes", f"WITH {_STATE} SELECT doc_id, text FROM now")
def changes(spark, sf):
    return changed(spark, sf).rows.select("doc_id", F.col("text_w1").alias("text"))


@register("idx_changed_search", f"WITH {_STATE} SELECT doc_id FROM now WHERE starts_with(text, 'src1')")
def changed_search(spark, sf):
    from quern.operators.search import search

    return search(changed(spark, sf)).query("src1").ids().select("doc_id")


@register("idx_changed_frequencies", f"WITH {_STATE}, {_STATE_TOKENS} SELECT term, CAST(count(*) AS BIGINT) AS df FROM tok GROUP BY term")
def changed_frequencies(spark, sf):
    return changed(spark, sf).table("term_df").select("term", "df")


@register("idx_changed_vocabulary", f"WITH {_STATE}, {_STATE_TOKENS} SELECT DISTINCT substr('#' || term || '#', i, 3) AS trigram, term AS word, df AS doc_count FROM (SELECT *, unnest(range(1, CAST(length(term) + 1 AS BIGINT))) AS i FROM (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tok GROUP BY term))")
def changed_vocabulary(spark, sf):
    return changed(spark, sf).table("vocab_tri").select("trigram", "word", "doc_count")


@register("idx_status", f"WITH {_STATE} SELECT 'changing' AS model, 3 AS version, CAST(count(*) AS BIGINT) AS documents, 3 AS segments FROM now")
def status(spark, sf):
    changed(spark, sf)
    return store(spark).status(_tenant(sf, "changed")).drop("last_synced_at")


@register("idx_optimize", f"WITH {_STATE} SELECT 1 AS segments, CAST(count(*) AS BIGINT) AS documents, CAST(count(DISTINCT doc_id) AS BIGINT) AS keys FROM now")
def optimize(spark, sf):
    own, tenant = store(spark), _tenant(sf, "optimized")
    own.write(changed(spark, sf).rows, _M, tenant)
    own.delete(spark.createDataFrame([("no such key",)], "k string"), _M, tenant)
    own.optimize(_M, tenant)
    segments = own.status(tenant).first()["segments"]
    return integrity_figures(own.load(_M, tenant).rows).select(F.lit(segments).alias("segments"), F.col("row_count").alias("documents"), "keys")


@register("idx_prune", "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents ORDER BY documents.doc_id DESC LIMIT 70")
def store_prune(spark, sf):
    own, tenant = store(spark), _tenant(sf, "pruned")
    own.rebuild(table(spark, sf, "documents").select("doc_id", "source"), _M, tenant)
    own.prune(_M, tenant, keep=70)
    return own.load(_M, tenant).rows.select("doc_id")


@register("idx_sync_since", "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, lower(o_orderpriority) AS text FROM orders")
def sync_since(spark, sf):
    own, tenant, spec = store(spark), _tenant(sf, "synced"), SearchableSpec.of("orders", "o_orderkey", {"o_orderpriority": 1})
    orders, at = table(spark, sf, "orders"), "1998-01-01 00:00:00"
    own.rebuild(orders.where(F.col("o_orderdate") < F.lit(at).cast("timestamp")), spec, tenant, at)
    own.sync_since(orders, spec, "o_orderdate", "1999-01-01 00:00:00", tenant=tenant)
    return own.load(spec, tenant).rows.select("doc_id", F.col("text_w1").alias("text"))


@register("idx_unchanged", "SELECT 1 AS first, 1 AS again, 2 AS after")
def unchanged(spark, sf):
    own, tenant, records = store(spark), _tenant(sf, "same"), table(spark, sf, "nation")
    spec = SearchableSpec.of("nation", "n_nationkey", {"n_name": 1})
    if own.exists(tenant, "nation"):
        own.drop(tenant, "nation")
    found = [own.rebuild(r, spec, tenant, unless_same=True) for r in (records, records, records.where("n_nationkey > 0"))]
    return spark.createDataFrame([tuple(found)], "first int, again int, after int")


@register("idx_schema", "SELECT * FROM (VALUES ('documents', 'ok'), ('part', 'drift'), ('absent', 'missing')) t(model, state)")
def schema(spark, sf):
    tenant = documents(spark, sf).tenant
    known = [documents(spark, sf).spec, SearchableSpec.of(parts(spark, sf).spec.model, "p_partkey", {"p_name": 1}), SearchableSpec.of("absent", "k", {"x": 1})]
    return spark.createDataFrame(list(store(spark, Config()).check_schema(known, tenant).items()), "model string, state string")


@register("idx_orphans", "SELECT 'changing' AS model")
def store_orphans(spark, sf):
    changed(spark, sf)
    return spark.createDataFrame([(m,) for m in store(spark).orphans([documents(spark, sf).spec], _tenant(sf, "changed"))], "model string")
