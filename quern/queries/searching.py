"""Matching, ranking, paging, snippets and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalogue import register
from quern.operators import batch, snippet, suggest
from quern.operators.cache import ResultCache
from quern.operators.search import search, starts_like
from quern.plans import compile as plan
from quern.plans.parser import capabilities, parse
from quern.queries.base import D, P, begins, documents, field_score, find, hits, messages, norm, parts, quick_sql, ranked_sql, scaled, stats_sql, tf, toks
from quern.sources.io import table
from quern.spec import Config

_IDS = f"WITH {D} SELECT doc_id FROM d WHERE "


def _flag(name: str, query: str, condition: str):
    @register(name, _IDS + condition)
    def run(spark, sf):
        return hits(documents(spark, sf), query)


_flag("flt_term", "worthless", begins("worthless"))
_flag("flt_prefix", "patheti*", begins("patheti"))
_flag("flt_and", "from AND Idiot", f"{begins('from')} AND {begins('idiot')}")
_flag("flt_implicit_and", "from idiot this", f"{begins('from')} AND {begins('idiot')} AND {begins('this')}")
_flag("flt_or", "idiot OR clown OR moron", f"{begins('idiot')} OR {begins('clown')} OR {begins('moron')}")
_flag("flt_or_is_flat", "from AND dans OR clown", f"{begins('from')} OR {begins('dans')} OR {begins('clown')}")
_flag("flt_not", "from NOT this", f"{begins('from')} AND NOT {begins('this')}")
_flag("flt_not_only", "NOT this", "false")
_flag("flt_dangling", "AND idiot OR", begins("idiot"))
_flag("flt_accents", "Étré", begins("etre"))
_flag("flt_phrase", '"All rights reserved"', "contains(' ' || array_to_string(tok, ' ') || ' ', ' all rights reserved ')")
_flag("flt_phrase_and_not", '"Apache License" from NOT clown', f"contains(' ' || array_to_string(tok, ' ') || ' ', ' apache license ') AND {begins('from')} AND NOT {begins('clown')}")


@register("flt_near", rf"""
WITH {D}, pos AS (SELECT doc_id, unnest(tok) AS t, unnest(range(1, CAST(len(tok) + 1 AS BIGINT))) AS i FROM d)
SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 5 AND contains(a.t, 'from') AND contains(b.t, 'with')
WHERE a.doc_id IN (SELECT doc_id FROM d WHERE {begins('from')} AND {begins('with')})""")
def near(spark, sf):
    return hits(documents(spark, sf), "from NEAR with")


@register("flt_column", f"WITH {P} SELECT doc_id FROM p WHERE {begins('small', 'tok3')} AND ({begins('economy', 'tok1')} OR {begins('economy', 'tok3')})")
def column_filter(spark, sf):
    return hits(parts(spark, sf), "p_name:small economy")


@register("flt_basic_mode", f"WITH {P} SELECT doc_id FROM p WHERE " + " AND ".join(f"({begins(w, 'tok1')} OR {begins(w, 'tok3')})" for w in ("sma", "eco")))
def basic_mode(spark, sf):
    return search(parts(spark, sf)).query("sma eco").mode("basic").ids().select("doc_id")


@register("flt_raw_mode", _IDS + begins("idiot"))
def raw_mode(spark, sf):
    return search(documents(spark, sf)).query("IDIOT").mode("raw").ids().select("doc_id")


@register("flt_operator_disabled", _IDS + f"{begins('idiot')} AND {begins('or')} AND {begins('clown')}")
def operator_disabled(spark, sf):
    return hits(documents(spark, sf, Config(operators=("AND", "NOT"), max_results=10**6)), "idiot OR clown")


@register("flt_default_or", _IDS + f"{begins('idiot')} OR {begins('clown')}")
def default_or(spark, sf):
    return hits(documents(spark, sf, Config(default_operator="or", max_results=10**6)), "idiot clown")


@register("flt_like_fallback", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0.5 AS rank FROM documents WHERE starts_with({norm('text')}, 'the')")
def like_fallback(spark, sf):
    return starts_like(documents(spark, sf), "the").select("doc_id", F.col("rank"))


@register("flt_auto_fallback", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE contains({norm('text')}, 'w')")
def auto_fallback(spark, sf):
    # one letter is no token, so the search proper finds nothing
    return find(documents(spark, sf), "ẁ").fallback().ids().select("doc_id")


@register("qry_capabilities", "SELECT * FROM (VALUES ('AND', true), ('OR', false), ('NOT', true), ('NEAR', false), ('PHRASE', true), ('PREFIX', true), ('COLUMN', true)) t(operator, available)")
def query_capabilities(spark, sf):
    return spark.createDataFrame(list(capabilities(Config(operators=("AND", "NOT"))).items()), "operator string, available boolean")


# --- ranking -----------------------------------------------------------------------------------------------------

_W = ["idiot", "clown", "worthless"]
_ANY = " OR ".join(begins(w) for w in _W)
_RANKED = f"WITH {D}, {stats_sql(_W, 'd', ['tok'])}, r AS ({ranked_sql(_W, _ANY)})"
_QUERY = "idiot OR clown OR worthless"


@register("bm25_topk", f"{_RANKED} SELECT doc_id, rank FROM r ORDER BY rank DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf):
    return find(documents(spark, sf), _QUERY).limit(10).page().select("doc_id", "rank")


@register("bm25_all", f"{_RANKED} SELECT doc_id, rank FROM r")
def bm25_all(spark, sf):
    return find(documents(spark, sf), _QUERY).ranked().select("doc_id", "rank")


_PW = ["small", "economy"]
_PS = field_score(_PW, "tok3"), field_score(_PW, "tok1")
_PRAW = f"(3 * ({_PS[0]}) * (CASE WHEN len(tok3) > 0 THEN 1 ELSE 0 END) + ({_PS[1]}) * (CASE WHEN len(tok1) > 0 THEN 1 ELSE 0 END)) / ((CASE WHEN len(tok3) > 0 THEN 3 ELSE 0 END) + (CASE WHEN len(tok1) > 0 THEN 1 ELSE 0 END))"


@register("bm25_weighted_topk", f"""
WITH {P}, {stats_sql(_PW, 'p', ['tok3', 'tok1'])}
SELECT doc_id, {scaled(_PRAW)} AS rank FROM p, s
WHERE ({begins('small', 'tok3')} OR {begins('small', 'tok1')}) AND ({begins('economy', 'tok3')} OR {begins('economy', 'tok1')}) ORDER BY rank DESC, doc_id LIMIT 20""")
def bm25_weighted_topk(spark, sf):
    return find(parts(spark, sf), "small economy").limit(20).page().select("doc_id", "rank")


@register("sco_quick", f"WITH {D} SELECT doc_id, {quick_sql(['wor', 'from'], 'tok')} AS score FROM d")
def quick_score(spark, sf):
    index = documents(spark, sf)
    return index.rows.select("doc_id", F.round(plan.quick(["wor", "from"], index.config), 4).alias("score"))


@register("sco_prefix_only", f"WITH {D} SELECT doc_id, {quick_sql(['worthl'], 'tok')} AS rank FROM d WHERE {begins('worthl')}")
def prefix_only(spark, sf):
    return find(documents(spark, sf), "worthl").ranked().select("doc_id", "rank")


@register("agg_term_frequency", f"WITH {D} SELECT doc_id, CAST({tf('the')} AS BIGINT) AS tf FROM d")
def term_frequency(spark, sf):
    index = documents(spark, sf)
    return index.rows.select("doc_id", plan.occurrences(F.col("tok_w1"), "the").cast("long").alias("tf"))


@register("cch_result_cache", f"{_RANKED} SELECT doc_id, rank FROM r ORDER BY rank DESC, doc_id LIMIT 10")
def result_cache(spark, sf):
    asked = find(documents(spark, sf), _QUERY).limit(10)
    cache = ResultCache()
    cache.page(asked)
    hit = cache.page(asked)
    return (hit if cache.hits == 1 else hit.limit(0)).select("doc_id", "rank")


# --- totals, pages, unions ---------------------------------------------------------------------------------------


@register("agg_count", f"WITH {D} SELECT CAST(count(*) AS BIGINT) AS n FROM d WHERE {_ANY}")
def count_matches(spark, sf):
    return find(documents(spark, sf), _QUERY).ids().agg(F.count("*").alias("n"))


@register("win_total_hits", f"{_RANKED} SELECT doc_id, rank, (SELECT CAST(count(*) AS BIGINT) FROM r) AS total_count FROM r ORDER BY rank DESC, doc_id LIMIT 10")
def total_hits(spark, sf):
    return find(documents(spark, sf), _QUERY).limit(10).get(summary=False).select("doc_id", "rank", "total_count")


@register("lim_page_two", f"{_RANKED} SELECT doc_id, rank FROM r ORDER BY rank DESC, doc_id LIMIT 15 OFFSET 15")
def page_two(spark, sf):
    return find(documents(spark, sf), _QUERY).paginate(15, 2)["rows"].select("doc_id", "rank")


def _model(name: str, source: str, key: str, text: str) -> str:
    return f"(SELECT '{name}' AS model, {key} AS doc_id, {toks(text)} AS tok FROM {source})"


@register("set_multi_model", f"SELECT model, doc_id FROM (FROM {_model('documents', 'documents', 'CAST(doc_id AS VARCHAR)', 'text')} UNION ALL FROM {_model('conversations', 'conversations', chr(39).join(['conv_id || ', '-', ' || turn']), 'text')}) WHERE {begins('from')} AND {begins('this')}")
def multi_model(spark, sf):
    return search(documents(spark, sf), messages(spark, sf)).query("from this").ids()


@register("lim_per_model", f"""
WITH x AS (SELECT model, doc_id, tok FROM {_model('documents', 'documents', 'CAST(doc_id AS VARCHAR)', 'text')} UNION ALL
  SELECT model, doc_id, tok FROM {_model('conversations', 'conversations', chr(39).join(['conv_id || ', '-', ' || turn']), 'text')}),
s AS (SELECT model, CAST(count(*) AS DOUBLE) AS n, avg(len(tok)) AS avgdl, CAST(sum(CASE WHEN list_contains(tok, 'this') THEN 1 ELSE 0 END) AS DOUBLE) AS df_this FROM x GROUP BY model),
r AS (SELECT x.model, doc_id, CASE WHEN ({field_score(['this'], 'tok')}) > 0 THEN {scaled(field_score(['this'], 'tok'))} ELSE {quick_sql(['this'], 'tok')} END AS rank FROM x JOIN s ON x.model = s.model WHERE {begins('this')})
SELECT model, doc_id, rank, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rank DESC, doc_id) AS place FROM r) WHERE place <= 5""")
def per_model(spark, sf):
    found = search(documents(spark, sf), messages(spark, sf)).query("this").per_model(5)
    return found.select("model", "doc_id", "rank", F.col("place").cast("long").alias("place"))


@register("flt_model", f"SELECT model, doc_id FROM {_model('documents', 'documents', 'CAST(doc_id AS VARCHAR)', 'text')} WHERE {begins('from')}")
def model_filter(spark, sf):
    return search(documents(spark, sf), messages(spark, sf)).models("documents").query("from").ids()


@register("set_postings_intersect", f"WITH {D} SELECT doc_id FROM d WHERE list_contains(tok, 'from') AND list_contains(tok, 'this') AND list_contains(tok, 'with')")
def postings_intersect(spark, sf):
    return batch.intersect(documents(spark, sf).table("postings"), ["from", "this", "with"])


@register("set_postings_union", f"WITH {D} SELECT doc_id FROM d WHERE list_contains(tok, 'idiot') OR list_contains(tok, 'moron')")
def postings_union(spark, sf):
    return batch.union(documents(spark, sf).table("postings"), ["idiot", "moron"])


@register("batch_topk", f"""
WITH {D}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tok)) AS avgdl FROM d),
q AS (SELECT item_id AS query_id, list_distinct({toks('text')}) AS qt FROM benchmark),
qt AS (SELECT query_id, len(qt) AS n_terms, unnest(qt) AS term FROM q),
po AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(tok) AS dl, unnest(tok) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM po GROUP BY term),
h AS (SELECT query_id, doc_id, sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / s.avgdl))) AS raw
  FROM qt JOIN po USING (term) JOIN df USING (term), s GROUP BY query_id, doc_id),
r AS (SELECT query_id, doc_id, {scaled('raw')} AS rank FROM h, s)
SELECT query_id, CAST(place AS BIGINT) AS place, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS place FROM r) WHERE place <= 5""")
def batch_topk(spark, sf):
    found = batch.batch_topk(documents(spark, sf), table(spark, sf, "benchmark"), "item_id", "text", 5, "or")
    return found.select("query_id", F.col("place").cast("long").alias("place"), "doc_id", "rank")


# --- snippets ----------------------------------------------------------------------------------------------------

_PLAIN = "regexp_replace(text, '<[^>]*>', '', 'g')"
_AT = f"instr(lower({_PLAIN}), 'worthless')"


@register("snp_snippet", rf"""
SELECT doc_id, CASE WHEN strlen(text) > 50 THEN regexp_replace(
  (CASE WHEN st > 0 THEN '…' ELSE '' END) || substr(p, CAST(st + 1 AS BIGINT), 120) || (CASE WHEN st + 120 < length(p) THEN '…' ELSE '' END), '(worthless)', '<mark>\1</mark>', 'gi') END AS summary
FROM (SELECT doc_id, text, {_PLAIN} AS p, CASE WHEN {_AT} = 0 THEN 0 ELSE greatest(0, {_AT} - 1 - 60) END AS st FROM documents)""")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", snippet.snippet([F.col("text")], parse("worthless").highlights()).alias("summary"))


@register("snp_highlight", r"SELECT doc_id, regexp_replace(text, '(from)', '<mark>\1</mark>', 'gi') AS marked FROM documents")
def highlight(spark, sf):
    return table(spark, sf, "documents").select("doc_id", snippet.marked(F.col("text"), ["from"]).alias("marked"))


# --- suggestions -------------------------------------------------------------------------------------------------

_V = f"""v AS (SELECT word, {'replace(word, chr(223), ' + chr(39) + 'ss' + chr(39) + ')'} AS ascii_word, CAST(count(DISTINCT doc_id) AS BIGINT) AS doc_count
  FROM (SELECT doc_id, unnest(tok) AS word FROM d) GROUP BY word)"""


@register("spl_prefix", f"WITH {D}, {_V} SELECT word, doc_count FROM v WHERE starts_with(ascii_word, 'wo')")
def prefix_candidates(spark, sf):
    return suggest.prefix_candidates(documents(spark, sf).table("vocab"), "worthles").select("word", "doc_count")


_TRI = f"""WITH {D}, {_V}, t AS (SELECT DISTINCT word, ascii_word, doc_count, substr(p, i, 3) AS g FROM (
  SELECT word, ascii_word, doc_count, '#' || ascii_word || '#' AS p, unnest(range(1, CAST(length(ascii_word) + 1 AS BIGINT))) AS i FROM v)),
c AS (SELECT word, ascii_word, doc_count FROM t WHERE g IN ('#wo', 'wor', 'ort', 'rth', 'thl', 'hle', 'les', 'es#') GROUP BY word, ascii_word, doc_count HAVING count(*) >= 2)"""


@register("spl_trigram", f"{_TRI} SELECT word, doc_count FROM c")
def trigram_candidates(spark, sf):
    return suggest.trigram_candidates(documents(spark, sf).table("vocab_tri"), "worthles").select("word", "doc_count")


@register("spl_suggest", f"""{_TRI}, f AS (SELECT word, 1 AS phase, levenshtein('worthles', ascii_word) AS score, doc_count FROM c
  UNION ALL SELECT word, 2, levenshtein('worthles', ascii_word), doc_count FROM v WHERE starts_with(ascii_word, 'wo'))
SELECT word, CAST(min(phase) AS INT) AS phase, CAST(min(score) AS INT) AS score, max(doc_count) AS doc_count FROM f WHERE score BETWEEN 1 AND 3 AND length(word) >= 2
GROUP BY word ORDER BY phase, score, doc_count DESC, word LIMIT 5""")
def suggest_word(spark, sf):
    return suggest.suggest_term(documents(spark, sf), "worthles", 3, 5)


@register("spl_did_you_mean", f"""{_TRI}, f AS (SELECT word, 1 AS phase, levenshtein('worthles', ascii_word) AS score, doc_count FROM c
  UNION ALL SELECT word, 2, levenshtein('worthles', ascii_word), doc_count FROM (SELECT * FROM v WHERE starts_with(ascii_word, 'wo')))
SELECT word FROM (SELECT word, min(phase) AS phase, min(score) AS score, max(doc_count) AS doc_count FROM f WHERE score BETWEEN 1 AND 2 AND length(word) >= 2 GROUP BY word ORDER BY phase, score, doc_count DESC, word LIMIT 3)""")
def did_you_mean(spark, sf):
    # of the two words of the query the second is spelt right beyond any suggestion
    found = suggest.did_you_mean(documents(spark, sf), "worthles AND qqqqqqqqqq", 2, 3)
    return spark.createDataFrame([(w,) for w in found], "word string")


@register("spl_suggest_many", """
WITH q AS (SELECT DISTINCT p_type AS query, lower(p_type) || 's' AS ascii_query FROM part), v AS (SELECT DISTINCT lower(p_type) AS word FROM part),
qt AS (SELECT DISTINCT query, ascii_query, substr('#' || ascii_query || '#', i, 3) AS g FROM (SELECT *, unnest(range(1, CAST(length(ascii_query) + 1 AS BIGINT))) AS i FROM q)),
vt AS (SELECT DISTINCT word, substr('#' || word || '#', i, 3) AS g FROM (SELECT *, unnest(range(1, CAST(length(word) + 1 AS BIGINT))) AS i FROM v)),
c AS (SELECT query, ascii_query, word FROM qt JOIN vt USING (g) GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT ascii_query AS query, word, CAST(levenshtein(ascii_query, word) AS INT) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY levenshtein(ascii_query, word), word) AS INT) AS place
FROM c WHERE levenshtein(ascii_query, word) BETWEEN 1 AND 2""")
def suggest_many(spark, sf):
    types = table(spark, sf, "part").select(F.lower("p_type").alias("word")).distinct()
    vocab = types.select("word", F.col("word").alias("ascii_word"), F.lit(1).cast("long").alias("doc_count"))
    return suggest.suggest_many(vocab, types.select(F.concat("word", F.lit("s")).alias("query")), 2, 100)


