"""Text analysis over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalogue import register
from quern.functions import analysis, stopwords
from quern.operators.store import spread
from quern.queries.base import D, norm
from quern.sources.io import table

_STOP = ", ".join(f"'{w}'" for w in sorted(stopwords.of(("en", "fr"))) if "'" not in w)
_SPACED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def _documents(spark, sf):
    """The documents dealt out to the cores, for steps in Python that take a while a text."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@register("txt_strip_html", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", analysis.strip_html(F.col("html")).alias("text"))


@register("txt_nfc", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc(spark, sf):
    return _documents(spark, sf).select("doc_id", analysis.nfc("text").alias("text"))


@register("txt_fold_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def fold_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", analysis.fold_accents(F.col("text")).alias("text"))


@register("txt_fold_accents_exact", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def fold_accents_exact(spark, sf):
    return _documents(spark, sf).select("doc_id", analysis.fold_accents_exact("text").alias("text"))


_CJK = r"\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"


@register("txt_separate_cjk", rf"""
SELECT doc_id, regexp_replace(regexp_replace(t, '([{_CJK}])([{_CJK}])', '\1 \2', 'g'), '([{_CJK}])([{_CJK}])', '\1 \2', 'g') AS text
FROM (SELECT doc_id, '开发入门 ' || substr(text, 1, 0) || text || ' カナ한글' AS t FROM documents)""")
def separate_cjk(spark, sf):
    text = F.concat(F.lit("开发入门 "), F.col("text"), F.lit(" カナ한글"))
    return table(spark, sf, "documents").select("doc_id", analysis.separate_cjk(text).alias("text"))


@register("txt_lowercase", "SELECT doc_id, lower(text) AS text FROM documents")
def lowercase(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))


@register("txt_squish", rf"SELECT doc_id, {_SPACED} AS text FROM documents")
def squish(spark, sf):
    return table(spark, sf, "documents").select("doc_id", analysis.squish(F.col("text")).alias("text"))


@register("txt_truncate_tokens", r"SELECT doc_id, regexp_replace(text, '(\S{12})\S+', '\1', 'g') AS text FROM documents")
def truncate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", analysis.truncate_tokens(F.col("text"), 12).alias("text"))


@register("txt_stopwords", rf"""
SELECT doc_id, array_to_string(list_filter(string_split({_SPACED}, ' '), lambda w: NOT list_contains([{_STOP}], w)), ' ') AS text FROM documents""")
def remove_stopwords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", analysis.remove_stopwords(analysis.squish(F.col("text")), ("en", "fr")).alias("text"))


@register("txt_stopwords_dedupe", rf"""
WITH w AS (SELECT doc_id, string_split({_SPACED}, ' ') AS l FROM documents),
u AS (SELECT doc_id, word, min(i) AS i FROM (SELECT doc_id, unnest(l) AS word, unnest(range(1, CAST(len(l) + 1 AS BIGINT))) AS i FROM w) GROUP BY doc_id, word)
SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (word NOT IN ({_STOP})), '') AS text FROM u GROUP BY doc_id""")
def remove_stopwords_dedupe(spark, sf):
    return table(spark, sf, "documents").select("doc_id", analysis.remove_stopwords(analysis.squish(F.col("text")), ("en", "fr"), dedupe=True).alias("text"))


@register("txt_analyze", f"SELECT doc_id, {norm('text')} AS text FROM documents")
def analyze(spark, sf):
    return _documents(spark, sf).select("doc_id", analysis.analyze(F.col("text")).alias("text"))


@register("txt_tokens", f"WITH {D} SELECT doc_id, CAST(len(tok) AS BIGINT) AS n, array_to_string(tok, ' ') AS tokens FROM d")
def tokens(spark, sf):
    t = analysis.tokens(analysis.analyze(F.col("text")))
    return _documents(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


@register("txt_vocabulary_tokens", rf"""
SELECT doc_id, CAST(count(DISTINCT w) AS BIGINT) AS n FROM (
  SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(trim(text), '\s+')), '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g') AS w FROM documents)
WHERE w <> '' GROUP BY doc_id""")
def vocabulary_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(analysis.vocabulary_tokens(F.col("text"))).cast("long").alias("n")).where("n > 0")


@register("txt_trigrams", """
SELECT p_partkey, string_agg(g, ' ' ORDER BY g) AS trigrams FROM (
  SELECT DISTINCT p_partkey, substr(p, i, 3) AS g FROM (
    SELECT p_partkey, p, unnest(range(1, CAST(length(p) - 1 AS BIGINT))) AS i FROM (SELECT p_partkey, '#' || p_name || '#' AS p FROM part)))
GROUP BY p_partkey""")
def trigrams(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.sort_array(analysis.trigrams(F.col("p_name"))), " ").alias("trigrams"))


@register("txt_scripts", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '\p{Latin}') AND regexp_matches(text, '\p{Cyrillic}') THEN 'Latin,Cyrillic'
  WHEN regexp_matches(text, '\p{Latin}') THEN 'Latin' WHEN regexp_matches(text, '\p{Cyrillic}') THEN 'Cyrillic' ELSE 'Common' END AS scripts FROM documents""")
def scripts(spark, sf):
    return _documents(spark, sf).select("doc_id", F.array_join(analysis.scripts(F.col("text")), ",").alias("scripts"))


@register("txt_similar", """
SELECT p_partkey, contains(strip_accents(p_name), 'widget') OR levenshtein(strip_accents(p_name), 'widget') <= 2 AS alike FROM part""")
def similar(spark, sf):
    return table(spark, sf, "part").select("p_partkey", analysis.similar(F.col("p_name"), F.lit("widget")).alias("alike"))


@register("txt_contains_folded", "SELECT doc_id, contains(strip_accents(text), 'eaux') AS found FROM documents")
def contains_folded(spark, sf):
    return table(spark, sf, "documents").select("doc_id", analysis.contains_folded(F.col("text"), F.lit("eàux")).alias("found"))


_ASCII = "replace(replace(replace(lower(strip_accents(text)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"


@register("txt_transliterate", f"SELECT doc_id, {_ASCII} AS text FROM documents")
def transliterate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", analysis.transliterate(F.col("text")).alias("text"))


@register("txt_arabic_stem")
def arabic_stem(spark, sf):
    return _documents(spark, sf).select("doc_id", analysis.arabic_stems("text").alias("text"))


@register("txt_stemming")
def stemming(spark, sf):
    return _documents(spark, sf).select("doc_id", analysis.analyze(F.col("text"), "stemming").alias("text"))


@register("txt_fallback", rf"""
SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(lower(strip_accents(regexp_replace(text, '<[^>]*>', '', 'g'))), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '(\S{{32}})\S+', '\1', 'g'), '\s+', ' ', 'g')) AS text FROM documents""")
def fallback(spark, sf):
    return table(spark, sf, "documents").select("doc_id", analysis.analyze(F.col("text"), "fallback").alias("text"))


