"""Models over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.index import Index
from quern.operators.search import Search, search
from quern.operators.store import IndexStore
from quern.session import shared_folder
from quern.sources.io import table
from quern.spec import ColumnSpec, Config, SearchableSpec

DOCUMENTS = SearchableSpec.of("documents", "doc_id", {"text": 1})
PARTS = SearchableSpec.of("part", "p_partkey", {"p_name": 3, "p_type": 1, "p_brand": 1})
CONVERSATIONS = SearchableSpec("conversations", "key", (ColumnSpec("text"),))
WIDE = Config(max_results=1_000_000)


_STORES: dict[tuple, IndexStore] = {}


def store(spark: SparkSession, config: Config = WIDE) -> IndexStore:
    """A store of this session in the shared folder; it goes when the session ends."""
    key = (spark.sparkContext.applicationId, repr(config))
    if key not in _STORES:
        root = f"{shared_folder(spark)}/indexes-{uuid.uuid4().hex}"
        _STORES[key] = IndexStore(spark, root, config)
        fs, path = _STORES[key]._fs(root)
        fs.deleteOnExit(path)
    return _STORES[key]


def built(spark: SparkSession, sf: str, records: DataFrame, spec: SearchableSpec, config: Config, tenant: str | None = None) -> Index:
    """The written index of a table's records; the first query of a session that needs it writes it."""
    analysis = replace(Config(), max_weight=config.max_weight, analyzer=config.analyzer, stopword_locales=config.stopword_locales, dedupe_on_stopwords=config.dedupe_on_stopwords)
    own, tenant = store(spark, analysis), tenant or sf.strip("/").replace("/", "_")
    if not own.exists(tenant, spec.model):
        own.rebuild(records, spec, tenant)
    return own.load(spec, tenant, records, config)


def documents(spark: SparkSession, sf: str, config: Config = WIDE) -> Index:
    return built(spark, sf, table(spark, sf, "documents"), DOCUMENTS, config)


def parts(spark: SparkSession, sf: str, config: Config = WIDE) -> Index:
    return built(spark, sf, table(spark, sf, "part"), PARTS, config)


def messages(spark: SparkSession, sf: str, config: Config = WIDE) -> Index:
    turns = table(spark, sf, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    return built(spark, sf, turns, CONVERSATIONS, config)


def find(index: Index, query: str) -> Search:
    return search(index).query(query)


def hits(index: Index, query: str) -> DataFrame:
    return find(index, query).ids().select("doc_id")


def norm(column: str) -> str:
    """SQL of a column as the index holds it."""
    bare = f"regexp_replace(coalesce(CAST({column} AS VARCHAR), ''), '<[^>]*>', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents({bare})), '(\S{{32}})\S+', '\1', 'g'), '\s+', ' ', 'g'))"


def toks(column: str, ready: bool = False) -> str:
    """SQL of a column's tokens."""
    text = column if ready else norm(column)
    return rf"list_filter(regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2)"


#: Documents with their tokens.
D = f"d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, n_chars, text, {toks('text')} AS tok FROM documents)"
#: Parts with a token list for each weight that they use.
P = f"""p AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_name, p_brand, p_type, p_size, {toks('p_name')} AS tok3,
  list_concat({toks('p_type')}, {toks('p_brand')}) AS tok1 FROM part)"""


def begins(word: str, tok: str = "tok") -> str:
    return f"len(list_filter({tok}, lambda t: starts_with(t, '{word}'))) > 0"


def tf(word: str, tok: str = "tok") -> str:
    return f"len(list_filter({tok}, lambda t: t = '{word}'))"


def field_score(words: list[str], tok: str, stats: str = "s") -> str:
    """SQL of BM25 over one token list; ``stats`` has n, avgdl and a df_<word> for each word."""
    parts = [
        f"CASE WHEN {tf(w, tok)} > 0 THEN ln(1 + ({stats}.n - {stats}.df_{w} + 0.5) / ({stats}.df_{w} + 0.5)) * ({tf(w, tok)} * 2.2) "
        f"/ ({tf(w, tok)} + 1.2 * (1 - 0.75 + 0.75 * len({tok}) / {stats}.avgdl)) ELSE 0 END"
        for w in words
    ]
    return " + ".join(parts)


def stats_sql(words: list[str], source: str, toklists: list[str]) -> str:
    every = "list_concat(" + ", ".join(toklists) + ")" if len(toklists) > 1 else toklists[0]
    dfs = ", ".join(f"CAST(sum(CASE WHEN list_contains({every}, '{w}') THEN 1 ELSE 0 END) AS DOUBLE) AS df_{w}" for w in words)
    return f"s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len({every})) AS avgdl, {dfs} FROM {source})"


def scaled(raw: str, stats: str = "s") -> str:
    return f"least(round(({raw}) / (ln(1 + ({stats}.n + 0.5) / 0.5) * 2.2 * 3) * 100, 1), 100.0)"


def quick_sql(words: list[str], tok: str) -> str:
    parts = [f"CASE WHEN {tf(w, tok)} > 0 THEN CAST({tf(w, tok)} AS DOUBLE) ELSE least(len(list_filter({tok}, lambda t: starts_with(t, '{w}'))) * 0.1, 1.0) END" for w in words]
    return "round(CAST(" + " + ".join(parts) + " AS DOUBLE), 4)"


def ranked_sql(words: list[str], condition: str) -> str:
    """SQL of (doc_id, rank) of the documents for which the condition holds."""
    raw = field_score(words, "tok")
    return f"""SELECT doc_id, CASE WHEN ({raw}) > 0 THEN {scaled(raw)} ELSE {quick_sql(words, 'tok')} END AS rank
FROM d, s WHERE {condition}"""
