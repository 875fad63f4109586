"""Indexes: one row a record, with weight buckets of analysed text and their tokens; statistics and vocabulary."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import analysis
from quern.spec import TITLES, ColumnSpec, Config, SearchableSpec


def once(df: DataFrame) -> DataFrame:
    """The same rows, computed once each: conditions on them aren't pushed below, where they'd repeat the analysis."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def with_relations(records: DataFrame, spec: SearchableSpec) -> DataFrame:
    """The records with a column ``relation.name`` for each dot-notation column."""
    for r in spec.relations:
        wanted = [c.name.split(".", 1)[1] for c in spec.columns if c.name.startswith(r.name + ".")]
        if not wanted:
            continue
        key = F.col(r.foreign_key).alias("__fk")
        if r.many:
            place = F.col("__at") if r.order_by else F.col("__id")
            rows = r.rows.select(key, *([F.col(r.order_by).alias("__at")] if r.order_by else []), *[F.nullif(F.coalesce(F.col(w).cast("string"), F.lit("")), F.lit("")).alias(w) for w in wanted])
            rows = rows.withColumn("__id", F.monotonically_increasing_id())
            # of each column the first values of a key that aren't empty: a key with millions of rows collects no more
            for k, w in enumerate(wanted):
                n = F.row_number().over(Window.partitionBy("__fk", F.col(f"`{w}`").isNull()).orderBy(place, "__id"))
                rows = rows.withColumn(f"__n{k}", n).withColumn(w, F.when(F.col(f"__n{k}") <= r.limit, F.col(f"`{w}`")))
            rows = rows.where(F.coalesce(*[F.col(f"`{w}`") for w in wanted]).isNotNull())
            first = lambda k, w: F.transform(F.sort_array(F.filter(F.collect_list(F.when(F.col(f"`{w}`").isNotNull(), F.struct(F.col(f"__n{k}").alias("n"), F.col(f"`{w}`").alias("v")))), lambda x: x.isNotNull())), lambda x: x["v"])
            rows = rows.groupBy("__fk").agg(*[F.array_join(first(k, w), " ").alias(f"{r.name}.{w}") for k, w in enumerate(wanted)])
        else:
            rows = r.rows.select(key, *[F.col(w).cast("string").alias(f"{r.name}.{w}") for w in wanted])
        records = records.join(rows, F.col(f"`{r.local_key}`") == F.col("__fk"), "left").drop("__fk")
    return records


def document(records: DataFrame, spec: SearchableSpec) -> DataFrame:
    """(doc_id, one string column for each searchable column), for the records that are to be indexed."""
    if spec.should_sync is not None:
        records = records.where(spec.should_sync)
    records = with_relations(records, spec)
    return records.select(F.col(f"`{spec.key}`").cast("string").alias("doc_id"), *[F.coalesce(c.value().cast("string"), F.lit("")).alias(c.name) for c in spec.columns])


def title_of(spec: SearchableSpec) -> Column:
    """The first non-empty of the columns named like titles, else the first non-empty searchable column."""
    names = [c.name for c in spec.columns]
    order = [n for n in TITLES if n in names] + [n for n in names if n not in TITLES]
    return F.coalesce(*[F.when(F.trim(F.col(f"`{n}`")) != "", F.col(f"`{n}`")) for n in order], F.lit(""))


def rows(records: DataFrame, spec: SearchableSpec, config: Config = Config(), tenant: str = "default", synced_at: Column | None = None) -> DataFrame:
    """The index rows of records."""
    docs = document(records, spec)
    weight = lambda c: min(max(c.weight, 1), config.max_weight)

    def analysed(c: ColumnSpec) -> Column:
        return analysis.analyzed(F.col(f"`{c.name}`"), config.analyzer, config.stopword_locales, config.dedupe_on_stopwords, c.locale)

    # the usual analyser gives texts and tokens in one pass; others give texts, whose tokens are taken in a second one
    whole = config.analyzer == "unicode" and not config.stopword_locales
    staged = once(docs.select("doc_id", title_of(spec).alias("title"), *[(analysis.with_tokens(F.col(f"`{c.name}`")) if whole else analysed(c)).alias(f"a{k}") for k, c in enumerate(spec.columns)]))
    text_of = lambda name: F.col(f"{name}.text") if whole else F.col(name)
    tokens_of = lambda name: F.col(f"{name}.tok") if whole else analysis.tokens(F.col(name))
    texts, toks = [], []
    for w in range(1, config.max_weight + 1):
        own = [f"a{k}" for k, c in enumerate(spec.columns) if weight(c) == w]
        texts.append((F.trim(F.concat_ws(" ", *map(text_of, own))) if own else F.lit("")).alias(f"text_w{w}"))
        parts = []
        for name in own:
            parts += [tokens_of(name), F.array(F.lit(""))]
        toks.append((F.concat(*parts[:-1]) if own else F.array().cast("array<string>")).alias(f"tok_w{w}"))
    at = (synced_at if synced_at is not None else F.lit(None).cast("timestamp")).alias("last_synced_at")
    made = once(staged.select(F.lit(tenant).alias("tenant"), F.lit(spec.model).alias("model"), "doc_id", "title", *texts, *toks, at))
    return with_lengths(made, config)


def with_lengths(frame: DataFrame, config: Config = Config()) -> DataFrame:
    """Index rows with the number of tokens of each bucket, null for a bucket without text."""
    length = lambda w: F.when(F.col(f"text_w{w}") != "", F.size(F.array_remove(F.col(f"tok_w{w}"), "")))
    return frame.withColumns({f"len_w{w}": length(w) for w in range(1, config.max_weight + 1)})


def words_of(config: Config = Config()) -> Column:
    """All tokens of a row, duplicates included."""
    return F.array_remove(F.concat(*[F.col(f"tok_w{w}") for w in range(1, config.max_weight + 1)]), "")


def stats(index: DataFrame, config: Config = Config()) -> DataFrame:
    """(tenant, model, doc_count, avg_len)"""
    return index.groupBy("tenant", "model").agg(F.count("*").alias("doc_count"), F.avg(F.size(words_of(config))).alias("avg_len"))


def term_df(index: DataFrame, config: Config = Config()) -> DataFrame:
    """(tenant, model, term, df): documents that hold each term in any bucket."""
    return index.select("tenant", "model", F.explode(F.array_distinct(words_of(config))).alias("term")).groupBy("tenant", "model", "term").agg(F.count("*").alias("df"))


def postings(index: DataFrame, config: Config = Config()) -> DataFrame:
    """(tenant, model, term, doc_id, w, tf, dl): occurrences of each term in each bucket of each document."""
    every = None
    for w in range(1, config.max_weight + 1):
        own = F.filter(F.col(f"tok_w{w}"), lambda t: t != "")
        part = index.where(F.size(f"tok_w{w}") > 0).select("tenant", "model", "doc_id", F.size(own).alias("dl"), own.alias("own"))
        part = part.select("tenant", "model", "doc_id", "dl", F.explode("own").alias("term"))
        # a document is a row, so that its terms are counted before anything is shuffled
        counted = part.groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"), *[F.first(c).alias(c) for c in ("tenant", "model", "dl")])
        counted = counted.select("tenant", "model", "term", "doc_id", F.lit(w).alias("w"), "tf", "dl")
        every = counted if every is None else every.unionByName(counted)
    return every


def vocabulary(index: DataFrame, config: Config = Config()) -> DataFrame:
    """(tenant, word, ascii_word, doc_count)"""
    words = index.select("tenant", F.explode(F.array_distinct(words_of(config))).alias("word")).groupBy("tenant", "word").agg(F.count("*").alias("doc_count"))
    return words.select("tenant", "word", analysis.transliterate(F.col("word")).alias("ascii_word"), "doc_count")


def vocabulary_trigrams(vocab: DataFrame) -> DataFrame:
    """(tenant, trigram, word, ascii_word, doc_count)"""
    return vocab.select("tenant", F.explode(analysis.trigrams(F.col("ascii_word"))).alias("trigram"), "word", "ascii_word", "doc_count")


class Index:
    """An index's tables, from rows in memory or from a written version."""

    def __init__(self, frame: DataFrame, spec: SearchableSpec, config: Config = Config(), tenant: str = "default", source: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, figures: tuple[int, float] | None = None, version: int | None = None):
        if not tenant:
            raise ValueError("an index belongs to a tenant")
        self.spec, self.config, self.tenant, self.source = spec, config, tenant, source
        self.rows = frame.where(F.col("tenant") == tenant)
        self._tables = tables or {}
        self._figures, self.version = figures, version

    @staticmethod
    def over(records: DataFrame, spec: SearchableSpec, config: Config = Config(), tenant: str = "default", **more) -> Index:
        return Index(rows(records, spec, config, tenant, **more), spec, config, tenant, records)

    def table(self, name: str) -> DataFrame:
        made = {"stats": stats, "term_df": term_df, "postings": postings, "vocab": vocabulary}
        if name in self._tables:
            return self._tables[name].where(F.col("tenant") == self.tenant)
        if name == "vocab_tri":
            return vocabulary_trigrams(self.table("vocab"))
        return made[name](self.rows, self.config)

    @cached_property
    def _stats(self) -> tuple[int, float]:
        if self._figures is not None:
            return self._figures
        # one row; with the words of a query's terms it would be one more scan, so it is kept
        row = self.table("stats").agg(F.sum("doc_count"), F.sum(F.col("avg_len") * F.col("doc_count")) / F.sum("doc_count")).first()
        return int(row[0] or 0), float(row[1] or 0.0)

    def with_source(self, source: DataFrame) -> Index:
        """The same index over other records of the same keys."""
        return Index(self.rows, self.spec, self.config, self.tenant, source, self._tables, self._figures, self.version)

    @property
    def written(self) -> bool:
        """Whether the index has postings of its own, so that a query need not read all rows."""
        return "postings" in self._tables

    @property
    def doc_count(self) -> int:
        return self._stats[0]

    @property
    def avg_len(self) -> float:
        return self._stats[1]

    def statistics_for(self, words: list[str]) -> tuple[int, float, dict[str, int]]:
        """Documents, mean length, and the document frequency of each word: a row as wide as the query."""
        if "term_df" in self._tables:
            found = self.table("term_df").where(F.col("term").isin(words)).groupBy("term").agg(F.sum("df")).collect() if words else []
            return self.doc_count, self.avg_len, dict(map(tuple, found))
        own = words_of(self.config)
        holds = [F.sum(F.array_contains(own, w).cast("long")) for w in words]
        row = self.rows.agg(F.count("*"), F.avg(F.size(own)), *holds).first()
        return int(row[0]), float(row[1] or 0.0), {w: int(row[2 + k] or 0) for k, w in enumerate(words)}


def numeric_key(c: Column) -> Column:
    """Keys that are all digits in the order of their numbers, after all others."""
    return F.when(F.regexp_like(c, F.lit(r"^\d{1,18}$")), F.try_to_number(c, F.lit("9" * 18)).cast("long"))


def pruned(index: DataFrame, keep: int) -> DataFrame:
    """The rows of the ``keep`` highest keys of a model's index; all if keep is 0.

    The lowest of these keys is found on the keys alone, by a limited sort, and then every row is held against it.
    """
    if keep <= 0:
        return index
    order = lambda number: F.struct(number.isNotNull().alias("numeric"), number.alias("number"), F.col("doc_id").alias("key"))
    own = order(numeric_key(F.col("doc_id")))
    highest = index.select(own.alias("k")).orderBy(F.desc("k")).limit(keep)
    last = highest.agg(F.count("*").alias("n"), F.min("k").alias("k")).first()
    if last["n"] < keep:
        return index
    border = F.struct(F.lit(last["k"]["numeric"]).alias("numeric"), F.lit(last["k"]["number"]).cast("long").alias("number"), F.lit(last["k"]["key"]).alias("key"))
    return index.where(own >= border)


def orphans(index: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The index rows whose record is gone."""
    there = records.select(F.col(f"`{key}`").cast("string").alias("doc_id")).distinct()
    return index.join(there, "doc_id", "left_anti")


def latest_changes(changes: DataFrame, key: str = "doc_id", at: str = "ts", order: str | None = None) -> DataFrame:
    """The last change of each key: one aggregate, no window."""
    others = [c for c in changes.columns if c != key]
    ties = [F.col(at)] + ([F.col(order)] if order else [])
    last = changes.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*ties)).alias("__last"))
    return last.select(key, *[F.col(f"__last.{c}").alias(c) for c in others])
