"""The query builder: everything up to the top results is one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import analysis
from quern.operators import snippet
from quern.operators.index import Index
from quern.plans import compile as plan
from quern.plans import postings
from quern.plans.parser import ParsedQuery, parse

RESULT = "id string, model string, doc_id string, rank double, title string, summary string, raw map<string,string>, authorized boolean, total_count long"
_UNSET = object()
#: Rows of a page that is broadcast to the records; larger ones are joined by shuffles.
PAGE_ROWS = 10_000
#: Rank expressions over index rows by name: (query, index) -> Column.
SCORERS: dict[str, Callable[[ParsedQuery, Index], Column]] = {}


def register_scorer(name: str, scorer: Callable[[ParsedQuery, Index], Column]) -> None:
    """Makes ``Search.scorer(name)`` rank by an expression over index rows."""
    SCORERS[name] = scorer


@dataclass(frozen=True)
class Boost:
    column: str
    factor: float
    now: str | None = None


@dataclass(frozen=True)
class Search:
    """An immutable query over one or more indexes; each method returns a new one."""

    indexes: tuple[Index, ...]
    text: str = ""
    mode_name: str = "advanced"
    only: tuple[str, ...] = ()
    rows: int = 50
    skip: int = 0
    filters: tuple[Column, ...] = field(default=(), compare=False)
    boosted: Boost | None = None
    fall_back: bool = False
    scorer_name: str | None = None
    acl: DataFrame | None = field(default=None, compare=False)
    allowed: Column | None = field(default=None, compare=False)

    # --- building ----------------------------------------------------------------------------------------------

    def query(self, text: str) -> Search:
        return replace(self, text=text)

    def mode(self, mode: str) -> Search:
        return replace(self, mode_name=mode)

    def models(self, *models: str) -> Search:
        return replace(self, only=models)

    def limit(self, n: int) -> Search:
        return replace(self, rows=max(1, min(n, self.indexes[0].config.max_results)))

    def offset(self, n: int) -> Search:
        return replace(self, skip=max(0, n))

    def boost(self, column: str, factor: float = 1.0, now: str | None = None) -> Search:
        """Recency: up to 3 * factor more for a date of today, nothing after 30 days.  The last call counts."""
        return replace(self, boosted=Boost(column, factor, now))

    def with_authorization(self, acl: DataFrame | None = None, allowed: Column | None = None) -> Search:
        """Only records with their doc_id in acl, or for which the condition on source columns holds."""
        return replace(self, acl=acl, allowed=allowed)

    def fallback(self, on: bool = True) -> Search:
        """Where nothing is found and the query isn't ASCII: records whose text begins with it or holds it."""
        return replace(self, fall_back=on)

    def scorer(self, name: str | None) -> Search:
        """Ranks by a registered scorer instead of BM25."""
        if name is not None and name not in SCORERS:
            raise ValueError(f"no scorer {name!r}; there are {', '.join(sorted(SCORERS))}")
        return replace(self, scorer_name=name)

    def _and(self, condition: Column) -> Search:
        return replace(self, filters=(*self.filters, condition))

    def where(self, column: str, operator: object = _UNSET, value: object = _UNSET) -> Search:
        """``where(c)``: is true; ``where(c, v)``: equals or, for a list, is in; ``where(c, op, v)``."""
        if operator is _UNSET:
            return self._and(F.col(column) == F.lit(True))
        if value is _UNSET:
            if isinstance(operator, (list, tuple, set)):
                return self.where_in(column, operator)
            return self.where_null(column) if operator is None else self._and(F.col(column) == F.lit(operator))
        if value is None:
            tests = {"=": self.where_null, "==": self.where_null, "!=": self.where_not_null, "<>": self.where_not_null}
            return tests[operator](column) if operator in tests else self._and(F.lit(False))  # nothing is above or below null
        c, v = F.col(column), F.lit(value)
        tests = {"=": c == v, "==": c == v, "!=": c != v, "<>": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}
        if operator not in tests:
            raise ValueError(f"unknown operator {operator!r}")
        return self._and(tests[operator])

    def where_in(self, column: str, values) -> Search:
        return self._and(F.col(column).isin(list(values)))

    def where_not_in(self, column: str, values) -> Search:
        """Null passes."""
        return self._and(~F.col(column).isin(list(values)) | F.col(column).isNull())

    def where_null(self, column: str) -> Search:
        return self._and(F.col(column).isNull())

    def where_not_null(self, column: str) -> Search:
        return self._and(F.col(column).isNotNull())

    def where_between(self, column: str, low, high) -> Search:
        return self._and(F.col(column).between(low, high))

    # --- running -----------------------------------------------------------------------------------------------

    @property
    def config(self):
        return self.indexes[0].config

    def parsed(self) -> ParsedQuery:
        return parse(self.text, self.config, self.mode_name)

    def _chosen(self) -> list[Index]:
        return [i for i in self.indexes if not self.only or i.spec.model in self.only]

    def _with_source(self, index: Index, found: DataFrame) -> DataFrame:
        """The rows with their records' columns; those whose record is gone drop out if a condition needs it."""
        if not (self.filters or self.boosted or self.allowed is not None):
            return found
        if index.source is None:
            raise ValueError(f"{index.spec.model}: conditions on records need the index's source")
        needed = reduce(and_, self.filters) if self.filters else None
        source = index.source.withColumn("__key", F.col(f"`{index.spec.key}`").cast("string"))
        if needed is not None:
            source = source.where(needed)
        if self.allowed is not None:
            source = source.where(self.allowed)
        keep = ["__key"] + ([self.boosted.column] if self.boosted else [])
        inner = needed is not None or self.allowed is not None
        joined = found.join(source.select(*[F.col(k).alias(f"__{k.strip('_')}") for k in keep]), F.col("doc_id") == F.col("__key"), "inner" if inner else "left")
        return joined.drop("__key")

    def _hits(self, index: Index, ranked: bool) -> DataFrame:
        query, config = self.parsed(), self.config
        columns = self._columns(index)
        if index.written and self.scorer_name is None:
            weights = {c: w for c, (_, w) in columns.items()}
            found = postings.matching(query, index.table("postings"), config, weights, ranked)
            if postings.needs_rows(query):
                own = index.rows.join(found.select(F.col("doc_id").alias("__found")), F.col("doc_id") == F.col("__found"), "left_semi")
                own = own.where(plan.matches(query, config, {c: x for c, (x, _) in columns.items()})).select("doc_id")
                found = found.join(own, "doc_id", "left_semi")
            found = found.withColumn("model", F.lit(index.spec.model))
        else:
            found = index.rows.where(plan.matches(query, config, {c: x for c, (x, _) in columns.items()}))
        if self.acl is not None:
            found = found.join(self.acl.select(F.col(self.acl.columns[0]).cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")
        if not ranked:
            return self._with_source(index, found.select("model", "doc_id"))
        if self.scorer_name is not None:
            rank = SCORERS[self.scorer_name](query, index).cast("double")
        else:
            docs, avg, df = index.statistics_for(query.words())
            rank = (postings if index.written else plan).rank(query, df, docs, avg, config)
        if index.written and self.scorer_name is None:
            found = found.join(index.rows.select("doc_id", "title", *[f"len_w{w}" for w in plan.buckets(config)]), "doc_id")
        scored = self._with_source(index, found.select("model", "doc_id", "title", rank.alias("rank")))
        if self.boosted and self.boosted.factor > 0:
            at = F.col(f"__{self.boosted.column}").cast("timestamp")
            now = F.lit(self.boosted.now).cast("timestamp") if self.boosted.now else F.current_timestamp()
            days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86400e6))
            recent = 3 * F.greatest(F.lit(0.0), 30 - days) / 30
            scored = scored.withColumn("rank", F.when(at.isNull(), F.col("rank")).otherwise(F.least(F.col("rank") * (1 + self.boosted.factor * recent), F.lit(100.0))))
        return scored.select("model", "doc_id", "rank", "title")

    def _columns(self, index: Index) -> dict[str, tuple[Column, int]]:
        """Token arrays and weights of single columns that have a weight bucket to themselves, for ``column:term``."""
        weights = [min(max(c.weight, 1), self.config.max_weight) for c in index.spec.columns]
        names = {c.name: (F.col(f"tok_w{w}"), w) for c, w in zip(index.spec.columns, weights, strict=True) if weights.count(w) == 1}
        shared = {c.name for c in index.spec.columns} - set(names)
        asked = {t.column for t in (*self.parsed().positive, *self.parsed().exclude)} & shared
        if asked:
            raise ValueError(f"{', '.join(sorted(asked))}: shares its weight with another column, whose words are kept together")
        return names

    def _union(self, ranked: bool) -> DataFrame | None:
        strict = replace(self, fall_back=False)
        if self.fall_back and self.text.strip() and not self.text.isascii() and strict.ids().isEmpty():
            parts = [starts_like(i, self.text) for i in self._chosen()]
        else:
            parts = [] if self.parsed().empty else [self._hits(i, ranked) for i in self._chosen()]
        if not parts:
            return None
        names = [i.spec.model for i in self._chosen()]
        every = reduce(DataFrame.unionByName, [p.select(*(["model", "doc_id", "rank", "title"] if ranked else ["model", "doc_id"])) for p in parts])
        # a record that two indexes of one model hold is one result
        return every if len(set(names)) == len(names) else every.dropDuplicates(["model", "doc_id"])

    def ids(self) -> DataFrame:
        """(model, doc_id) of all matches."""
        found = self._union(False)
        return self._empty().select("model", "doc_id") if found is None else found.select("model", "doc_id")

    def ranked(self) -> DataFrame:
        """(model, doc_id, rank, title) of all matches, best first; ties by model and key."""
        found = self._union(True)
        return (self._empty().select("model", "doc_id", "rank", "title") if found is None else found).orderBy(F.desc("rank"), "model", "doc_id")

    def _empty(self) -> DataFrame:
        return self.indexes[0].rows.sparkSession.createDataFrame([], RESULT)

    def page(self) -> DataFrame:
        """(model, doc_id, rank, title) of the page."""
        return self.ranked().offset(self.skip).limit(self.rows) if self.skip else self.ranked().limit(self.rows)

    def count(self) -> int:
        return self.ids().count()

    def aggregate(self, column: str) -> DataFrame:
        """(value, count): all matches by a source attribute, conditions applied; null is ``unknown``."""
        parts = []
        for index in [] if self.parsed().empty else self._chosen():
            bare = replace(self, boosted=None)
            found = bare._hits(index, False).select("doc_id")
            source = index.source.select(F.col(f"`{index.spec.key}`").cast("string").alias("doc_id"), F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value"))
            parts.append(source.join(found, "doc_id"))
        if not parts:
            return self._empty().sparkSession.createDataFrame([], "value string, count long")
        return reduce(DataFrame.unionByName, parts).groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")

    def get(self, summary: bool = True) -> DataFrame:
        """The page as results, with the total of matches on each row and a snippet from the record."""
        if self.parsed().empty and not self.fall_back:
            return self._empty()
        total = self.ids().agg(F.count("*").alias("total_count"))
        top = self.page().crossJoin(F.broadcast(total))  # one row
        out = top.select(F.concat_ws(":", "model", "doc_id").alias("id"), "*")
        parts = []
        for index in self._chosen():
            own = out.where(F.col("model") == index.spec.model)
            wanted = [c for c in index.spec.columns if c.snippet and c.expression is None and "." not in c.name and "->" not in c.name]
            if summary and index.source is not None and wanted:
                texts = index.source.select(F.col(f"`{index.spec.key}`").cast("string").alias("doc_id"), *[F.col(f"`{c.name}`").cast("string").alias(f"__s{k}") for k, c in enumerate(wanted)])
                own = (F.broadcast(own) if self.rows <= PAGE_ROWS else own).join(texts, "doc_id")
                own = own.withColumn("summary", snippet.snippet([F.col(f"__s{k}") for k in range(len(wanted))], self.parsed().highlights()))
                raw = F.create_map(*[x for k, c in enumerate(wanted) for x in (F.lit(c.name), F.col(f"__s{k}"))])
            else:
                own, raw = own.withColumn("summary", F.lit(None).cast("string")), F.create_map().cast("map<string,string>")
            parts.append(own.select("id", "model", "doc_id", "rank", "title", "summary", raw.alias("raw"), F.lit(True).alias("authorized"), "total_count"))
        return reduce(DataFrame.unionByName, parts).orderBy(F.desc("rank"), "model", "doc_id")

    def records(self, columns: list[str]) -> DataFrame:
        """(doc_id, columns of the record) of all matches whose record is there."""
        parts = []
        for index in self._chosen():
            if index.source is None:
                raise ValueError(f"{index.spec.model}: records need the index's source")
            own = index.source.select(F.col(f"`{index.spec.key}`").cast("string").alias("doc_id"), *[c for c in columns if c != "doc_id"])
            found = self.ids().where(F.col("model") == index.spec.model).select("doc_id")
            parts.append(own.join(found, "doc_id", "left_semi"))
        return reduce(DataFrame.unionByName, parts)

    def paginate(self, per_page: int = 15, page: int = 1) -> dict:
        per_page = max(1, min(per_page, self.config.max_results))
        total = self.count()
        return {"rows": self.limit(per_page).offset((max(1, page) - 1) * per_page).get(), "total": total, "per_page": per_page, "page": max(1, page), "last_page": max(1, -(-total // per_page))}

    def per_model(self, share: int) -> DataFrame:
        """The best ``share`` matches of each model."""
        found = self._union(True)
        w = Window.partitionBy("model").orderBy(F.desc("rank"), "doc_id")
        return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= share)

    def rows_within(self, seconds: float) -> list:
        """The page's rows (at most ``limit``); TimeoutError, and the jobs cancelled, if it takes longer."""
        from threading import Timer

        spark, tag = self.indexes[0].rows.sparkSession, f"search-{id(self)}"
        late: list[bool] = []
        timer = Timer(seconds, lambda: (late.append(True), spark.interruptTag(tag)))
        spark.addTag(tag)
        timer.start()
        try:
            return self.page().collect()
        except Exception:
            if late:
                raise TimeoutError(f"the search took more than {seconds} s") from None
            raise
        finally:
            timer.cancel()
            spark.removeTag(tag)

    def explain(self) -> str:
        """The formatted plan of the page."""
        df = self.page()
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def search(*indexes: Index) -> Search:
    if not indexes:
        raise ValueError("a search needs an index")
    return Search(tuple(indexes))


def starts_like(index: Index, query: str) -> DataFrame:
    """Records whose text begins with the query (3 characters or more) or holds it, rank 0.5, highest key first.

    A fallback for scripts that tokens don't serve; used when a search finds nothing.
    """
    q = analysis.analyzed_py(query, index.config.analyzer)
    text = F.concat_ws(" ", *[F.col(f"text_w{w}") for w in range(1, index.config.max_weight + 1)])
    text = F.trim(text)
    found = index.rows.where(F.startswith(text, F.lit(q)) if len(q) >= 3 else F.contains(text, F.lit(q)))
    return found.select("model", "doc_id", F.lit(0.5).alias("rank"), "title").orderBy(F.desc(F.col("doc_id").cast("long")), F.desc("doc_id"))


def results_json(results: DataFrame) -> DataFrame:
    """One JSON object a result."""
    return results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("json"))


