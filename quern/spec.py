"""What is searchable, and the engine's settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLES = ("title", "name", "label", "titre", "nom")


def column_key(name: str) -> str:
    """The storage name of a column path: dots, arrows and dashes become underscores."""
    return name.replace("->", "_").replace(".", "_").replace("-", "_")


@dataclass(frozen=True)
class ColumnSpec:
    """A searchable column: a name, ``relation.name``, ``json->path``, or a computed ``expression``."""

    name: str
    weight: int = 1
    locale: str = "en"
    snippet: bool = True
    expression: Column | None = field(default=None, compare=False)

    def value(self) -> Column:
        if self.expression is not None:
            return self.expression
        if "->" in self.name:
            base, *path = self.name.split("->")
            return F.get_json_object(F.col(base), "$." + ".".join(path))
        return F.col(f"`{self.name}`")


@dataclass(frozen=True)
class Relation:
    """Rows that dot-notation columns come from: ``name.column``.

    ``many=False``: the row whose ``foreign_key`` equals the record's ``local_key``; ``many=True``: all such rows,
    in the order of ``order_by``, of which the first ``limit`` non-empty values are joined by spaces.
    """

    name: str
    rows: DataFrame
    local_key: str
    foreign_key: str
    many: bool = False
    order_by: str | None = None
    limit: int = 100


@dataclass(frozen=True)
class SearchableSpec:
    """A model: its key, its searchable columns, the relations they use, and which records are indexed."""

    model: str
    key: str
    columns: tuple[ColumnSpec, ...]
    relations: tuple[Relation, ...] = ()
    should_sync: Column | None = field(default=None, compare=False)

    @staticmethod
    def of(model: str, key: str, columns: Mapping[str, object] | Sequence[object], **more) -> SearchableSpec:
        """Columns in any spelling: a list of names, or name -> True, a weight, or {weight, locale, snippet}."""
        found = []
        pairs = columns.items() if isinstance(columns, Mapping) else [(c, True) for c in columns]
        for name, options in pairs:
            if isinstance(name, ColumnSpec):
                found.append(name)
            elif options is True or options is None:
                found.append(ColumnSpec(name))
            elif isinstance(options, int):
                found.append(ColumnSpec(name, options))
            elif isinstance(options, ColumnSpec):
                found.append(replace(options, name=name))
            else:
                found.append(ColumnSpec(name, **options))
        return SearchableSpec(model, key, tuple(found), **more)

    def positional(self, config: Config | None = None) -> SearchableSpec:
        """The same columns weighted by their place: the first has the largest weight, each next one less, 1 at least."""
        top = (config or Config()).max_weight
        return replace(self, columns=tuple(replace(c, weight=max(1, top - k)) for k, c in enumerate(self.columns)))

    def snippet_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.snippet]


@dataclass(frozen=True)
class Config:
    max_weight: int = 3
    max_results: int = 50
    max_documents: int = 50_000
    near_max_distance: int = 5
    default_operator: str = "and"
    operators: tuple[str, ...] = ("AND", "OR", "NOT", "NEAR")
    stopword_locales: tuple[str, ...] = ()
    dedupe_on_stopwords: bool = False
    analyzer: str | object = "unicode"  # a name, or an analysis.Analyzer
    vocab_limit: int | None = None  # prefix candidates of a suggestion; None: all
    k1: float = 1.2
    b: float = 0.75
