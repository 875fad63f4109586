"""Pages of results kept on the driver: at most a page of rows a query, under the query and the index's version."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame

from quern.operators.search import Search


class ResultCache:
    """Pages by query, models, place, mode, conditions and index version, for ``ttl`` seconds; the least used go first.

    A new version of an index is a new key, so that a change is seen at once; indexes that aren't written have no
    version and are not cached.
    """

    def __init__(self, ttl: float = 300, size: int = 1000):
        self.ttl, self.size, self.hits = ttl, size, 0
        self._kept: OrderedDict[tuple, tuple[float, list, object]] = OrderedDict()

    @staticmethod
    def key(search: Search) -> tuple | None:
        chosen = [(i.tenant, i.spec.model, i.version) for i in search._chosen()]
        if any(version is None for _, _, version in chosen):
            return None
        conditions = [str(c._jc) for c in search.filters] + [str(search.allowed._jc if search.allowed is not None else None)]
        return (search.text, search.mode_name, search.rows, search.skip, search.boosted, search.fall_back, search.scorer_name, id(search.acl), repr(search.config), *conditions, *chosen)

    def page(self, search: Search) -> DataFrame:
        """The page of a search (model, doc_id, rank, title)."""
        key = self.key(search)
        if key is None:
            return search.page()
        held = self._kept.get(key)
        if held and time.monotonic() - held[0] < self.ttl:
            self.hits += 1
            self._kept.move_to_end(key)
        else:
            page = search.page()
            held = self._kept[key] = (time.monotonic(), page.collect(), page.schema)
            while len(self._kept) > self.size:
                self._kept.popitem(last=False)
        return search.indexes[0].rows.sparkSession.createDataFrame(held[1], held[2])

    def forget(self, model: str | None = None) -> None:
        """Drops all pages, or those of a model."""
        for key in [k for k in self._kept if model is None or any(isinstance(x, tuple) and x[1:2] == (model,) for x in k)]:
            del self._kept[key]
