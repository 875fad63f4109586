"""Snippets: a window around the earliest hit, hits marked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, BEFORE, LEAST = 120, 60, 50


def _quoted(term: str) -> str:
    return "(?iu)" + "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in term)


def marked(text: Column, terms: list[str], left: str = "<mark>", right: str = "</mark>") -> Column:
    """The text with each term marked, in any case."""
    for term in terms:
        if term.strip():
            text = F.regexp_replace(text, _quoted(term), f"{left}$0{right}")
    return text


def snippet(columns: list[Column], terms: list[str]) -> Column:
    """Of the columns of more than 50 bytes, the one with the earliest hit, else the first: 120 characters of it.

    Null if no column is long enough.
    """
    plain = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "<[^>]*>", "") for c in columns]
    long = [F.octet_length(F.coalesce(c.cast("string"), F.lit(""))) > LEAST for c in columns]
    spots = []
    for k, (p, ok) in enumerate(zip(plain, long, strict=True)):
        for term in terms:
            at = F.instr(F.lower(p), F.lit(term.lower()))
            spots.append(F.when(ok & (at > 0), F.struct((at - 1).alias("at"), F.lit(k).alias("k"))))
        spots.append(F.when(ok, F.struct(F.lit(2**30).alias("at"), F.lit(k).alias("k"))))
    best = F.array_min(F.filter(F.array(*spots), lambda s: s.isNotNull()))
    text = reduce(lambda rest, k: F.when(best["k"] == k, plain[k]).otherwise(rest), range(len(plain) - 1, -1, -1), F.lit(None).cast("string"))
    at = F.when(best["at"] == 2**30, 0).otherwise(best["at"])
    start = F.greatest(F.lit(0), at - BEFORE)
    window = F.substring(text, start + 1, F.lit(WINDOW))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), window, F.when(start + WINDOW < F.length(text), "…").otherwise(""))
    return F.when(text.isNotNull(), marked(cut, terms))
