"""Parsed queries as Column expressions over an index's rows.

Token arrays are stored in the index, so nothing is tokenised at query time.  A cheap test for the term anywhere in
the bucket's text, which stays in generated code, comes before the array functions in each conjunction.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.plans.parser import ParsedQuery, Term
from quern.spec import Config


def buckets(config: Config) -> range:
    return range(1, config.max_weight + 1)


def tok(w: int) -> Column:
    return F.col(f"tok_w{w}")


def text(w: int) -> Column:
    return F.col(f"text_w{w}")


def all_tokens(config: Config) -> Column:
    """The tokens of all buckets, an empty one between buckets so that nothing runs over their edges."""
    parts = []
    for w in buckets(config):
        parts += [tok(w), F.array(F.lit(""))]
    return F.concat(*parts[:-1])


def term_in(tokens: Column, term: Term) -> Column:
    """A single token: some token begins with it; several: they follow one another."""
    if len(term.tokens) > 1 or term.phrase:
        return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f" {term.text} "))
    return F.exists(tokens, lambda t: F.startswith(t, F.lit(term.tokens[0])))


def term_matches(term: Term, config: Config, columns: dict[str, Column] | None = None) -> Column:
    if term.column is not None and columns and term.column in columns:
        return term_in(columns[term.column], term)
    tests = [F.contains(text(w), F.lit(term.tokens[0])) & term_in(tok(w), term) for w in buckets(config)]
    return reduce(or_, tests)


def near_matches(pair: tuple[str, str], distance: int, config: Config) -> Column:
    """Some token with a and some token with b at most ``distance`` places apart in one bucket."""
    a, b = pair

    def places(tokens: Column, word: str) -> Column:
        at = F.transform(tokens, lambda t, i: F.when(F.contains(t, F.lit(word)), i))
        return F.filter(at, lambda i: i.isNotNull())

    def within(w: int) -> Column:
        other = places(tok(w), b)
        close = F.exists(places(tok(w), a), lambda i: F.exists(other, lambda j: F.abs(i - j) <= distance))
        return F.contains(text(w), F.lit(a)) & F.contains(text(w), F.lit(b)) & close

    return reduce(or_, [within(w) for w in buckets(config)])


def matches(query: ParsedQuery, config: Config, columns: dict[str, Column] | None = None) -> Column:
    """Whether a row matches: excluded terms reject; without OR all terms, with OR any of them; all NEAR pairs."""
    if query.empty:
        return F.lit(False)
    test = lambda t: term_matches(t, config, columns)
    found = reduce(or_, [test(t) for t in query.positive]) if query.should else reduce(and_, [test(t) for t in query.must])
    for t in query.exclude:
        found = found & ~test(t)
    for pair in query.near:
        found = found & near_matches(pair, query.near_distance, config)
    return found


def occurrences(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(word)))


def bm25_field(tf: list[Column], idf: list[Column | float], dl: Column, avgdl: Column | float, config: Config) -> Column:
    """BM25 of one field, terms added in their order."""
    k1, b = config.k1, config.b
    avgdl = avgdl if isinstance(avgdl, Column) else F.lit(float(avgdl))
    norm = k1 * (1 - b + b * dl / avgdl)
    parts = [F.when(f > 0, (i if isinstance(i, Column) else F.lit(float(i))) * (f * (k1 + 1)) / (f + norm)).otherwise(0.0) for f, i in zip(tf, idf, strict=True)]
    return reduce(add, parts, F.lit(0.0))


def idf(df: Column, docs: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def normalized(raw: Column, docs: Column, config: Config) -> Column:
    """A raw score on the scale 0 to 100, one decimal."""
    top = F.log(1 + (docs + 0.5) / 0.5) * (config.k1 + 1) * config.max_weight
    return F.least(F.round(raw / top * 100, 1), F.lit(100.0))


def weighted(fields: dict[int, Column], present: dict[int, Column] | None = None) -> Column:
    """The mean of the fields' scores by weight, over the buckets that aren't empty."""
    present = present or {w: text(w) != "" for w in fields}
    total = reduce(add, [F.when(present[w], w * s).otherwise(0.0) for w, s in fields.items()])
    weight = reduce(add, [F.when(present[w], w).otherwise(0) for w in fields])
    return F.when(weight > 0, total / weight).otherwise(0.0)


def starting(word: str):
    return lambda t: F.startswith(t, F.lit(word))


def quick_of(counts: list[tuple[Column, Column]]) -> Column:
    """The quick score of words by (occurrences, tokens that begin with the word)."""
    parts = [F.when(exact > 0, exact.cast("double")).otherwise(F.least(begins * 0.1, F.lit(1.0))) for exact, begins in counts]
    return reduce(add, parts, F.lit(0.0))


def quick(words: list[str], config: Config) -> Column:
    """Occurrences of each word; where there are none, a tenth for each token it begins, 1 at most."""
    tokens = all_tokens(config)
    return quick_of([(occurrences(tokens, w), F.size(F.filter(tokens, starting(w)))) for w in words])


def rank_of(fields: dict[int, list[Column]], lengths: dict[int, Column], present: dict[int, Column], words: list[str], score: Column, df: dict[str, int], docs: int, avgdl: float, config: Config) -> Column:
    """Weighted BM25 on 0 to 100 from the words' frequencies by bucket, or ``score`` where BM25 has nothing."""
    n = F.lit(float(docs))
    weights = [idf(F.lit(float(df.get(t, 0))), n) for t in words]
    raw = weighted({w: bm25_field(tf, weights, lengths[w], float(avgdl or 1.0), config) for w, tf in fields.items()}, present)
    return F.when(raw > 0, normalized(raw, n, config)).otherwise(F.round(score, 4))


def rank(query: ParsedQuery, df: dict[str, int], docs: int, avgdl: float, config: Config) -> Column:
    """The rank of index rows."""
    words = query.words()
    fields = {w: [occurrences(tok(w), t) for t in words] for w in buckets(config)}
    lengths = {w: F.size(F.filter(tok(w), lambda t: t != "")) for w in buckets(config)}
    return rank_of(fields, lengths, {w: text(w) != "" for w in buckets(config)}, words, quick([t.text for t in query.positive], config), df, docs, avgdl, config)
