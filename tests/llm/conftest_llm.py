"""Small tables with everything an operator must survive."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h0 long, line long, leaf long, t int, items string, __id long, nll double, first string, size int, kept boolean, shard long"
_SYLLABLES = ["ba", "to", "ri", "mek", "sul", "an", "vo", "pel", "ku", "dra", "shi", "on"]


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    """n words in sentences of 8 to 14, two to four sentences a line."""
    left, lines = words(rng, n), []
    while left:
        line = []
        for _ in range(rng.randint(2, 4)):
            k = rng.randint(8, 14)
            sentence, left = left[:k], left[k:]
            if sentence:
                line.append(" ".join(sentence).capitalize() + ".")
        lines.append(" ".join(line))
    return "\n".join(lines)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text) if text is not None else None, 1, 2, 3, 4, 5, "x", 6, 0.5, "f", 7, True, 8)


@pytest.fixture(scope="session")
def frame(spark):
    """A function that makes a documents table of (doc_id, text[, lang[, source]]) rows, with clashing extra columns."""
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, null ids, languages and sources, ties, repeated rows, a very long text."""
    rng = random.Random(5)
    common = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(30, 200)), rng.choice(["en", "de"])) for i in range(60)]
    rows += [(100, common), (101, common), (102, common), (102, common), (103, common.upper())]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "!!! ???"), (204, "one"), (None, common), (None, None), (205, "a b", None), (206, common, "en", None)]
    rows += [(300, " ".join(words(rng, 150_000)))]
    return rows
