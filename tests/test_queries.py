"""Every registered query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from quern import catalogue
from quern.functions import arabic, stem

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{round(float(value), 6):.6f}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, str(DATA))
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows(columns, cursor.fetchall()) == rows(found.columns, [tuple(r) for r in found.collect()])


def brute_arabic(text):
    """Vowel marks off, letter forms unified, one prefix, then suffixes while more than two letters stay; doubled letters once."""
    out = []
    for word in text.split():
        if any("\u0600" <= c <= "\u06ff" for c in word):
            word = "".join({"\u0629": "\u0647", "\u0649": "\u064a"}.get(c, "\u0627" if c in "\u0625\u0622\u0626\u0624\u0621" else c) for c in word if not "\u064b" <= c <= "\u0652")
            for n in (3, 2):
                if word[:n] in arabic._PREFIXES and len(word) > n + 2:
                    word = word[n:]
                    break
            while len(word) > 3 and (n := next((n for n in (3, 2, 1) if word[-n:] in arabic._SUFFIXES and len(word) > n + 2), 0)):
                word = word[:-n]
            word = "".join(c for i, c in enumerate(word) if not i or c != word[i - 1] or not "\u0600" <= c <= "\u06ff")
        out.append(word)
    return " ".join(out)


def test_arabic_stems(spark):
    found = catalogue.queries()["txt_arabic_stem"](spark, str(DATA)).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(found) == len(docs) and all(r["text"] == brute_arabic(docs[r["doc_id"]]) for r in found)
    words = ["\u0627\u0644\u0643\u062a\u0627\u0628", "\u0648\u0627\u0644\u0645\u0643\u062a\u0628\u0627\u062a", "\u0643\u062a\u0627\u0628\u0647\u0645", "\u0645\u064f\u062f\u064e\u0631\u0651\u0633\u0629", "\u0645\u0645"]
    assert [arabic.stem_text(w) for w in words] == [brute_arabic(w) for w in words]
    assert arabic.stem_text(words[0]) == "\u0643\u062a\u0627\u0628"


def test_stemming(spark):
    known = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss failing:fail filing:file happy:happi sky:sky relational:relat rational:ration digitizer:digit operator:oper feudalism:feudal hopefulness:hope formality:formal electrical:electr adjustment:adjust adoption:adopt effective:effect controller:control roll:roll"
    for pair in known.split():
        word, want = pair.split(":")
        assert stem.english(word) == want, word
    plain = {r["doc_id"]: r["text"] for r in catalogue.queries()["txt_analyze"](spark, str(DATA)).collect()}
    found = catalogue.queries()["txt_stemming"](spark, str(DATA)).collect()
    assert len(found) == len(plain) and all(r["text"] == " ".join(stem.english(w) for w in plain[r["doc_id"]].split(" ")) for r in found)
