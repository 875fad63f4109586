"""Text analysis in two hosts: Columns for documents (expressions, or Arrow batches: texts.py), Python for queries.

Both follow one order: tags out, accents folded, per-character scripts separated, (Arabic stemmed,) lower case,
stop-words out (documents only), long tokens cut, white space squeezed.  Punctuation stays until tokens are taken.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import stem, stopwords, texts
from quern.functions.texts import LIGATURES, LONGEST, PER_CHARACTER, PY_SEPARATED, PYTHON_CLASS, SCRIPTS, SEPARATED, SINGLE

JAVA_CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in PER_CHARACTER)
_JAVA_SEPARATED = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SEPARATED)
_FROM, _TO = "".join(SINGLE), "".join(SINGLE.values())


# --- documents: Column -> Column ---------------------------------------------------------------------------------


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def fold_accents(c: Column) -> Column:
    """Compatibility forms and letters with marks become base letters; JVM only (multi-letter forms: ligatures)."""
    c = F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}+", "")
    ligature = F.lit("[" + "".join(LIGATURES) + "]")
    spelled = c
    for one, several in LIGATURES.items():
        spelled = F.replace(spelled, F.lit(one), F.lit(several))
    return F.when(F.regexp_like(c, ligature), spelled).otherwise(c)


@F.pandas_udf(T.StringType())
def fold_accents_exact(s: pd.Series) -> pd.Series:
    """The same by the full Unicode tables, for text beyond the scripts that fold_accents has tables for."""
    return s.map(fold_py, na_action="ignore")


nfc = F.arrow_udf(texts.nfc, T.StringType())


def separate_cjk(c: Column) -> Column:
    return F.regexp_replace(c, f"([{_JAVA_SEPARATED}])(?=[{_JAVA_SEPARATED}])", "$1 ")


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def truncate_tokens(c: Column, longest: int = LONGEST) -> Column:
    return F.regexp_replace(c, rf"(\S{{{longest}}})\S+", "$1")


def remove_stopwords(c: Column, locales: tuple[str, ...], dedupe: bool = False) -> Column:
    """Space-delimited words that are stop-words of a locale go; operator words always stay.

    ``dedupe`` also drops repeated words, keeping the first.
    """
    stop = F.array(*[F.lit(w) for w in sorted(stopwords.of(locales))])
    words = F.split(c, " ")
    return F.array_join(F.array_except(words, stop) if dedupe else F.filter(words, lambda w: ~F.array_contains(stop, w)), " ")


arabic_stems = F.arrow_udf(texts.arabic_stems, T.StringType())
_arabic_stems_if_any = F.arrow_udf(texts.arabic_stems_if_any, T.StringType())
_texts = F.arrow_udf(texts.texts, T.StringType())
_tokens = F.arrow_udf(texts.tokens, T.ArrayType(T.StringType()))
_texts_and_tokens = F.arrow_udf(texts.texts_and_tokens, T.StructType().add("text", T.StringType()).add("tok", T.ArrayType(T.StringType())))
_stems = F.arrow_udf(texts.stems, T.StringType())
_scripts = F.arrow_udf(texts.scripts, T.ArrayType(T.StringType()))
_trigrams = F.arrow_udf(texts.trigrams, T.ArrayType(T.StringType()))


def analyze(c: Column, analyzer: str = "unicode", locales: tuple[str, ...] = (), dedupe: bool = False, locale: str = "en") -> Column:
    """A text as it is indexed.

    analyzer: ``unicode``, ``fallback`` (transliterated to ASCII, no Arabic), ``stemming`` or ``identity``.
    Texts with Arabic letters are stemmed row by row, as queries are.
    """
    if analyzer == "identity":
        return c
    c = F.coalesce(c.cast("string"), F.lit(""))
    if analyzer != "fallback" and not locales:
        c = _texts(c)
    else:
        c = strip_html(c)
        plain = F.octet_length(c) == F.char_length(c)  # ASCII has nothing to fold or to separate
        c = F.when(plain, c).otherwise(separate_cjk(fold_accents(c)))
        c = F.lower(transliterate(c) if analyzer == "fallback" else _arabic_stems_if_any(c))
        if locales:
            c = remove_stopwords(squish(c), locales, dedupe)
        c = squish(truncate_tokens(c))
    return _stems(c) if analyzer == "stemming" and stem.known(locale) else c


@dataclass(frozen=True)
class Analyzer:
    """An analyser of one's own: what is done to documents, and the same for queries; the result is lower-cased."""

    name: str
    column: Callable[[Column], Column] = field(compare=False)
    text: Callable[[str], str] = field(compare=False)


def analyzed(c: Column, analyzer: str | Analyzer = "unicode", locales: tuple[str, ...] = (), dedupe: bool = False, locale: str = "en") -> Column:
    """A text by a named analyser or one's own."""
    if isinstance(analyzer, Analyzer):
        return F.lower(analyzer.column(F.coalesce(c.cast("string"), F.lit(""))))
    return analyze(c, analyzer, locales, dedupe, locale)


def analyzed_py(text: str, analyzer: str | Analyzer = "unicode", locale: str = "en") -> str:
    return analyzer.text(text).lower() if isinstance(analyzer, Analyzer) else analyze_py(text, analyzer, locale)


def tokens(c: Column) -> Column:
    """Letter and digit runs of at least 2 characters, of any length in text with a per-character script."""
    return _tokens(c.cast("string"))


def with_tokens(c: Column) -> Column:
    """A struct of a text as ``unicode`` indexes it and its tokens: analyze and tokens in one pass."""
    return _texts_and_tokens(c.cast("string"))


def word_difference(old: Column, new: Column) -> Column:
    """The words of a text that aren't in another, each once; both analysed."""
    return F.array_except(tokens(new), tokens(old))


def vocabulary_tokens(c: Column) -> Column:
    """Distinct space-delimited words without the punctuation around them."""
    bare = F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a word between number signs."""
    return _trigrams(c.cast("string"))


def scripts(c: Column) -> Column:
    """Names of the scripts in a text; Common if there is none."""
    return _scripts(c.cast("string"))


_ASCII = {**dict(zip("абвгдезийклмнопрстуфхыэ", "abvgdezijklmnoprstufhye", strict=True)), "ё": "e", "ж": "zh", "ц": "c", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}
_ASCII |= {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i"}
_ASCII |= dict(zip("αβγδεζηικλμνοπρστυφωςξ", "avgdeziiklmnoprstyfosx", strict=True)) | {"θ": "th", "χ": "ch", "ψ": "ps"}
_ASCII_ONE = {a: b for a, b in _ASCII.items() if len(b) == 1}
_ASCII_MANY = {a: b for a, b in _ASCII.items() if len(b) != 1}


def transliterate(c: Column) -> Column:
    """Latin, Greek and Cyrillic letters spelled in ASCII, lower-cased."""
    out = F.translate(F.lower(fold_accents(c)), "".join(_ASCII_ONE), "".join(_ASCII_ONE.values()))
    for one, several in _ASCII_MANY.items():
        out = F.replace(out, F.lit(one), F.lit(several))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(out)


def contains_folded(a: Column, b: Column) -> Column:
    return F.contains(fold_accents(a), fold_accents(b))


def similar(a: Column, b: Column) -> Column:
    """b is in a, or they are within a third of b's length (1 at least) of each other, accents aside."""
    x, y = fold_accents(a), fold_accents(b)
    limit = F.when(y == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(y) / 3)))
    return F.contains(x, y) | (F.levenshtein(x, y) <= limit)


# --- queries: str -> str -----------------------------------------------------------------------------------------


def fold_py(text: str) -> str:
    kept = "".join(x for x in unicodedata.normalize("NFKD", text) if unicodedata.category(x) != "Mn")
    return unicodedata.normalize("NFC", kept)


def transliterate_py(text: str) -> str:
    return "".join(_ASCII.get(c, c) for c in fold_py(text).lower())


def analyze_py(text: str, analyzer: str = "unicode", locale: str = "en") -> str:
    """A query as documents are analysed, but without stop-words."""
    if analyzer == "identity":
        return text
    text = PY_SEPARATED.sub(r"\1 ", fold_py(re.sub("<[^>]*>", "", text)))
    if analyzer == "fallback":
        text = transliterate_py(text)
    else:
        text = texts.stem_arabic(text)
    text = re.sub(rf"(\S{{{LONGEST}}})\S+", r"\1", text.lower())
    text = re.sub(r"\s+", " ", text).strip()
    return stem.stem_text(text, locale) if analyzer == "stemming" else text


def tokens_py(text: str) -> list[str]:
    least = 1 if re.search(f"[{PYTHON_CLASS}]", text) else 2
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if len(t) >= least]


def scripts_py(text: str) -> list[str]:
    return [s for s in SCRIPTS if regex.search(rf"\p{{{s}}}", text)] or ["Common"]


trigrams_py = texts.trigrams_of
