"""Text analysis of whole Arrow batches, by the rules of quern.functions.analysis.

Of most texts nothing but runs of non-ASCII characters needs a look at Unicode's tables, and runs repeat; the rest is
done on bytes, and tokens are cut for all texts of a batch at once.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from quern.functions import arabic, stem

#: Scripts whose characters are tokens by themselves, as a character class body (Java, Python).
PER_CHARACTER = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1100, 0x11FF), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2EBEF), (0x30000, 0x323AF),
]
SEPARATED = [(0x1100, 0x11FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF)]
PYTHON_CLASS = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in PER_CHARACTER)
PY_SEPARATED = re.compile("([" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SEPARATED) + "])(?=[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SEPARATED) + "])")
LONGEST = 32
SCRIPTS = (
    "Latin Cyrillic Greek Arabic Hebrew Han Hiragana Katakana Hangul Thai Lao Khmer Myanmar Devanagari Bengali Tamil Telugu Kannada "
    "Malayalam Gujarati Gurmukhi Oriya Sinhala Georgian Armenian Ethiopic Tibetan Mongolian Cherokee Thaana"
).split()


def _fold_char(c: str) -> str:
    kept = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
    return unicodedata.normalize("NFC", kept)


#: Characters that fold to one letter, and ligatures that fold to several.
SINGLE, LIGATURES = {}, {}
for _cp in [*range(0xA0, 0xAC00), *range(0xF900, 0xFFFF)]:
    _c = chr(_cp)
    if unicodedata.category(_c) not in ("Mn", "Cn", "Co", "Cs"):
        _f = _fold_char(_c)
        if _f != _c and len(_f) == 1:
            SINGLE[_c] = _f
        elif len(_f) > 1 and unicodedata.category(_c)[0] == "L" and (0xFB00 <= _cp <= 0xFB06 or _c in "ĲĳŉǄǅǆǇǈǉǊǋǌǱǲǳ"):
            LIGATURES[_c] = _f

_FOLDS = {ord(c): f for c, f in (SINGLE | LIGATURES).items()}
_RUN = re.compile("([^\x00-\x7f]+)")
_TAG = re.compile("<[^>]*>")
_SHORT = re.compile(f"[{PYTHON_CLASS}]")
_ARABIC = regex.compile(r"\p{Arabic}")
#: Longer runs (lines of a script without spaces) hardly repeat.
_CACHED_RUN, _CACHED = 24, 1 << 15
#: Bytes that are no ASCII letter or digit become spaces, letters lower case; bytes of other characters stay.
_WORD_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


# --- one text ----------------------------------------------------------------------------------------------------


def has_arabic(text: str) -> bool:
    return not text.isascii() and bool(_ARABIC.search("".join(_RUN.findall(text))))


def stem_arabic(text: str) -> str:
    return " ".join(map(_arabic_stem, text.split())) if has_arabic(text) else text


_arabic_stem = lru_cache(_CACHED)(arabic.stem_word)


def _fold(run: str) -> tuple[str, bool]:
    """A run of non-ASCII characters with accents folded and per-character scripts separated; whether it has Arabic."""
    kept = "".join(f for c in run if (f := _FOLDS.get(ord(c), c)) and unicodedata.category(f[0]) != "Mn")
    return PY_SEPARATED.sub(r"\1 ", kept), bool(_ARABIC.search(kept))


def _words_of(run: str) -> tuple[str, bool]:
    """A run with spaces for what is no letter or digit; whether it has characters that are tokens by themselves."""
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in run), bool(_SHORT.search(run))


_fold_cached, _words_cached = lru_cache(_CACHED)(_fold), lru_cache(_CACHED)(_words_of)


def _cut(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else word.decode()[:LONGEST].encode()


#: What becomes of the characters of Latin-1 but one, whose fold is beyond it.
_BEYOND = b"\xb5"
_LATIN = bytes(ord(_FOLDS.get(b, chr(b)).lower()) if b != _BEYOND[0] else b for b in range(256))
_SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


@lru_cache(_CACHED)
def _alone(c: str) -> str | None:
    """What becomes of a character wherever it is; None if that depends on those beside it."""
    fold, has = _fold(c)
    return None if has or PY_SEPARATED.search(c + c) or PY_SEPARATED.search(fold + fold) else fold


def _folded(text: str) -> str:
    """A text that isn't ASCII, folded and separated, and stemmed if it has Arabic letters."""
    odd = [c for c in set(text) if c > "\x7f"]
    folds = list(map(_alone, odd))
    if None not in folds:  # a fold is no other's character
        for c, f in zip(odd, folds, strict=True):
            if c != f:
                text = text.replace(c, f)
        return text
    parts = _RUN.split(text)
    for i in range(1, len(parts), 2):
        parts[i] = (_fold_cached if len(parts[i]) <= _CACHED_RUN else _fold)(parts[i])[0]
    return stem_arabic("".join(parts))


def _lowered(text: str) -> bytes:
    """A text without tags, folded, in lower case."""
    if "<" in text:
        text = _TAG.sub("", text)
    if text.isascii():
        return text.lower().encode()
    try:
        raw = text.encode("latin-1")
        if _BEYOND not in raw:
            return raw.translate(_LATIN).decode("latin-1").encode()
    except UnicodeEncodeError:
        pass
    return _folded(text).lower().encode()


def analyzed(texts: list[str | None]) -> list[bytes]:
    """Texts as the analyser ``unicode`` indexes them; null is the empty text."""
    rows = []
    for text in texts:
        row = _lowered(text or "").translate(_SPACES)
        while b"  " in row:
            row = row.replace(b"  ", b" ")
        rows.append(row.strip(b" "))
    ends = np.cumsum([len(r) + 1 for r in rows], dtype=np.int64)
    spaces = np.flatnonzero(np.frombuffer(b" ".join([*rows, b""]), np.uint8) == 32)
    for k in np.unique(np.searchsorted(ends, spaces[np.diff(spaces, prepend=-1) > LONGEST + 1])):
        rows[k] = b" ".join(map(_cut, rows[k].split(b" ")))
    return rows


def _spaced(text: bytes) -> tuple[bytes, int]:
    """A text with spaces for what is no letter or digit, in lower case, and the least length of its tokens."""
    if text.isascii():
        return text.translate(_WORD_BYTES), 2
    parts, least = _RUN.split(text.decode().lower()), 2
    for i in range(1, len(parts), 2):
        parts[i], short = (_words_cached if len(parts[i]) <= _CACHED_RUN else _words_of)(parts[i])
        if short:
            least = 1
    return "".join(parts).encode().translate(_WORD_BYTES), least


@lru_cache(1 << 17)
def _stemmed(word: bytes) -> bytes:
    return stem.english(word.decode()).encode()


@lru_cache(_CACHED)
def _scripts_of(c: str) -> int:
    return next((1 << k for k, s in enumerate(SCRIPTS) if regex.match(rf"\p{{{s}}}", c)), 0)


_LETTER = re.compile("[A-Za-z]")


def _scripts(text: str) -> list[str]:
    found = int(bool(_LETTER.search(text)))  # the first script is Latin
    if not text.isascii():
        for c in set("".join(_RUN.findall(text))):
            found |= _scripts_of(c)
    return [s for k, s in enumerate(SCRIPTS) if found >> k & 1] or ["Common"]


def trigrams_of(word: str) -> list[str]:
    padded = f"#{word}#"
    return list(dict.fromkeys(padded[i : i + 3] for i in range(max(1, len(padded) - 2))))


# --- a batch of texts --------------------------------------------------------------------------------------------


def _strings(rows: list[bytes]) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch of texts is over 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(rows)))


def _tokens(rows: list[bytes]) -> pa.ListArray:
    """The tokens of each text."""
    spaced = [_spaced(r) for r in rows]
    begins = np.ones(len(rows) + 1, np.int64)
    np.cumsum([len(s) + 1 for s, _ in spaced], out=begins[1:])
    begins[1:] += 1
    data = np.frombuffer(b" ".join([b"", *[s for s, _ in spaced], b""]), np.uint8)
    word = data != 32
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    of = np.searchsorted(starts, begins)  # the first token of each text
    least = np.repeat(np.array([n for _, n in spaced], np.int64), np.diff(of))
    lead = data[starts]
    kept = (least == 1) | (ends - starts > 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0))  # longer than its first character
    gone, sizes = starts[~kept], (ends - starts)[~kept]
    for k in range(int(sizes.max(initial=0))):
        word[gone[sizes > k] + k] = False
    offsets = np.zeros(int(kept.sum()) + 1, np.int32)
    np.cumsum((ends - starts)[kept], out=offsets[1:])
    values = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[word]))
    before = np.zeros(len(kept) + 1, np.int32)
    np.cumsum(kept, out=before[1:])
    return pa.ListArray.from_arrays(pa.array(before[of], pa.int32()), values)


def _nulls(made: pa.Array, like: pa.Array) -> pa.Array:
    return pc.if_else(like.is_valid(), made, pa.scalar(None, made.type)) if like.null_count else made


def texts(a: pa.Array) -> pa.Array:
    """Texts as they are indexed; null is the empty text."""
    return _strings(analyzed(a.to_pylist()))


def tokens(a: pa.Array) -> pa.Array:
    """Tokens of analysed texts."""
    return _nulls(_tokens([(t or "").encode() for t in a.to_pylist()]), a)


def texts_and_tokens(a: pa.Array) -> pa.Array:
    """Both, in one pass."""
    rows = analyzed(a.to_pylist())
    return pa.StructArray.from_arrays([_strings(rows), _tokens(rows)], ["text", "tok"])


def nfc(a: pa.Array) -> pa.Array:
    """Texts with letters and their marks composed; a batch of texts that are so already is handed on."""
    rows = [t or "" for t in a.to_pylist()]
    if all(unicodedata.is_normalized("NFC", t) for t in rows):
        return a
    return _nulls(_strings([unicodedata.normalize("NFC", t).encode() for t in rows]), a)


def stems(a: pa.Array) -> pa.Array:
    """English stems of analysed texts."""
    return _nulls(_strings([b" ".join(map(_stemmed, (t or "").encode().split(b" "))) for t in a.to_pylist()]), a)


def arabic_stems(a: pa.Array) -> pa.Array:
    return _nulls(_strings([" ".join(map(_arabic_stem, t.split()) if has_arabic(t) else t.split()).encode() for t in (t or "" for t in a.to_pylist())]), a)


def arabic_stems_if_any(a: pa.Array) -> pa.Array:
    return _nulls(_strings([stem_arabic(t or "").encode() for t in a.to_pylist()]), a)


def scripts(a: pa.Array) -> pa.Array:
    """Names of the scripts in texts; Common if there is none."""
    return pa.array([_scripts(t or "") for t in a.to_pylist()], pa.list_(pa.string()))


def trigrams(a: pa.Array) -> pa.Array:
    """Distinct trigrams of each word between number signs."""
    return pa.array([None if t is None else trigrams_of(t) for t in a.to_pylist()], pa.list_(pa.string()))
