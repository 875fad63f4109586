"""Stemming by locale: Porter's algorithm for English, other locales unchanged."""

from __future__ import annotations

import re

_V = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def known(locale: str) -> bool:
    return locale.lower()[:2] == "en"


_KINDS = str.maketrans({c: "v" if c in "aeiou" else "c" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _measure(s: str) -> int:
    """How often consonants follow vowels."""
    if "y" in s:
        kinds = "".join("v" if c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") else "c" for i, c in enumerate(s))
    else:
        kinds = s.translate(_KINDS)
    return kinds.count("vc")


def _short(s: str) -> bool:
    return bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", s))


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(":")) for r in text.split()), key=lambda r: -len(r[0]))


_STEP2, _STEP3 = _rules(_STEP2), _rules(_STEP3)


def english(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and _V.search(w[: -len(s)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and _V.search(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for suffix, new in rules:
            if w.endswith(suffix):
                w = w[: -len(suffix)] + new if _measure(w[: -len(suffix)]) > 0 else w
                break
    for suffix in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_text(text: str, locale: str) -> str:
    return " ".join(english(w) for w in text.split(" ")) if known(locale) else text
