"""Stop-words by locale: short lists of function words, extensible by files of one word a line."""

from __future__ import annotations

from pathlib import Path

OPERATORS = frozenset({"and", "or", "not", "near"})
_LISTS: dict[str, frozenset[str]] = {
    "en": frozenset("the of to in is was it for on with as at by from this that be are were has had his her they you we he she an a but which their its will would there been if no so what when who".split()),
    "fr": frozenset("le la les un une des du de et à au aux en dans sur pour par avec ce cette ces qui que ne pas est sont il elle nous vous ils son sa ses leur plus".split()),
    "de": frozenset("der die das den dem des ein eine einen einem einer und in im von zu mit auf für ist sich nicht als auch es an werden aus er hat dass sie nach bei um".split()),
    "es": frozenset("el la los las un una unos de del y a en que por con para se no es su sus al lo como más pero le ya o este sí porque esta son".split()),
    "pt": frozenset("o a os as um uma de do da dos das e em no na que para com por se não é mais como mas ao ele ela seu sua ou".split()),
    "ru": frozenset("и в не на я что он с как это по но они мы из у за от же вы так его к для".split()),
    "ar": frozenset("في من على إلى عن مع هذا هذه التي الذي كان ما لا أن إن هو هي ثم أو كل".split()),
    "zh": frozenset("的 了 是 在 我 有 和 就 不 人 都 一 也 很 到 说 要 去 你 会".split()),
}
_NAMES = {"english": "en", "french": "fr", "german": "de", "spanish": "es", "portuguese": "pt", "russian": "ru", "arabic": "ar", "chinese": "zh"}


def code(locale: str) -> str:
    """``fr_CA``, ``fr-FR``, ``French`` and ``fr`` are all ``fr``."""
    name = locale.strip().lower()
    return _NAMES.get(name, name.replace("_", "-").split("-")[0])


def register(locale: str, words: set[str]) -> None:
    _LISTS[code(locale)] = frozenset(w.lower() for w in words)


def read(path: str) -> set[str]:
    """Words of a file, one a line; lines that begin with # are comments."""
    lines = Path(path).read_text("utf-8").splitlines()
    return {w.strip().lower() for w in lines if w.strip() and not w.startswith("#")}


def of(locales: tuple[str, ...]) -> set[str]:
    """All stop-words of the locales; unknown locales have none; operator words are never stop-words."""
    found: set[str] = set()
    for locale in locales:
        found |= _LISTS.get(code(locale), frozenset())
    return found - OPERATORS
