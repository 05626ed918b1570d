"""Porter's stemmer (1980) with the extensions common in text-metric libraries."""

from __future__ import annotations

from functools import lru_cache

# Suffix tables of steps 2, 3 and 4.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
# Whole words with a stem of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}


def _shape(word: str) -> str:
    """Consonants as ``c``, vowels as ``v``; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    shape = _shape(stem)
    return shape == "vc" or (shape.endswith("cvc") and stem[-1] not in "wxy")


def _replace(word: str, rules: list[tuple[str, str]], least: int) -> str:
    found = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if found:
        stem = word[: len(word) - len(found[0])]
        if _measure(stem) > least:
            return stem + found[1]
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    elif word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((len(s) for s in ("ed", "ing") if word.endswith(s)), 0)
        if cut and "v" in _shape(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"

    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"

    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    if word.endswith("logi"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        word = _replace(word, STEP_2, 0)
    word = _replace(word, STEP_3, 0)

    found = max((s for s in STEP_4 if word.endswith(s)), key=len, default=None)
    if found:
        base = word[: -len(found)]
        if _measure(base) > 1 and (found != "ion" or base.endswith(("s", "t"))):
            word = base

    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
