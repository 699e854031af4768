"""The Porter stemming algorithm (M. F. Porter, 1980), from its published rules."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = frozenset("aeiou")

#: Suffix tables of the published algorithm (fixed values).
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """``v`` or ``c`` for each letter; y is a vowel after a consonant."""
    out: list[str] = []
    for c in word:
        out.append("v" if c in _VOWELS or c == "y" and out and out[-1] == "c" else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    """Number of vowel runs that a consonant run follows."""
    return sum(a == "v" and b == "c" for a, b in zip(_shape(stem), _shape(stem)[1:], strict=False))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _swap(word: str, table: dict[str, str]) -> str:
    for suffix in sorted((s for s in table if word.endswith(s)), key=len, reverse=True)[:1]:
        stem = word[: -len(suffix)]
        return stem + table[suffix] if _measure(stem) > 0 else word
    return word


def _tidy(stem: str) -> str:
    """After -ed or -ing went."""
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


@lru_cache(maxsize=100_000)
def stemmed(word: str) -> str:
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if "v" in _shape(word[: -len(suffix)]):
                    word = _tidy(word[: -len(suffix)])
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    found = sorted((s for s in _STEP4 if word.endswith(s)), key=len, reverse=True)
    if found:
        stem = word[: -len(found[0])]
        if _measure(stem) > 1 and (found[0] != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short_end(stem):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
