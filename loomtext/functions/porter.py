"""The Porter stemmer (M. F. Porter, 1980), as published; words of one or two letters stay as they are, case isn't changed."""

from __future__ import annotations

import functools


def _rules(text: str) -> tuple[tuple[str, str], ...]:
    """`ending>replacement` items; nothing after the arrow drops the ending."""
    return tuple((x, y) for x, _, y in (item.partition(">") for item in text.split()))


_STEP2 = _rules("abli>able aliti>al alism>al alli>al anci>ance ation>ate ational>ate ator>ate biliti>ble eli>e enci>ence entli>ent fulness>ful iveness>ive iviti>ive ization>ize izer>ize ousli>ous ousness>ous tional>tion")
_STEP3 = _rules("alize>al ative> ful> ical>ic icate>ic iciti>ic ness>")
_STEP4 = tuple("able al ance ant ate ate ement ence ent er ible ic ion ism iti ive ize ment ou ous".split())


def _shape(word: str) -> str:
    """A letter c or v for each letter of a word; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    s = _shape(word)
    return sum(s[i] == "v" and s[i + 1] == "c" for i in range(len(s) - 1))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, rules) -> str:
    """Replaces the longest matching ending, if what is before it has a measure above 0."""
    end = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if end and _measure(word[: -len(end[0])]) > 0:
        return word[: -len(end[0])] + end[1]
    return word


@functools.lru_cache(200_000)
def stem(word: str | None) -> str | None:
    if word is None or len(word) <= 2:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((n for e, n in (("ed", 2), ("ing", 3)) if w.endswith(e) and "v" in _shape(w[:-n])), 0)
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    end = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
