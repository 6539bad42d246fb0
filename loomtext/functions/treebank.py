"""Treebank tokens of a text: entities written out, one scan into pieces, and what each piece becomes in its surroundings.

Brackets become -LRB- and -RRB-; clitics split off, and the verb before n't takes its full form (will n't); a hyphen, slash or
colon between two words becomes @-@ and so on, an @ standing on each side where the mark touched a word; a quotation mark that
touches one word has an @ on that side; numbers keep their points and commas, links stay whole; a full stop splits off unless it
belongs to an initial, an acronym or a short title.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

LANGUAGES = ("eng", "fra", "kin", "mlg")
_TITLES = "Adm Ave Bp Capt Cmdr Col Cpl Dr Ed Esq Gen Gov Hon Jr Lt Maj Messrs Mgr Mr Mrs Ms Mt Pres Prof Rep Rev Sen Sgt Sr St Ste vs".split()
_UNITS = "cm g ha kg km kwh m mg mm".split()
_SCAN = re.compile(
    rf"""(?P<link>(?:https?://|www\.)\S*[^\s.,;:!?'")\]])
    | (?P<short>(?:\b(?:{"|".join(_TITLES)})|\b(?:[^\W\d_]\.)+[^\W\d_]|\b[A-Z])\.(?=\s|$))
    | (?P<number>\d+(?:[.,]\d+)*(?=(?:{"|".join(_UNITS)})\b|\W|$))
    | (?P<word>[^\W_]+(?:['’][^\W_]+)*)
    | (?P<stops>[?!][?!.]*|\.+)
    | (?P<other>\S)""",
    re.VERBOSE,
)
#: Clitics after an apostrophe, and what a verb becomes before n't.
_CLITICS = frozenset("s m d ll ve re".split())
_FULL = {"wo": "will", "ca": "can", "sha": "shall", "ai": "is"}
_BRACKETS = {"(": "-LRB-", ")": "-RRB-"}
_VOWELS = frozenset("aeiouyhàâéèêëîïôöûü")


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def _parts(word: str, lang: str) -> Iterator[str]:
    """The tokens of a word with its apostrophes."""
    word = word.replace("’", "'")
    head, mark, tail = word.rpartition("'")
    if not mark:
        if lang == "eng" and word.lower() == "cannot":
            yield from (word[:3], word[3:])
        else:
            yield word
        return
    low = tail.lower()
    if lang == "eng" and low == "t" and head[-1:].lower() == "n" and len(head) > 1:
        verb = head[:-1]
        yield from (_cased(_FULL[verb.lower()], verb) if verb.lower() in _FULL else verb, head[-1] + "'" + tail)
    elif low in _CLITICS and lang == "eng":
        yield from _parts(head, lang)
        yield "'" + tail
    elif lang in ("kin", "mlg") or (low[:1] in _VOWELS and len(head) <= 2):
        yield from (head + "'", tail)
    else:
        yield word


def tokenize(text: str | None, lang: str = "eng") -> str | None:
    """The tokens, joined by single blanks; null for null."""
    if text is None:
        return None
    text, out = unescape(text), []
    found = list(_SCAN.finditer(text))
    for i, m in enumerate(found):
        piece, kind = m[0], m.lastgroup
        touches = lambda j, m=m: 0 <= j < len(found) and found[j].lastgroup in ("word", "number") and (found[j].end() == m.start() or found[j].start() == m.end())
        left, right = touches(i - 1), touches(i + 1)
        if kind == "word":
            out += _parts(piece, lang)
        elif piece in _BRACKETS:
            out.append(_BRACKETS[piece])
        elif piece == '"' or (piece in "-/:" and (left or right)):
            out.append("@" * left + piece + "@" * right)
        else:
            out.append(piece)
    return " ".join(out)
