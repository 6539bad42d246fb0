"""Tokens of informal text, by one scan: whatever matches first at a place is a token, and blanks are what nothing matches.

The scan is a single native regular expression. Faces, hearts, arrows, links, addresses, hashtags, numbers and abbreviations are
tried before words, so they stay whole; a word ends before a mark, a quote or a bracket at its edge, and before a number with a
point or colon in it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTE, _STOP = r"'\"“”‘’«»{}()\[\]*", ".?!,:;…"
_ESCAPED = "&(?:quot|amp|gt|lt);"
_LEFT, _RIGHT = "(?:&lt;|<)", "(?:&gt;|>)"
_LINK_END = rf"[^\s<>{_STOP}{_QUOTE}]"
_CLOSED = r"(?![\p{L}\p{N}])"
_NUMBER = {"time": r"\d+:\d+", "grouped": r"\d+(?:,\d{3})+(?!\d)(?:\.\d+)?", "decimal": r"\d+\.\d+"}
_NO_NUMBER = "(?!" + "|".join(_NUMBER.values()) + ")"
_RUN = rf"(?:[^\s\d{_QUOTE}{_STOP}<>&♫―-]++|{_NO_NUMBER}\d|-(?!-)|&(?!(?:quot|amp|gt|lt);))++"

#: In the order in which they are tried.
FAMILIES = {
    "email": r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)++",
    "url": rf"(?:https?://|www\.)(?:[^\s<>]*{_LINK_END})?|(?:[\p{{L}}\p{{N}}-]++\.){{1,8}}(?:com|org|net|edu|gov|info|io|ly|mp|co\.uk|uk|ca){_CLOSED}(?:/[^\s<>]*{_LINK_END}|/)?",
    "heart": rf"{_LEFT}+/?3+",
    "emoticon": rf"[:;=]['o^-]?(?:[()\[\]|*/\\]+|[dDpPoO3]+{_CLOSED})|(?<![^\s])[()\[\]dD]+['o^-]?[:;=](?=\s|$)",
    "arrow": rf"[-=]+{_RIGHT}+|{_LEFT}+[-=]*{_RIGHT}*|{_RIGHT}+",
    "entity": _ESCAPED,
    "hashtag": r"#[\p{L}\p{N}_]+",
    "mention": r"@[\p{L}\p{N}_]+",
    **_NUMBER,
    "abbreviation": r"(?<![\p{L}\p{N}])(?:(?:\p{L}\.){2,}+|(?i:mrs?|ms|dr|st|sen|rep|[sj]r)\.)",
    "separator": "-{2,}|―",
    "decoration": "♫+",
    "word": rf"{_RUN}(?:['’]{_RUN})*+",
    "quotes": f"[{_QUOTE}]+",
    "marks": f"[{_STOP}]+",
    "rest": r"\S",
}
#: Letters between blanks, which are most tokens, need no look at the families.
TOKEN = r"\p{L}++(?=\s|$)|" + "|".join(f"(?:{x})" for x in FAMILIES.values())
FAMILIES["apostrophe"] = rf"{_RUN}(?:['’]{_RUN})++"


def social_tokenize(s: Column) -> Column:
    """Tokens of informal text: emoticons, links, addresses, hashtags, numbers and abbreviations stay whole; quotes and brackets
    at the edge of a word split off. Null for null, no tokens for blanks."""
    return F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))


def normalize_entities(s: Column) -> Column:
    """Writes out the entities of less, greater and ampersand."""
    return F.replace(F.replace(F.replace(s, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def social_tokenize_to_string(s: Column) -> Column:
    return normalize_entities(F.array_join(social_tokenize(s), " "))


def either(*patterns: str) -> str:
    """A pattern for any of several."""
    return "(?:" + "|".join(patterns) + ")"


def count_family(s: Column, family: str) -> Column:
    """How often a family's pattern is found, whatever else is there."""
    return F.regexp_count(s, F.lit(FAMILIES[family]))
