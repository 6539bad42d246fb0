"""An English pipeline over pluggable annotators: sentences, tokens, tags, noun chunks and persons. The parts given here are
rules; trained ones can take their place."""

from __future__ import annotations

import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import social_tokenize


def split_sentences(text: Column) -> Column:
    """Sentences: they end in a full stop, question or exclamation mark before a blank and a capital, unless a short title
    stands before it."""
    marked = F.regexp_replace(text, r"(?<!\b(?:Mr|Dr|St|Ms|Jr|Sr)|\bMrs|\bProf)([.!?]+[\"')\]]*)\s+(?=[\p{Lu}\"'(\[])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda s: s != "")


_CLASSES = {
    w: t
    for t, ws in {
        "D": "a an her his its my our that the their these this those your", "R": "i you he she it we they me him us them", "P": "of in to for with on at by from", "C": "and or but",
        "V": "is are was were be been has have had do does did will would can could",
    }.items()
    for w in ws.split()
}
_ENDINGS = ((("ly",), 0, "A"), (("ous", "ful", "able", "ible", "ive", "al", "ic"), 0, "J"), (("ed", "ing", "ize", "ise"), 2, "V"))


def tag_of(token: str) -> str:
    """A coarse tag for a token: of a closed class, a mark, a number, or by its ending."""
    low = token.lower()
    if low in _CLASSES:
        return _CLASSES[low]
    if all(c in string.punctuation for c in token):
        return "."
    if low[:1].isdecimal() and all(c.isdecimal() or c in ".," for c in low):
        return "#"
    return next((t for ends, before, t in _ENDINGS if any(low.endswith(e) and len(low) - len(e) >= before for e in ends)), "N")


@F.arrow_udf(ArrayType(StringType()))
def tag_rules(tokens: pa.Array) -> pa.Array:
    """The tags of lists of tokens; each distinct token of a batch is judged once."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    known = tokens.flatten().dictionary_encode()
    tags = pa.array([tag_of(w) for w in known.dictionary.to_pylist()], pa.string()).take(known.indices)
    bounds = pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))]).astype(np.int32))
    return pa.ListArray.from_arrays(bounds, tags, mask=tokens.is_null())


def _runs(tokens: Column, tags: Column, member) -> Column:
    """The longest runs of tokens whose (token, tag) are members, joined by blanks."""
    pair = F.arrays_zip(tokens.alias("w"), tags.alias("t"))
    line = F.array_join(F.transform(pair, lambda p: F.when(member(p["w"], p["t"]), p["w"]).otherwise(F.lit("\u0001"))), " ")
    return F.filter(F.transform(F.split(line, "\u0001"), lambda x: F.trim(x)), lambda s: s != "")


def noun_chunks(tokens: Column, tags: Column) -> Column:
    return F.filter(_runs(tokens, tags, lambda w, t: t.isin("D", "J", "N", "#")), lambda s: ~F.lower(s).isin("the", "a", "an"))


def persons(tokens: Column, tags: Column) -> Column:
    """Runs of two or more capitalised words."""
    return F.filter(_runs(tokens, tags, lambda w, t: w.rlike(r"^\p{Lu}[\p{Ll}]+$") & (t == "N")), lambda s: s.contains(" "))


@dataclass
class Pipeline:
    sentences: object = field(default=split_sentences)
    tokens: object = field(default=social_tokenize)
    tag: object = field(default=tag_rules)
    chunks: object = field(default=noun_chunks)
    people: object = field(default=persons)

    def run(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, sent, sentence, tokens, tags, chunks, persons), one row for each sentence."""
        d = docs.select(key, F.posexplode(self.sentences(F.col(text))).alias("sent", "sentence")).withColumn("tokens", self.tokens(F.col("sentence")))
        d = d.withColumn("tags", self.tag(F.col("tokens")))
        return d.withColumns({"chunks": self.chunks(F.col("tokens"), F.col("tags")), "persons": self.people(F.col("tokens"), F.col("tags"))})
