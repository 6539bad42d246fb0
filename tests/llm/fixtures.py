"""Awkward tables: nulls in every column, empty, blank and very long texts, repeated rows, and columns with clashing names."""

LONG = "alpha beta gamma delta " * 60_000
TEXT = "The quick brown fox jumps over the lazy dog and runs far away from here today."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, __row string, `a.b` string, rank int, sequence long, n_tokens long, fail_bits int, bucket int, id long, similarity double, __gone long, __key string, media binary, epoch int"
EXTRA = (0.5, "k", "r", "dot", 1, 2, 3, 4, 5, 6, 0.1, 7, "x", b"m", 8)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


ROWS = [
    row(1, TEXT), row(1, TEXT), row(2, TEXT + " More."), row(3, TEXT), row(4, None), row(5, ""), row(6, " \n\t "), row(7, "one"), row(8, LONG), row(9, "### $$$ %%% &&& *** ###"),
    row(None, TEXT), row(None, None, None, None), row(10, "Ein kurzer Text über Öl und Äpfel.", None, None), row(11, TEXT.upper(), "en", None),
]


def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
