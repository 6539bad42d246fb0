"""Operator 8, token counts: byte-pair merging with a heap and a linked list.

A text is cut into pre-tokens by the vocabulary's published pattern. Each pre-token starts as one symbol a byte, in a doubly
linked list; the adjacent pair of lowest rank is popped from a heap and merged until no pair has a rank. The count is the
initial symbols less the merges; no identifier is made.

The cuts are found for a whole column at once, from the classes of its characters; equal pre-tokens of a chunk are counted once
(they are found by hashes and then compared byte by byte), and what was merged before is looked up in a bounded table of the worker. The work
is a projection: no shuffle, and one column goes to Python.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TOKENIZERS
from .kernels import chunks, same_spans, span_hashes, string_bytes

VOCABULARY = "byte_bpe_50k.tiktoken"
#: What the cuts follow.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in each of the two generations of a worker's table.
MEMO = 500_000
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: A text longer than LONG_TEXT is counted in parts, cut between a visible ASCII character and a blank, where no pre-token goes on.
LONG_TEXT = 8 << 20
_CUT = re.compile(rb"[!-~](?= )")


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = np.array([unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)])
    out[kinds == "L"], out[kinds == "N"] = LETTER, NUMBER
    out[_SPACES] = SPACE
    return out


def _byte_classes(b: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of valid UTF-8 belongs to."""
    table = _classes()
    out = table[:256][b]
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        first = b[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            on = size > k
            code[on] = code[on] << 6 | (b[lead[on] + k] & 0x3F)
        kind = table[code]
        out[lead] = kind
        for k in (1, 2, 3):
            on = size > k
            out[lead[on] + k] = kind[on]
    return out


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of consecutive rows begin, in bytes of data."""
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    if n == 0:
        return np.zeros(0, np.int64)
    b = data[base : base + n]
    kind = _byte_classes(b)
    fresh = np.zeros(n + 1, bool)  # a row begins here, or all end
    fresh[offsets - base] = True
    mark = fresh[:n].copy()
    mark[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(mark)
    ends = np.append(runs[1:], n)
    goes_on = ~fresh[ends]  # the row has another run
    # the last character of white space before something else: a blank joins it, anything else stands alone
    w = np.flatnonzero((kind[runs] == SPACE) & goes_on)
    last = ends[w] - 1
    for _ in range(2):
        last -= (b[last] & 0xC0) == 0x80
    mark[last] = True
    mark[ends[w[b[last] == 0x20]]] = False
    # an apostrophe that begins a pre-token takes one of a few endings with it
    q = np.flatnonzero((b[runs] == 0x27) & (ends - runs == 1) & goes_on)
    q = q[mark[runs[q]]]
    q = q[kind[ends[q]] == LETTER]
    if len(q):
        at, stop = ends[q], ends[q + 1]
        x, y = b[at], np.where(at + 1 < stop, b[np.minimum(at + 1, n - 1)], 0)
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)
        some = one | two
        mark[at[some]] = False
        after = at[some] + np.where(one[some], 1, 2)
        mark[after[after < n]] = True
    return np.flatnonzero(mark) + base


def pretokens(text: str) -> list[str]:
    if not text:
        return []
    raw = text.encode()
    starts = pretoken_starts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [raw[i:j].decode() for i, j in zip(starts, [*starts[1:], len(raw)], strict=True)]


def _merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, list[int]]:
    """How many symbols are left of the bytes of a pre-token after all merges, and by the byte at which a symbol begins the next
    one's; ties of rank go to the leftmost pair."""
    n = len(word)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    gone = bytearray(n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if gone[i] or j >= n or after[j] != end:
            continue
        gone[j] = 1
        left -= 1
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heappush(heap, (r, p, end))
    return left, after


def merged_count(word: bytes, ranks: dict[bytes, int]) -> int:
    """How many symbols are left of a pre-token."""
    return _merge(word, ranks)[0] if len(word) > 1 else len(word)


def merged_ends(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where the symbols that are left of a pre-token end."""
    after, out, at = _merge(word, ranks)[1], [], 0
    while at < len(word):
        at = after[at]
        out.append(at)
    return out


class Counter:
    """Counts of pre-tokens. What was merged stays in a table of two generations: when the newer is full, the older is dropped."""

    def __init__(self, ranks: dict[bytes, int], most: int = MEMO):
        self.ranks, self.most, self.new, self.old = ranks, most, {}, {}

    def word(self, word: bytes) -> int:
        n = self.new.get(word)
        if n is None:
            n = self.old.get(word)
            if n is None:
                n = merged_count(word, self.ranks)
            if len(word) <= 64:
                if len(self.new) >= self.most:
                    self.old, self.new = self.new, {}
                self.new[word] = n
        return n

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The counts of consecutive rows."""
        starts, each = self.pretokens(data, offsets)
        total = np.concatenate([[0], np.cumsum(each)])
        bounds = np.searchsorted(starts, offsets)
        return total[bounds[1:]] - total[bounds[:-1]]

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokens of consecutive rows begin, and their counts."""
        starts = pretoken_starts(data, offsets)
        if not len(starts):
            return starts, np.zeros(0, np.int64)
        ends = np.append(starts[1:], offsets[-1])
        _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        other = np.flatnonzero(~same_spans(data, starts, ends, first[which]))  # of equal hash, and yet not equal
        first, which[other] = np.append(first, other), len(first) + np.arange(len(other))
        base = int(offsets[0])
        raw = data[base : int(offsets[-1])].tobytes()
        word = self.word
        each = np.array([word(raw[i:j]) for i, j in zip((starts[first] - base).tolist(), (ends[first] - base).tolist(), strict=True)], np.int64)
        return starts, each[which]

    def pieces(self, text: bytes, capacity: int) -> list[bytes]:
        """A text cut after every `capacity` tokens. A piece is the bytes of its tokens, which may end inside a character."""
        data = np.frombuffer(text, np.uint8)
        starts, each = self.pretokens(data, np.array([0, len(text)]))
        total, cuts = np.cumsum(each), [0]
        for c in range(capacity, int(total[-1]) if len(total) else 0, capacity):
            j = int(np.searchsorted(total, c))
            begin, end = int(starts[j]), int(starts[j + 1]) if j + 1 < len(starts) else len(text)
            cuts.append(end if total[j] == c else begin + merged_ends(text[begin:end], self.ranks)[c - int(total[j] - each[j]) - 1])
        return [text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def beginning(self, text: str, most: int) -> str:
        """The longest begin of a text that ends with a pre-token and has at most `most` tokens."""
        raw = text.encode()
        starts, each = self.pretokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        n = int(np.searchsorted(np.cumsum(each), most, "right"))
        return raw[: int(starts[n])].decode() if n < len(starts) else text

    def column(self, text: pa.Array) -> np.ndarray:
        data, offsets = string_bytes(text)
        out = np.zeros(len(offsets) - 1, np.int64)
        for i, j in chunks(offsets):
            own = offsets[i : j + 1]
            if own[-1] - own[0] <= LONG_TEXT:
                out[i:j] = self.rows(data, own)
            else:
                out[i] = sum(int(self.rows(data, part)[0]) for part in _parts(data, int(own[0]), int(own[-1])))
        return out

    def count(self, text: str | None) -> int:
        return int(self.column(pa.array([text], pa.string()))[0])


def _parts(data: np.ndarray, begin: int, end: int):
    """Offsets of the parts of a long text."""
    while begin < end:
        stop = begin + LONG_TEXT
        cut = _CUT.search(data, stop, end) if stop < end else None
        stop = cut.end() if cut else end
        yield np.array([begin, stop])
        begin = stop


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_counters: dict[str, Counter] = {}


def shared_counter(spark: SparkSession, path: str):
    """A function of no arguments that gives the worker's Counter. The vocabulary, of fixed size, is read here and broadcast; a
    worker keeps the counter of the vocabulary that it used last, by a digest of its content."""
    ranks = load_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(ranks)

    def get() -> Counter:
        if name not in _counters:
            _counters.clear()
            _counters[name] = Counter(shared.value)
        return _counters[name]

    return get


def counter(spark: SparkSession, path: str = f"{TOKENIZERS}/{VOCABULARY}"):
    """A column function text -> token count (0 for null and empty)."""
    get = shared_counter(spark, path)

    @F.arrow_udf("long")
    def token_count(text: pa.Array) -> pa.Array:
        return pa.array(get().column(text))

    return token_count


def beginnings(spark: SparkSession, path: str = f"{TOKENIZERS}/{VOCABULARY}"):
    """A column function (text, most) -> the begin of a text that has at most that many tokens, ended with a pre-token; null for null."""
    get = shared_counter(spark, path)

    @F.arrow_udf("string")
    def beginning(text: pa.Array, most: pa.Array) -> pa.Array:
        pairs = zip(text.to_pylist(), most.to_pylist(), strict=True)
        return pa.array([None if t is None or n is None else get().beginning(t, n) for t, n in pairs], pa.string())

    return beginning


def token_counts(docs: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """A row for each document: doc_id, n_symbols (bytes of the text in UTF-8, the initial symbols), n_tokens and n_merges.

    Null and empty texts have 0 of each. Each row is counted alone: repeated rows repeat, an empty table gives none, other
    columns are ignored. Strings that look like special tokens are ordinary text.
    """
    count = counter(docs.sparkSession, path)
    d = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_symbols"), count("text").alias("n_tokens"))
    return d.withColumn("n_merges", F.col("n_symbols") - F.col("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
