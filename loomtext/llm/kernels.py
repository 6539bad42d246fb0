"""Vectorised text kernels shared by the corpus operators.

Everything here works on whole Arrow string columns: the UTF-8 buffer of a batch is viewed as a numpy byte array, words are
found by a byte-class table, and all words are hashed at once, eight bytes a step. No Python object is made per word (but for
those of more than 128 bytes). A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Java / RE2 regular expression of a word, for the native and SQL sides.
WORD_RE = r"[^ \t\n\x0B\f\r]+"
CHUNK_BYTES = 2 << 20
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: A span longer than LANES * 8 bytes is hashed by xxh3.
LANES, SEED = 16, 0x6C6F6F6D
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of consecutive rows, and for each row the index of its first word (n + 1 entries)."""
    base, top = int(offsets[0]), int(offsets[-1])
    blank = _WS[data[base:top]]
    if len(blank) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(len(blank) + 1, bool)
    first[offsets - base] = True
    prev_blank = np.empty(len(blank), bool)
    prev_blank[0] = True
    prev_blank[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & (prev_blank | first[:-1]))
    next_blank = np.empty(len(blank), bool)
    next_blank[-1] = True
    next_blank[:-1] = blank[1:]
    ends = np.flatnonzero(~blank & (next_blank | first[1:])) + 1
    return starts + base, ends + base, np.searchsorted(starts, offsets - base)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, beyond the end zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    return np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1), writeable=False)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap. Eight bytes at a time are mixed into a state
    that begins with the length, by a bijection, so different spans of one length up to 8 never collide."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, size = int(starts[0]), ends - starts
    window, out = _lanes(data[lo : int(ends[-1])]), mix(size.astype(np.uint64) + np.uint64(SEED))
    long = np.flatnonzero(size > 8 * LANES)
    on = np.flatnonzero(size <= 8 * LANES) if len(long) else np.arange(len(starts))
    at, left = starts[on] - lo, size[on]
    state = out if len(on) == len(starts) else out[on]
    lane = window[at].view(np.uint64).ravel() & _MASK[np.minimum(left, 8)]
    state = mix(state ^ lane)
    out[on] = state
    more = np.flatnonzero(left > 8)
    on, at, left, state = on[more], at[more], left[more], state[more]
    while len(on):
        at, left = at + 8, left - 8
        lane = window[at].view(np.uint64).ravel() & _MASK[np.minimum(left, 8)]
        state = mix(state * np.uint64(0xD1342543DE82EF95) ^ lane)
        out[on] = state
        more = np.flatnonzero(left > 8)
        on, at, left, state = on[more], at[more], left[more], state[more]
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].data, SEED)
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span whose index `other` gives."""
    size = ends - starts
    same = size == size[other]
    on = np.flatnonzero(same & (other != np.arange(len(starts))))
    long = on[size[on] > 8 * LANES]
    on = on[size[on] <= 8 * LANES]
    lo = int(starts[0]) if len(starts) else 0
    window = _lanes(data[lo : int(ends[-1])]) if len(on) else None
    at, to, left = starts[on] - lo, starts[other[on]] - lo, size[on]
    while len(on):
        differ = (window[at].view(np.uint64).ravel() ^ window[to].view(np.uint64).ravel()) & _MASK[np.minimum(left, 8)]
        same[on[differ != 0]] = False
        more = np.flatnonzero((left > 8) & (differ == 0))
        on, at, to, left = on[more], at[more] + 8, to[more] + 8, left[more] - 8
    for i in long:
        j = int(other[i])
        same[i] = np.array_equal(data[starts[i] : ends[i]], data[starts[j] : ends[j]])
    return same


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of consecutive rows, and for each row the index of its first word (n + 1 entries)."""
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(data, starts, ends), rows


def extend(grams: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that begin at each word from hashes of the (k-1)-grams; the last k - 1 entries are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix(grams[:n] * np.uint64(0xD1342543DE82EF95) + words[k - 1 :] + np.uint64(k))


def room(rows: np.ndarray, n_words: int) -> np.ndarray:
    """How many words of its row begin at or after each word."""
    return np.repeat(rows[1:], np.diff(rows)) - np.arange(n_words)


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, with row bounds. A row of 1 to k - 1 words has one shingle of all its words."""
    gram, left = words, room(rows, len(words))
    for m in range(2, k + 1):
        gram = extend(gram, words, m)
    keep = left[: len(gram)] >= k
    out, count = gram[keep], np.maximum(np.diff(rows) - k + 1, 0)
    few = np.flatnonzero((np.diff(rows) > 0) & (np.diff(rows) < k))
    if len(few):
        extra = []
        for r in few:
            own = words[rows[r] : rows[r + 1]]
            g = own
            for m in range(2, len(own) + 1):
                g = extend(g, own, m)
            extra.append(mix(g[:1] + np.uint64(len(own))))
        at = np.concatenate([[0], np.cumsum(count)])[few]
        out = np.insert(out, at, np.concatenate(extra))
        count[few] = 1
    return out, np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
