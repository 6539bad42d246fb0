"""Operator 3, LM scoring: stupid backoff over n-gram counts of the whole corpus.

Score of a word after its context: the count of the n-gram over the count of its context if the n-gram was seen at least
min_count times (once for single words), otherwise alpha times the score with the context's first word dropped; a single word
counts against all words. The first words of a document start with the shorter context that there is, without penalty.

Plan: (1) documents are gathered into chunks of chunk_bytes, as they are read, and the chunks, compressed, are shuffled once; a
document longer than a chunk is cut at blanks, and each further piece carries the words before it as context. (2) Each chunk
explodes its texts into n-grams of every order and keeps the distinct ones with counts. These are partitioned by n-gram hash: the
count table, in which the counts of all chunks are added. (3) The table joins back to the chunks' n-grams by (chunk, bucket), the
words' log scores are summed by piece, and the pieces by document. Chunks (the exchange is reused), n-grams and counts are shuffled
once each; nothing is broadcast and nothing but a total reaches the driver.

An n-gram is its hash of 64 bits, of which the order is part. A chunk's part of a bucket is one row: sorted hashes as differences,
and counts, both by byte planes and compressed, so a key takes 64 - log2(keys of a chunk) bits and a little more, whatever the number
of buckets, plus some 60 bytes a row. Memory of a task: about 60 bytes an n-gram of a chunk (chunk_bytes) or of a bucket
(bucket_keys); larger executors can have more of both, which keeps the rows few at great inputs (rows are chunks * buckets).
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words
from .kernels import extend, room, string_bytes, word_hashes

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
CHUNK_BYTES, BUCKET_KEYS, LEAST_BUCKETS = 12 << 20, 3_000_000, 256
SCHEMA = "doc_id long, n_tokens long, n_backoff long, logp_sum double, logp_per_token double"
PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int32()), ("text", pa.large_binary())])
_BLANK = re.compile(rb"[ \t\n\x0b\f\r]")
_LAST_WORDS = re.compile(rb"[^ \t\n\x0b\f\r]+")
_zip = functools.cache(lambda: zstandard.ZstdCompressor(level=1))
_unzip = functools.cache(zstandard.ZstdDecompressor)


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers, compressed by byte planes."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return _zip().compress(planes[: max(1, int(planes.any(1).nonzero()[0].max(initial=0)) + 1)].tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(_unzip().decompress(data), np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(raw)] = raw.T
    return out.view("<u8").ravel()


def cut(text: bytes, most: int, context: int) -> list[tuple[int, bytes]]:
    """A text in pieces of about `most` bytes, cut at blanks: how many words at a piece's begin are context from before, and the
    piece. No piece can be shorter than its longest word."""
    out, begin, shown, words = [], 0, 0, 0
    while len(text) - begin > most:
        m = _BLANK.search(text, begin + most)
        if not m:
            break
        out.append((words, text[shown : m.start()]))
        begin = shown = m.start()
        words = 0
        back = 1 << 10
        while context:  # the last `context` words before the cut
            lo = max(0, begin - back)
            found = list(_LAST_WORDS.finditer(text, lo, begin))
            if lo == 0 or len(found) > context:
                found = found[-context:]
                words, shown = len(found), found[0].start() if found else begin
                break
            back *= 4
    return [*out, (words, text[shown:])]


def _chunks(most: int, context: int):
    def run(batches):
        task, rows, count, size = TaskContext.get().partitionId(), [], 0, 0
        number = 0

        def chunk():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, PIECES, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(PIECES)], schema=PIECES))
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "pieces"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                for before, piece in cut(text.as_py() or b"", most, context):
                    rows.append((task << 40 | count, doc, before, piece))
                    size += len(piece)
                    if size >= most:
                        yield chunk()
                        rows, size, number = [], 0, number + 1
                count += 1
        if rows:
            yield chunk()

    return run


class Chunk:
    """The n-grams of a chunk, by the word at which each ends."""

    def __init__(self, pieces: bytes, order: int):
        with pa.ipc.open_stream(pieces) as r:
            self.table = r.read_all()
        data, offsets = string_bytes(self.table["text"])
        words, self.rows = word_hashes(data, offsets)
        size = np.diff(self.rows)
        self.place = (np.arange(len(words)) - np.repeat(self.rows[:-1], size)).astype(np.int32)  # of a word in its piece
        self.own = self.place >= np.repeat(self.table["before"].to_numpy(), size)  # and not context
        left, gram, found, self.ends = room(self.rows, len(words)), words, [], []
        for k in range(1, order + 1):
            gram = words if k == 1 else extend(gram, words, k)
            at = np.flatnonzero(left[: len(gram)] >= k)
            found.append(gram[at])
            self.ends.append((at + (k - 1)).astype(np.int32))
        self.all = np.concatenate(found)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams, in order, and how often each ends in a word of the piece itself (0: in context only)."""
        if not self.own.all():
            keys, which = np.unique(self.all, return_inverse=True)
            return keys, np.bincount(which, self.own[np.concatenate(self.ends)], len(keys)).astype(np.int64)
        self.all.sort()
        begins = np.flatnonzero(_first(self.all))
        return self.all[begins], np.diff(begins, append=len(self.all))

    def spread(self, totals: np.ndarray) -> np.ndarray:
        """For each n-gram of `all` the number that belongs to it; totals follow the order of the distinct ones."""
        by = np.argsort(self.all)
        out = np.empty(len(by), np.int64)
        out[by] = totals[np.cumsum(_first(self.all[by]), dtype=np.int32) - 1] if len(by) else 0
        return out


def _first(x: np.ndarray) -> np.ndarray:
    """Whether each of sorted values is the first of its kind."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes of equal width, numbered; buckets are fewer than 2**32."""
    return (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _requests(order: int, buckets: int):
    """For each chunk and bucket, its distinct n-grams and their counts."""

    def run(part: pa.Table) -> pa.Table:
        chunk = part["chunk"][0].as_py()
        keys, counts = Chunk(part["pieces"][0].as_py(), order).distinct()
        which = bucket_of(keys, buckets)
        begins = np.flatnonzero(np.diff(which, prepend=np.uint64(buckets))) if len(keys) else np.zeros(0, int)
        rows = []
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=False):
            rows.append((int(which[lo]), chunk, hi - lo, pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), pack(counts[lo:hi])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["bucket", "chunk", "n", "keys", "counts"])

    return run


def _count(part: pa.Table) -> pa.Table:
    """Adds the counts of all chunks in one bucket of the count table, and gives each chunk the totals of its n-grams."""
    n = part["n"].to_pylist()
    keys = np.concatenate([np.cumsum(unpack(x.as_py(), m)) for x, m in zip(part["keys"], n, strict=True)])
    counts = np.concatenate([unpack(x.as_py(), m).astype(np.int64) for x, m in zip(part["counts"], n, strict=True)])
    by = np.argsort(keys, kind="stable")
    new = _first(keys[by])
    sums = np.add.reduceat(counts[by], np.flatnonzero(new))
    counts[by] = sums[np.cumsum(new) - 1]
    at = np.concatenate([[0], np.cumsum(n)])
    totals = [pack(counts[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    return pa.table([part["bucket"], part["chunk"], part["n"], pa.array(totals, pa.binary())], ["bucket", "chunk", "n", "totals"])


def _score(order: int, alpha: float, min_count: int, corpus_words: int):
    def run(chunks: pa.Table, tables: pa.Table) -> pa.Table:
        if chunks.num_rows == 0:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())], ["row", "doc_id", "n_tokens", "n_backoff", "logp_sum"])
        c = Chunk(chunks["pieces"][0].as_py(), order)
        n = len(c.place)
        got = tables.sort_by("bucket").select(["totals", "n"]).to_pydict()
        totals = np.concatenate([np.zeros(0, np.int64), *(unpack(t, m).astype(np.int64) for t, m in zip(got["totals"], got["n"], strict=True))])
        each = c.spread(totals)
        count, at = [np.full(n, corpus_words, np.int64)], 0  # by the word at which the n-gram ends
        for ends in c.ends:
            k = np.zeros(n, np.int64)
            k[ends] = each[at : at + len(ends)]
            at += len(ends)
            count.append(k)
        logp, backoff, todo = np.zeros(n), np.zeros(n, np.int64), c.own.copy()
        for m in range(order, 0, -1):
            on = np.flatnonzero(todo & (c.place >= m - 1))
            hit = on[count[m][on] >= (min_count if m > 1 else 1)]
            context = count[m - 1][hit - 1] if m > 1 else count[0][hit]
            logp[hit] = np.log(count[m][hit] / context) + math.log(alpha) * backoff[hit]
            todo[hit] = False
            backoff[on] += todo[on]
        rows = c.rows
        some, own = np.flatnonzero(np.diff(rows)), c.own.astype(np.int64)
        sums = [np.zeros(len(rows) - 1, x.dtype) for x in (own, backoff, logp)]
        for s, x in zip(sums, (own, backoff, logp), strict=True):
            if len(some):
                s[some] = np.add.reduceat(x, rows[:-1][some])
        return pa.table([c.table["row"], c.table["doc_id"], *map(pa.array, sums)], ["row", "doc_id", "n_tokens", "n_backoff", "logp_sum"])

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, chunk_bytes: int = CHUNK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """A row for each document: doc_id, n_tokens, n_backoff (steps to a shorter context), logp_sum (natural logarithm) and
    logp_per_token.

    Null and empty texts have no tokens: logp_sum 0, logp_per_token null; a null doc_id stays null. Repeated rows all count in
    the corpus and each has its row. Equal counts need no tie-break. An empty table gives no rows; other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    words = int(d.agg(F.sum(n_words(F.col("text")))).first()[0] or 0)
    chunks = d.mapInArrow(_chunks(chunk_bytes, order), "chunk long, pieces binary")
    buckets = max(LEAST_BUCKETS, -(-words * order // bucket_keys))
    asked = chunks.groupBy("chunk").applyInArrow(_requests(order, buckets), "bucket long, chunk long, n long, keys binary, counts binary")
    counted = asked.groupBy("bucket").applyInArrow(_count, "bucket long, chunk long, n long, totals binary")
    scored = chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_score(order, alpha, min_count, words), "row long, doc_id long, n_tokens long, n_backoff long, logp_sum double")
    summed = scored.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_backoff", "logp_sum")])
    return summed.select("doc_id", "n_tokens", "n_backoff", "logp_sum", F.when(F.col("n_tokens") > 0, F.col("logp_sum") / F.col("n_tokens")).alias("logp_per_token"))


def query(spark, sf_dir: str) -> DataFrame:
    s = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return s.select("doc_id", "n_tokens", "n_backoff", F.round("logp_sum", 4).alias("logp_sum"), F.round("logp_per_token", 6).alias("logp_per_token"))


SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) AS a, generate_subscripts(regexp_extract_all(text, '[^ \t\n\v\f\r]+'), 1) AS p FROM documents),
g AS (SELECT doc_id, p, a, lag(a, 1) OVER d AS b, lag(a, 2) OVER d AS c FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
n AS (SELECT count(*) AS n FROM w), c1 AS (SELECT a, count(*) AS k1 FROM g GROUP BY a),
c2 AS (SELECT b, a, count(*) AS k2 FROM g WHERE b IS NOT NULL GROUP BY b, a),
c3 AS (SELECT c, b, a, count(*) AS k3 FROM g WHERE c IS NOT NULL GROUP BY c, b, a),
s AS (SELECT g.doc_id, CASE WHEN c3.k3 >= 2 THEN 0 WHEN c2.k2 >= 2 THEN CASE WHEN g.c IS NULL THEN 0 ELSE 1 END ELSE CASE WHEN g.b IS NULL THEN 0 WHEN g.c IS NULL THEN 1 ELSE 2 END END AS backs,
  CASE WHEN c3.k3 >= 2 THEN ln(c3.k3::DOUBLE / d3.k2) WHEN c2.k2 >= 2 THEN ln(c2.k2::DOUBLE / d2.k1) ELSE ln(c1.k1::DOUBLE / n.n) END AS l
  FROM g CROSS JOIN n JOIN c1 ON g.a = c1.a LEFT JOIN c2 ON g.b = c2.b AND g.a = c2.a LEFT JOIN c3 ON g.c = c3.c AND g.b = c3.b AND g.a = c3.a
  LEFT JOIN c1 AS d2 ON g.b = d2.a LEFT JOIN c2 AS d3 ON g.c = d3.b AND g.b = d3.a),
t AS (SELECT doc_id, count(*) AS n_tokens, sum(backs) AS n_backoff, sum(l + backs * ln(0.4)) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_tokens, 0)::BIGINT AS n_tokens, coalesce(t.n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(t.x, 0), 4) AS logp_sum, round(t.x / t.n_tokens, 6) AS logp_per_token
FROM documents AS d LEFT JOIN t ON d.doc_id = t.doc_id
"""
