"""Operator 9, best-fit packing into sequences of CAPACITY tokens.

Tokens are those of operator 8 and counted once; the counts are written down before they are used. Documents longer than a
sequence first give full sequences; what is left of each document is one piece. Pieces are counted by exact length and hash
bucket: these counts, at most CAPACITY * BUCKETS, are all that reaches the driver, at any
input size. There the configuration linear program (fewest sequences, over all ways to fill one, that cover the histogram) is
solved to within GAP. Best fit decreasing over the histogram is a solution of it, and is taken if it is that near the total
length; else the program is solved by multiplicative weights: lengths are priced by their weights, the best filling is found by
knapsack dynamic programming and used, and the weights of the lengths that it served are lowered. The fractional solution is
rounded down, and the pieces that are left are placed by best fit decreasing. Every filling then claims a run of the pieces of
each of its lengths, so a piece's sequence follows from its rank among the pieces of its length. Ranks come from counts by
(length, hash bucket) and a window inside each bucket; no task sees a whole length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import between_stages
from .token_count import TOKENIZERS, VOCABULARY, counter, shared_counter

CAPACITY, BUCKETS = 2048, 256
EPSILON, REPRICE, GAP = 0.1, 64, 0.01
SCHEMA = "doc_id long, copy long, part long, begin long, n_tokens long, sequence long, offset long"


def best_filling(value: np.ndarray, slots: int) -> np.ndarray:
    """How many pieces of each length (index i: i + 1 tokens) fill `slots` tokens with the greatest value."""
    n = min(len(value), slots)
    best, pick = np.zeros(slots + 1), np.zeros(slots + 1, np.int64)
    for c in range(1, slots + 1):
        k = min(n, c)
        gain = best[c - k : c][::-1] + value[:k]  # piece of i + 1 tokens, then the rest
        i = int(np.argmax(gain))
        best[c], pick[c] = (gain[i], i + 1) if gain[i] > best[c - 1] else (best[c - 1], 0)
    out, c = np.zeros(len(value), np.int64), slots
    while c > 0:
        if pick[c]:
            out[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return out


def solve(histogram: np.ndarray, slots: int, epsilon: float = EPSILON) -> tuple[list[np.ndarray], np.ndarray]:
    """Fillings and how often each is used (fractions) to cover the histogram: those of best fit decreasing if they are within GAP
    of the total length, else by multiplicative weights, which start from them.

    A length's weight is (1 - epsilon) to the power of how often its pieces are covered so far, over their number. Each step
    uses the filling of the greatest weight among those found, as much as covers one length once more; a length that is covered
    log(lengths) / epsilon**2 times drops out. Every REPRICE steps the knapsack looks for a better filling over all that there
    are; its value also bounds the optimum from below, and the search ends within GAP of that bound. The number of steps doesn't
    depend on how rare a length is. At the end all is scaled down to cover the histogram once.
    """
    used = np.flatnonzero(histogram > 0)
    if not len(used):
        return [], np.zeros(0)
    start, bound = round_down(histogram, [], np.zeros(0), slots), total(histogram) / slots
    if sum(n for _, n in start) <= bound * (1 + GAP):
        return [f for f, _ in start], np.array([n for _, n in start], float)
    need, m = histogram[used].astype(float), len(used)
    lengths, shares, begins = [], [], []  # of each filling found: its lengths, and the share of their pieces that one use covers

    def add(filling: np.ndarray) -> int:
        on = np.flatnonzero(filling)
        begins.append(begins[-1] + len(lengths[-1]) if begins else 0)
        lengths.append(on)
        shares.append(filling[on] / need[on])
        return len(begins) - 1

    for j, i in enumerate(used):
        add(np.where(np.arange(m) == j, slots // (i + 1), 0))
    for f, _ in start:
        add(f[used])
    flat, x = None, [0.0] * len(begins)
    goal, shrink, done, step = np.log(m + 1) / epsilon**2, np.log1p(-epsilon), np.zeros(m), 0
    full = np.zeros(len(histogram))
    while (alive := done < goal).any():
        weight = np.where(alive, np.exp((done - done[alive].min()) * shrink), 0)
        if flat is None:
            flat = np.concatenate(lengths), np.concatenate(shares), np.array(begins)
        value = np.add.reduceat(weight[flat[0]] * flat[1], flat[2])
        best = int(value.argmax())
        if step % REPRICE == 0:
            full[used] = weight / need
            filling = best_filling(full, slots)[used]
            price = filling / need @ weight
            bound = max(bound, weight.sum() / price)
            if done.min() > 0 and sum(x) / done.min() <= bound * (1 + GAP):
                break
            if price > value[best] * (1 + epsilon / 20):
                best, flat = add(filling), None
                x.append(0.0)
        on, share = lengths[best], shares[best]
        much = 1 / share[alive[on]].max()
        done[on] += share * much
        x[best] += much
        step += 1
    out = []
    for k, (on, share) in enumerate(zip(lengths, shares, strict=True)):
        if x[k]:
            f = np.zeros(len(histogram), np.int64)
            f[used[on]] = np.rint(share * need[on]).astype(np.int64)
            out.append(f)
    x = np.array(x)
    return out, x[x > 0] / done.min()


def round_down(histogram: np.ndarray, fillings: list[np.ndarray], x: np.ndarray, slots: int) -> list[tuple[np.ndarray, int]]:
    """Whole sequences for the histogram: the fractional solution rounded down, without more pieces than there are; then best
    fit decreasing for what is left, where equal sequences are handled as one."""
    left, out = histogram.astype(np.int64).copy(), []
    for f, n in sorted(zip(fillings, x, strict=True), key=lambda p: -p[1]):
        on = f > 0
        n = min(int(n), int((left[on] // f[on]).min())) if on.any() else 0
        if n > 0:
            out.append((f, n))
            left -= f * n
    open_: dict[int, list[list]] = {}  # free tokens -> [filling, how many]
    for size in range(len(left), 0, -1):
        todo = int(left[size - 1])
        for free in sorted(f for f in open_ if f >= size):
            if not todo:
                break
            stay = []
            for filling, n in open_.pop(free):
                each = free // size
                full = min(n, todo // each)
                for many, k in ((full, each), (1 if full < n and todo - full * each else 0, todo - full * each)):
                    if many:
                        f = filling.copy()
                        f[size - 1] += k
                        open_.setdefault(free - k * size, []).append([f, many])
                        todo -= k * many
                        n -= many
                if n:
                    stay.append([filling, n])
            if stay:
                open_.setdefault(free, []).extend(stay)
        if todo:
            each = slots // size
            for many, k in ((todo // each, each), (1, todo % each)):
                if many and k:
                    f = np.zeros(len(left), np.int64)
                    f[size - 1] = k
                    open_.setdefault(slots - k * size, []).append([f, many])
    return out + [(f, n) for group in open_.values() for f, n in group]


def total(histogram: np.ndarray) -> float:
    return float((histogram * np.arange(1, len(histogram) + 1)).sum())


def plan(histogram: np.ndarray, slots: int, epsilon: float = EPSILON) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Fillings with their numbers of uses (the rounded program, or best fit decreasing where that takes fewer sequences), and a
    lower bound of sequences (total length)."""
    packed = [round_down(histogram, *solve(histogram, slots, epsilon), slots), round_down(histogram, [], np.zeros(0), slots)]
    return min(packed, key=lambda p: sum(n for _, n in p)), total(histogram) / slots


def _runs(packed: list[tuple[np.ndarray, int]], sizes: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the ranks at which each filling's run of pieces ends, its first sequence, its pieces a sequence, and where in the
    sequence they begin (longer ones come first)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first, taken = 0, np.zeros(sizes, np.int64)
    for f, n in packed:
        place = 0
        for i in np.flatnonzero(f)[::-1]:
            taken[i] += int(f[i]) * n
            rows.setdefault(int(i) + 1, []).append((int(taken[i]), first, int(f[i]), place))
            place += int(f[i]) * (int(i) + 1)
        first += n
    return {k: tuple(np.array([r[j] for r in v], np.int64) for j in range(4)) for k, v in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, epsilon: float = EPSILON, count=None, content: bool = False, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Where each part of each document goes: doc_id, copy (from 0, among rows of equal id and text), part (from 0), begin (the
    tokens of the document before the part), n_tokens, sequence (a number shared by what is packed together) and offset (the tokens of
    the sequence before the part). With content=True also content, the bytes of the part's tokens. A sequence never holds more than
    `capacity` tokens; its parts leave no gaps. count: a column function text -> tokens, by default operator 8's with the vocabulary at
    `path`; content needs that one.

    Parts before a document's last are full sequences, with negative numbers (-1 - place among them) kept apart from packed ones,
    which are numbered from 0. Null and empty texts have no tokens and no row. Repeated rows are packed like others; ties of rank are
    broken by id, and equal rows are interchangeable. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    count = count or counter(spark, path)
    text = [F.col("text").alias("text")] if content else []
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count(F.col("text")).cast("long").alias("n"), F.xxhash64("text").alias("tie"), *text)
    d = between_stages(d).where("n > 0")
    d = d.withColumn("full", F.expr(f"(n - 1) div {capacity}"))
    d = d.withColumn("size", (F.col("n") - F.col("full") * capacity).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(BUCKETS)).cast("int"))
    counts = d.groupBy("size", "bucket").agg(F.count("*").alias("pieces"), F.sum("full").alias("fulls")).toArrow()
    pieces, fulls = np.zeros((capacity + 1, BUCKETS), np.int64), np.zeros((capacity + 1, BUCKETS), np.int64)
    cell = counts["size"].to_numpy(), counts["bucket"].to_numpy()
    pieces[cell], fulls[cell] = counts["pieces"].to_numpy(), counts["fulls"].to_numpy()
    runs = _runs(plan(pieces[1:].sum(1), capacity, epsilon)[0], capacity)
    pieces = np.cumsum(pieces, 1) - pieces  # now what lies before a cell
    fulls = np.cumsum(fulls).reshape(fulls.shape) - fulls
    own = Window.partitionBy("size", "bucket").orderBy("doc_id", "tie", "n")
    before = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    copy = F.row_number().over(Window.partitionBy("size", "bucket", "doc_id", "tie").orderBy("n")) - 1
    ranked = d.select("doc_id", "full", "size", "bucket", (F.row_number().over(own) - 1).alias("rank"), (F.sum("full").over(before) - F.col("full")).alias("before"), copy.alias("copy"), *(["text"] if content else []))
    get = shared_counter(spark, path) if content else None
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["content"] * content

    def place(batches):
        for b in batches:
            full, size, bucket, rank, prior, copies = (np.asarray(b.column(i).fill_null(0)).astype(np.int64) for i in range(1, 7))
            ids, seq, offset = b.column(0), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            rank = rank + pieces[size, bucket]
            for s in np.unique(size):
                on = np.flatnonzero(size == s)
                ends, first, each, where = runs[int(s)]
                i = np.searchsorted(ends, rank[on], "right")
                nth = rank[on] - np.concatenate([[0], ends])[i]
                seq[on] = first[i] + nth // each[i]
                offset[on] = where[i] + nth % each[i] * s
            which = np.repeat(np.arange(len(full)), full)
            part = np.arange(len(which)) - np.repeat(np.cumsum(full) - full, full)
            base = prior + fulls[size, bucket]
            last, more = [], []
            if content:
                for raw, n in zip(b.column(7).cast(pa.binary()), full, strict=True):
                    *fronts, back = get().pieces(raw.as_py(), capacity) if n else [raw.as_py()]
                    more += fronts
                    last.append(back)
            tail = lambda x: [pa.array(x, pa.binary())] if content else []
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (copies, full, full * capacity, size, seq, offset)), *tail(last)], names)
            if len(which):
                k = len(which)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), *map(pa.array, (copies[which], part, part * capacity, np.full(k, capacity), -1 - (base[which] + part), np.zeros(k, np.int64))), *tail(more)], names)

    return ranked.mapInArrow(place, SCHEMA + ", content binary" * content)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each part of each row of docs goes, with its content: what a trainer reads, a sequence at a time."""
    return pack(docs, content=True)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
