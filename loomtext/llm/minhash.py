"""Operator 4, near-duplicates by circulant MinHash.

Two fixed random permutations of D = 2**20 points make the whole signature: sigma first scatters a shingle, and coordinate k is
the least value of pi shifted circularly by k. With pi extended by its own beginning, the K values of one shingle are the K
entries of pi that follow sigma's point, so a signature is a column-wise minimum over rows of one strided view.

Plan: (1) one pass over the texts yields a 128-bit BLAKE2 digest of the words and the band keys; it is checkpointed, narrow.
(2) Texts of equal words fold into their lowest id by a partial aggregate, so thousands of copies make thousands of rows and
not millions of pairs. (3) The distinct texts are bucketed by band key. All members of a bucket go to the bucket's lowest id,
its centre; two texts that share any bucket share its centre, so the groups by centre hold every candidate pair. (4) Groups
compare exact shingle sets, of words numbered by their bytes, for those pairs only that share one of their rarer shingles, as all
similar ones do. A group of more than BLOCK texts or BLOCK_BYTES is cut into blocks by hash, each with the centre. Texts that are linked to the centre within their block need no comparison with each other. Those that aren't
(loose ones) are compared, block by block, with all texts of the group, so a task never holds more than two blocks. A pair whose
ends are already linked is skipped, which changes no component; no other similar pair is, and nothing is capped. (5) Connected components
by alternating large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage
from .kernels import chunks, mix, shingles, string_bytes, word_hashes

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 32, 4, 0.5
DOMAIN, SEED = 1 << 20, 20240601
#: About the most texts of a group, and bytes of them, that one task holds on either side.
BLOCK, BLOCK_BYTES = 8192, 8 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and for each point the k values of pi from there on, circularly."""
    if k not in _tables:
        rng = np.random.Generator(np.random.PCG64(SEED))
        sigma, pi = rng.permutation(DOMAIN).astype(np.int32), rng.permutation(DOMAIN).astype(np.uint32)
        _tables[k] = sigma, sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)
    return _tables[k]


def signatures(grams: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The circulant MinHash signature of each row's shingles; a row without shingles has all ones."""
    sigma, window = _permutations(k)
    out = np.full((len(rows) - 1, k), 0xFFFFFFFF, np.uint32)
    at = sigma[(grams & np.uint64(DOMAIN - 1)).astype(np.int64)]
    for i in np.flatnonzero(np.diff(rows)):
        for lo in range(rows[i], rows[i + 1], 2048):
            np.minimum(out[i], window[at[lo : min(lo + 2048, rows[i + 1])]].min(axis=0), out=out[i])
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band of each signature; the band's number is part of the key."""
    part = sig.reshape(len(sig), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2])
    for r in range(part.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return key.view(np.int64)


def _sketch(shingle: int, bands: int, per_band: int):
    def run(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            ids = batch.column(0)
            for i, j in chunks(offsets):
                words, rows = word_hashes(data, offsets[i : j + 1])
                some = np.flatnonzero(np.diff(rows))
                if not len(some):
                    continue
                prints = b"".join(hashlib.blake2b(b" ".join(data[offsets[i + r] : offsets[i + r + 1]].tobytes().split()), digest_size=16).digest() for r in some)
                high, low = np.frombuffer(prints, np.int64).reshape(-1, 2).T
                keys = band_keys(signatures(*shingles(words, rows, shingle), bands * per_band)[some], bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                size = pa.array(np.diff(offsets[i : j + 1])[some])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(some)).cast(pa.int64()), pa.array(high), pa.array(low), size, lists], ["doc_id", "fp_high", "fp_low", "bytes", "bands"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard similarity of two sorted distinct arrays; 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def exact_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The set of k-word shingles of each text, sorted, as numbers that are equal only for equal shingles of these texts. A text
    of 1 to k - 1 words has one shingle, all of it, which no longer text has."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = [np.fromiter(map(number.__getitem__, t.split()), np.int64) for t in texts]
    flat = np.concatenate(words) if words else np.zeros(0, np.int64)
    base = len(number) + 1
    n = max(0, len(flat) - k + 1)
    gram = flat
    for m in range(1, k):
        gram = gram[: len(flat) - m] * base + flat[m:] if len(flat) > m else flat[:0]
        if m + 1 < k and base ** (m + 2) >= 1 << 62:
            gram = np.unique(gram, return_inverse=True)[1]
    out, at, few = [], 0, {}
    for w in words:
        if 0 < len(w) < k:
            out.append(np.array([-1 - few.setdefault(tuple(w.tolist()), len(few))]))
        else:
            out.append(np.unique(gram[at : at + max(0, len(w) - k + 1)][: max(0, n - at)]))
        at += len(w)
    return out


def rare_shingles(sets: list[np.ndarray], threshold: float) -> list[list[int]]:
    """Of each set, the rarest shingles, so many that two sets at or above the threshold have one of them in common; numbers that
    only sets of this call share. Those that no other set has are left out."""
    sizes = np.array([len(x) for x in sets], np.int64)
    if not sizes.sum():
        return [[] for _ in sets]
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((rank[gram], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Of n shingles, ceil(threshold * n) at least are shared; so one is among the first n + 1 less that many.
    most = sizes + 1 - np.ceil(threshold * sizes - 1e-9).astype(np.int64)
    keep = order[(place < np.repeat(most, sizes)) & (count[gram[order]] > 1)]
    return [x.tolist() for x in np.split(gram[keep], np.searchsorted(owner[keep], np.arange(1, len(sets))))]


def link(ids: list[int], sets: list[np.ndarray], threshold: float) -> tuple[list[tuple[int, int, float]], list[list[int]]]:
    """Edges (higher id, lower id, similarity) that join exactly the components of all pairs at or above the threshold, and the
    components, as indices.

    At first a text is compared with the leaders of components, and leads one of its own if it is like none; then with earlier
    texts of other components, but for two leaders, which were compared."""
    order, rare, edges = np.argsort(ids, kind="stable").tolist(), rare_shingles(sets, threshold), []
    part, members = list(range(len(ids))), [[i] for i in range(len(ids))]

    def join(i: int, j: int) -> bool:
        if (s := similar(sets[i], sets[j], threshold)) is None:
            return False
        edges.append((max(ids[i], ids[j]), min(ids[i], ids[j]), s))
        small, large = sorted((part[i], part[j]), key=lambda p: len(members[p]))
        for x in members[small]:
            part[x] = large
        members[large] += members[small]
        members[small] = []
        return True

    leaders, leads = defaultdict(list), [False] * len(ids)
    for i in order:
        if not any(join(i, j) for j in sorted({j for g in rare[i] for j in leaders.get(g, ())})):
            leads[i] = True
            for g in rare[i]:
                leaders[g].append(i)
    parts_of = defaultdict(set)
    for i in order:
        for g in rare[i]:
            parts_of[g].add(part[i])
    earlier = defaultdict(list)
    for i in order:
        shared = [g for g in rare[i] if len(parts_of[g]) > 1]
        for j in sorted({j for g in shared for j in earlier.get(g, ()) if part[j] != part[i] and not (leads[i] and leads[j])}):
            if part[j] != part[i]:
                join(i, j)
        for g in shared:
            earlier[g].append(i)
    return edges, [m for m in members if m]


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> float | None:
    """The similarity of two sets, if it is at or above the threshold."""
    small, large = sorted((len(a), len(b)))
    return s if small >= threshold * large and (s := jaccard(a, b)) >= threshold else None


EDGES = {"centre": pa.int64(), "doc_id": pa.int64(), "other_id": pa.int64(), "similarity": pa.float64()}
EDGE_SCHEMA = "centre long, doc_id long, other_id long, similarity double"


def _edge_table(centre: int, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([centre] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(list(EDGES.values())[1:]))], list(EDGES))


def _within(shingle: int, threshold: float):
    """Links of one block; a text that isn't linked to the centre is told by a row without other_id."""

    def run(part: pa.Table) -> pa.Table:
        ids, centre = part["__id"].to_pylist(), part["centre"][0].as_py()
        edges, parts = link(ids, exact_sets(part["__text"].cast(pa.binary()).to_pylist(), shingle), threshold)
        if part["blocks"][0].as_py() > 1:
            edges += [(ids[i], None, None) for p in parts if centre not in {ids[i] for i in p} for i in p]
        return _edge_table(centre, edges)

    return run


def _across(shingle: int, threshold: float):
    """Links between a block of loose texts and a block of all. A loose text is compared with those of the centre's component
    until one is similar, and with every loose one."""

    def run(part: pa.Table) -> pa.Table:
        ids, asks, loose = (part[c].to_pylist() for c in ("__id", "asks", "loose"))
        sets, edges = exact_sets(part["__text"].cast(pa.binary()).to_pylist(), shingle), []
        rare = rare_shingles(sets, threshold)
        for settled in (True, False):
            others = defaultdict(list)
            for j in range(len(ids)):
                if not asks[j] and loose[j] != settled:
                    for g in rare[j]:
                        others[g].append(j)
            for i in (i for i in range(len(ids)) if asks[i]):
                for j in sorted({j for g in rare[i] for j in others.get(g, ())}):
                    if ids[i] != ids[j] and (s := similar(sets[i], sets[j], threshold)) is not None:
                        edges.append((max(ids[i], ids[j]), min(ids[i], ids[j]), s))
                        if settled:
                            break
        return _edge_table(part["centre"][0].as_py(), edges)

    return run


def edges_of(member: DataFrame, texts: DataFrame, shingle: int, threshold: float, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, other_id, similarity) that link the members (centre, rep) of each group, by their texts (__id, __text). If members
    have `bytes`, the size of a text, blocks are cut by it too."""
    wide = F.sum("bytes") / block_bytes if "bytes" in member.columns else F.lit(0)
    cut = lambda b: F.ceil(F.greatest(F.count("*") / block, b))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    size = member.groupBy(F.col("centre").alias("c")).agg(cut(wide).alias("blocks"))
    sized = member.join(size, F.col("centre") == F.col("c")).select("centre", "rep", "blocks", *(["bytes"] if "bytes" in member.columns else []))
    first = sized.withColumn("block", F.explode(F.when(F.col("rep") == F.col("centre"), F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).otherwise(F.array(place("blocks")))))
    rows = cut_lineage(first.join(texts, first.rep == texts["__id"]).select("centre", "block", "blocks", "__id", "__text"))
    found = cut_lineage(rows.groupBy("centre", "block").applyInArrow(_within(shingle, threshold), EDGE_SCHEMA))
    edges, loose = found.where("other_id IS NOT NULL"), found.where("other_id IS NULL").select("centre", "doc_id")
    if not loose.isEmpty():
        asking = loose.join(sized.select(F.col("centre").alias("sc"), F.col("rep").alias("sid"), *sized.columns[3:]), (F.col("centre") == F.col("sc")) & (F.col("doc_id") == F.col("sid")))
        many = asking.groupBy(F.col("centre").alias("c")).agg(cut(wide).alias("asking"))
        who = loose.select(F.col("centre").alias("lc"), F.col("doc_id").alias("lid"), F.lit(True).alias("loose"))
        both = sized.join(many, F.col("centre") == F.col("c")).join(who, (F.col("centre") == F.col("lc")) & (F.col("rep") == F.col("lid")), "left")
        both = both.select("centre", "rep", "blocks", "asking", F.coalesce("loose", F.lit(False)).alias("loose"))
        upto = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
        texts = rows.where("blocks > 1 AND (centre <> __id OR block = 0)").select(F.col("centre").alias("tc"), "__id", "__text")
        with_text = both.join(texts, (both.rep == texts["__id"]) & (both.centre == texts["tc"]))
        cells = F.transform(upto("asking"), lambda a: F.struct(a.alias("a"), place("blocks").alias("b"), F.lit(False).alias("asks")))
        mine = F.when(F.col("loose"), F.transform(upto("blocks"), lambda b: F.struct(place("asking").alias("a"), b.cast("int").alias("b"), F.lit(True).alias("asks"))))
        spread = with_text.select("centre", "__id", "__text", "loose", F.explode(F.concat(cells, F.coalesce(mine, F.array().cast("array<struct<a:int,b:int,asks:boolean>>")))).alias("x"))
        rest = spread.select("centre", "x.a", "x.b", "x.asks", "loose", "__id", "__text").groupBy("centre", "a", "b").applyInArrow(_across(shingle, threshold), EDGE_SCHEMA)
        edges = edges.unionByName(cut_lineage(rest))
    return edges.where("doc_id <> other_id").select("doc_id", "other_id", "similarity")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the lowest id of each node's connected component, for the nodes that aren't their own root."""
    now = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    stamp = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, large.u == low.k).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = cut_lineage(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        before, stamp = stamp, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if stamp == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document that has a lower-numbered one in its group: doc_id, duplicate_of (the group's lowest id) and
    similarity, the highest exact Jaccard similarity over word shingles of the links by which it was found.

    A group is a connected component of pairs at or above the threshold among the candidates that banding finds. Null and empty
    texts have no shingles and null ids no name: they are never duplicates. Texts of fewer words than a shingle have one
    shingle, all of it. Rows that repeat an id are one document, with all its texts. Ties fall to the lowest id. An empty table gives no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    base = cut_lineage(d.mapInArrow(_sketch(shingle, bands, rows), "doc_id long, fp_high long, fp_low long, bytes long, bands array<long>"))
    reps = base.groupBy("fp_high", "fp_low").agg(F.min("doc_id").alias("rep"), F.max("bytes").alias("bytes"), F.first("bands").alias("bands"))
    same = base.select("doc_id", "fp_high", "fp_low").join(reps.select("fp_high", "fp_low", "rep"), ["fp_high", "fp_low"]).where("doc_id <> rep").select("doc_id", "rep").distinct()
    bucket = Window.partitionBy("key")
    keyed = reps.select("rep", "bytes", F.explode("bands").alias("key")).withColumn("centre", F.min("rep").over(bucket)).where("centre <> rep").groupBy("rep", "centre").agg(F.max("bytes").alias("bytes"))
    member = keyed.select("rep", "centre", "bytes").union(keyed.select("centre", "centre", F.lit(0)).distinct())
    texts = d.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    edges = edges_of(member, texts, shingle, threshold)
    roots = components(edges, "doc_id", "other_id")
    ends = edges.select("doc_id", "similarity").union(edges.select("other_id", "similarity")).groupBy(F.col("doc_id").alias("node")).agg(F.max("similarity").alias("similarity"))
    near = roots.join(ends, "node").select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"), "similarity")
    copies = same.join(roots, same.rep == roots.node, "left").select("doc_id", F.coalesce("root", "rep").alias("duplicate_of"), F.lit(1.0).alias("similarity"))
    return near.union(copies).groupBy("doc_id").agg(F.min("duplicate_of").alias("duplicate_of"), F.max("similarity").alias("similarity")).where("doc_id <> duplicate_of")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that repeat a lower-numbered one; one row remains of rows that repeat an id."""
    gone = near_duplicates(docs).select(F.col("doc_id").alias("__gone"))
    kept = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    named = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.unionByName(kept.where(F.col("doc_id").isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "duplicate_of")


#: All pairs of different texts that share a shingle, and their components.
SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\v\f\r]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
k AS (SELECT w, min(doc_id) AS id FROM t WHERE len(w) > 0 GROUP BY w),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < {SHINGLE} THEN [w] ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: w[i:i + {SHINGLE} - 1]) END) AS g FROM k),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), j AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
e AS (SELECT a, b FROM j JOIN n AS x ON x.id = a JOIN n AS y ON y.id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT b, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.root),
m AS (SELECT node, least(min(root), node) AS root FROM r GROUP BY node)
SELECT t.doc_id, coalesce(m.root, k.id) AS duplicate_of FROM t JOIN k ON t.w = k.w LEFT JOIN m ON m.node = k.id WHERE t.doc_id <> coalesce(m.root, k.id)
"""
