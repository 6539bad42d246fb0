"""k-means with restarts, scaling and principal components, over points (id, coord ARRAY<DOUBLE>).

Centroids and other models have k x d or d x d numbers and travel with the plan. One Lloyd step of all restarts is one pass over
the points: an Arrow kernel assigns a batch to the nearest centroids of each restart and emits partial sums, so a task sends
k x d numbers a restart, however many points it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


def centroid_distances(coord: Column, centroids: list[list[float]], distance: str = "euclidean") -> Column:
    """An array of a point's distances to the centroids, as one expression."""
    fixed = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    return F.transform(fixed, lambda c: vectors.distance(distance)(coord, c))


def assign(points: DataFrame, centroids: list[list[float]], distance: str = "euclidean") -> DataFrame:
    """points with cluster (the nearest centroid's number, the first of equals) and distance."""
    d = F.transform(centroid_distances(F.col("coord"), centroids, distance), lambda x: F.coalesce(x, F.lit(float("inf"))))
    out = points.withColumn("__d", d).withColumn("distance", F.array_min("__d"))
    return out.withColumn("cluster", (F.array_position("__d", F.col("distance")) - 1).cast("int")).drop("__d")


def dispersion(assigned: DataFrame) -> float:
    return float(assigned.agg(F.coalesce(F.sum(F.col("distance") * F.col("distance")), F.lit(0.0)).alias("x")).first().x)


def means(assigned: DataFrame) -> list[list[float]]:
    """Centroids of the clusters that have points, by number."""
    rows = assigned.select("cluster", F.posexplode("coord").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("m")).collect()
    out: dict[int, dict[int, float]] = {}
    for r in rows:
        out.setdefault(r.cluster, {})[r.dim] = r.m
    return [[m for _, m in sorted(out[c].items())] for c in sorted(out)]


def _distances(x: np.ndarray, c: np.ndarray, kind: str) -> np.ndarray:
    if kind == "euclidean":
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0))
    if kind == "manhattan":
        return np.abs(x[:, None] - c[None]).sum(2)
    n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(1 - x @ c.T / n, nan=np.inf)


def lloyd_step(points: DataFrame, centroids: list[np.ndarray], distance: str = "euclidean") -> list[tuple[float, np.ndarray]]:
    """For each restart, the dispersion under its centroids, and the means of their clusters; empty clusters vanish."""
    vectors.distance(distance)
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [[0.0, np.zeros_like(c), np.zeros(len(c))] for c in shared.value]
        for p in parts:
            if not len(p):
                continue
            x = np.stack(p["coord"].to_numpy()).astype(float)
            for s, c in zip(sums, shared.value, strict=True):
                d = _distances(x, c, distance)
                near = d.argmin(1)
                s[0] += float((d[np.arange(len(x)), near] ** 2).sum())
                np.add.at(s[1], near, x)
                s[2] += np.bincount(near, minlength=len(c))
        yield pd.DataFrame([(i, j, s[0] if j == 0 else 0.0, s[1][j].tolist(), s[2][j]) for i, s in enumerate(sums) for j in range(len(s[1]))], columns=["run", "cluster", "disp", "sums", "n"])

    parts = points.select("coord").mapInPandas(run, "run int, cluster int, disp double, sums array<double>, n double")
    out = [[0.0, np.zeros_like(c), np.zeros(len(c))] for c in centroids]
    dims = len(centroids[0][0])
    cells = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims)]
    for r in parts.groupBy("run", "cluster").agg(F.sum("disp").alias("disp"), F.sum("n").alias("n"), *cells).collect():
        out[r.run][0] += r.disp
        out[r.run][1][r.cluster] = [r[f"s{i}"] for i in range(dims)]
        out[r.run][2][r.cluster] = r.n
    return [(o[0], o[1][o[2] > 0] / o[2][o[2] > 0][:, None]) for o in out]


def kmeans(points: DataFrame, k: int, distance: str = "euclidean", restarts: int = 25, least_change: float = 1e-4, iterations: int = 100, seed: int = 13) -> tuple[float, list[list[float]]]:
    """The least dispersion over restarts and its centroids. Starts are points in an order that the seed fixes; all restarts move
    in the same pass. The dispersion is that of the centroids that are given."""
    points = points.select("id", "coord").persist()
    starts = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k * restarts).select("coord").collect()
    pool = [np.array(r.coord, float) for r in starts]
    if not pool:
        return 0.0, []
    now = [np.stack([pool[(i * k + j) % len(pool)] for j in range(min(k, len(pool)))]) for i in range(restarts if len(pool) > k else 1)]
    before = [np.inf] * len(now)
    final: list[tuple[float, np.ndarray] | None] = [None] * len(now)
    for _ in range(iterations):
        todo = [i for i, f in enumerate(final) if f is None]
        if not todo:
            break
        for i, (disp, moved) in zip(todo, lloyd_step(points, [now[i] for i in todo], distance), strict=True):
            if before[i] - disp < least_change:
                final[i] = (disp, now[i])
            before[i], now[i] = disp, moved
    for i, f in enumerate(final):
        if f is None:
            final[i] = (lloyd_step(points, [now[i]], distance)[0][0], now[i])
    points.unpersist()
    best = min(final, key=lambda f: f[0])
    return best[0], best[1].tolist()


# --- scaling and principal components ---


def dimension_stats(points: DataFrame) -> DataFrame:
    """(dim, mean, ss, n): the mean of each dimension, its squared deviations summed, and the number of points."""
    return points.select(F.posexplode("coord").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("ss"), F.count("x").alias("n"))


def zscore(points: DataFrame, mode: str = "population") -> DataFrame:
    """coord, centred and scaled by dimension; by the standard deviation, or with mode="reference" by the root of the summed
    squares, without a division by the number of points. A dimension that doesn't vary becomes 0."""
    if mode not in ("population", "reference"):
        raise ValueError(f"no such mode: {mode}")
    rows = sorted(dimension_stats(points).collect(), key=lambda r: r.dim)
    mean = F.array(*[F.lit(float(r["mean"])) for r in rows])
    sd = F.array(*[F.lit(float(np.sqrt(max(r.ss, 0.0) / (r.n if mode == "population" else 1)))) for r in rows])
    centred = F.zip_with("coord", mean, lambda x, m: x - m)
    return points.withColumn("coord", F.zip_with(centred, sd, lambda x, s: F.when(s > 0, x / s).otherwise(F.lit(0.0))))


def pca(points: DataFrame, share: float = 0.95, mode: str = "reference") -> tuple[DataFrame, np.ndarray]:
    """coord in principal components, and the components kept: the first whose squared eigenvalues pass the share. The d x d
    products are summed by each task first."""
    scaled = zscore(points, mode)
    dims = points.select(F.max(F.size("coord"))).first()[0] or 0

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((dims, dims)), 0
        for p in parts:
            if len(p):
                x = np.stack(p["coord"].to_numpy()).astype(float)
                total, n = total + x.T @ x, n + len(x)
        yield pd.DataFrame([(i, n, row.tolist()) for i, row in enumerate(total)], columns=["i", "n", "row"])

    products = scaled.select("coord").mapInPandas(run, "i int, n long, row array<double>")
    cells = products.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.get("row", F.lit(j))).alias(f"c{j}") for j in range(dims)]).collect()
    cov = np.zeros((dims, dims))
    for r in cells:
        cov[r.i] = [r[f"c{j}"] / max(r.n - 1, 1) for j in range(dims)]
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    vecs = vecs * np.where(vecs[np.abs(vecs).argmax(0), np.arange(dims)] < 0, -1, 1)
    reach = np.cumsum(values**2) / max((values**2).sum(), 1e-300)
    keep = int(np.searchsorted(reach, share, "right")) + 1
    kept = vecs[:, : min(keep, dims)]
    out = F.array(*[vectors.dot(F.col("coord"), F.array(*[F.lit(float(x)) for x in kept[:, j]])) for j in range(kept.shape[1])])
    return scaled.withColumn("coord", out), kept


def transform(name: str, points: DataFrame) -> DataFrame:
    """ident, zscore or pca."""
    if name == "ident":
        return points
    if name == "zscore":
        return zscore(points, "reference")
    if name == "pca":
        return pca(points)[0]
    raise ValueError(f"no such transformer: {name}")
