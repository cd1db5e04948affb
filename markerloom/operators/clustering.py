"""Clusterings of the sample x marker matrix, keyed by (k, id)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.functions.scalars import squared_distance
from markerloom.operators.kmeans import (
    MAX_ITERATIONS,
    RESTARTS,
    SEED,
    centers_table,
    feature_rows,
    fit_runs,
    nearest,
    partitions,
    prepared,
    vector_totals,
)

# Fixed values of the mixture fit: iteration limit, gain per row at which it ends, and what is added to variances.
GMM_ITERATIONS = 100
GMM_TOLERANCE = 1e-3
COVARIANCE_FLOOR = 1e-6

# Centers that are sent to the tasks at a time.
CENTERS_IN_TASKS = 20_000


def nearest_centroid(
    points: DataFrame, centers: DataFrame, key: str, limit: int = CENTERS_IN_TASKS
) -> DataFrame:
    """(k, key, cluster, distance2) from points(key, features) and
    centers(k, cluster, center). Ties go to the lower cluster number. More than about
    `limit` centers are sent in parts, and the best of all parts is kept."""
    table = centers.select(F.col("k").cast("bigint"), F.col("cluster").cast("bigint"), "center")
    parts = max(1, -(-table.count() // max(limit, 1)))
    if parts == 1:
        return _nearest_of(points, table.collect(), key)
    hashed = table.withColumn("part", F.pmod(F.xxhash64("k", "cluster"), F.lit(parts)))
    found = [
        _nearest_of(points, rows, key)
        for rows in (hashed.where(F.col("part") == i).drop("part").collect() for i in range(parts))
        if rows
    ]
    best = F.min(F.struct("distance2", "cluster")).alias("best")
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("k", key)
        .agg(best)
        .select("k", key, F.col("best.cluster").alias("cluster"), F.col("best.distance2").alias("distance2"))
    )


def _nearest_of(points: DataFrame, rows: Sequence, key: str) -> DataFrame:
    rows = sorted(rows, key=lambda r: (r["k"], r["cluster"]))
    ks = sorted({r["k"] for r in rows})
    spans = [(k, [i for i, r in enumerate(rows) if r["k"] == k]) for k in ks]
    numbers = np.array([r["cluster"] for r in rows], dtype="int64")
    stacked = np.array([r["center"] for r in rows], dtype="float64")
    mid = stacked.mean(axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(batch) - mid
            for k, at in spans:
                own, distance = nearest(x, stacked[at] - mid)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), k, dtype="int64")),
                        batch.column(key),
                        pa.array(numbers[at][own]),
                        pa.array(distance),
                    ],
                    ["k", key, "cluster", "distance2"],
                )

    key_type = points.schema[key].dataType.simpleString()
    return points.select(key, "features").mapInArrow(
        assign, f"k bigint, `{key}` {key_type}, cluster bigint, distance2 double"
    )


def cluster_means(points: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """(k, cluster, center, n): mean of the members, combined on the map side."""
    member = clusters.select("k", key, "cluster").join(points, key)
    return (
        member.groupBy("k", "cluster")
        .agg(
            Summarizer.mean(array_to_vector("features")).alias("mean"),
            F.count(F.lit(1)).alias("n"),
        )
        .select("k", "cluster", vector_to_array("mean").alias("center"), "n")
    )


def kmeans_step(points: DataFrame, centers: DataFrame, key: str, limit: int = CENTERS_IN_TASKS) -> DataFrame:
    """One assignment and recomputation: the new centers(k, cluster, center, n). The tasks that assign the rows add
    them up as well; only sums are shuffled. More than about `limit` centers go through nearest_centroid."""
    table = centers.select(F.col("k").cast("bigint"), F.col("cluster").cast("bigint"), "center")
    rows = sorted(table.limit(limit + 1).collect(), key=lambda r: (r["k"], r["cluster"]))
    if len(rows) > limit or not rows:
        return cluster_means(points, nearest_centroid(points, centers, key, limit), key)
    stacked = np.array([r["center"] for r in rows], dtype="float64")
    mid = stacked.mean(axis=0)
    spans = [[i for i, r in enumerate(rows) if r["k"] == k] for k in sorted({r["k"] for r in rows})]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = np.zeros(len(rows), "int64"), np.zeros(stacked.shape)
        for batch in batches:
            x = feature_rows(batch)
            for at in spans:
                own, _ = nearest(x - mid, stacked[at] - mid)
                size[at] += np.bincount(own, minlength=len(at))
                total[at] += (own[:, None] == np.arange(len(at))[None, :]).astype("float64").T @ x
        used = np.flatnonzero(size)
        yield pa.RecordBatch.from_pydict(
            {
                "k": [rows[i]["k"] for i in used],
                "cluster": [rows[i]["cluster"] for i in used],
                "n": size[used],
                "total": total[used].tolist(),
            },
            pa.schema([("k", pa.int64()), ("cluster", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))]),
        )

    sums = points.select("features").mapInArrow(add_up, "k bigint, cluster bigint, n bigint, total array<double>")
    added = vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")
    counted = sums.groupBy("k", "cluster").agg(added, F.sum("n").alias("n"))
    center = F.transform("total", lambda x: x / F.col("n")).alias("center")
    return counted.select("k", "cluster", center, "n")


def inertia(
    points: DataFrame, clusters: DataFrame, key: str, centers: DataFrame | None = None
) -> DataFrame:
    """(k, inertia): squared distances to the mean or the given centers, summed.

    One aggregation per cluster: around its mean a cluster has (n - 1) times its
    variance, around any other center n times the squared offset more. Centers are
    matched by (k, cluster), so cluster numbers may have gaps.
    """
    member = clusters.select("k", key, "cluster").join(points, key)
    stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("features"))
    per = member.groupBy("k", "cluster").agg(stats.alias("s"))
    spread = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, v: a + v)
    total = spread * (F.col("s.count") - 1)
    if centers is not None:
        per = per.join(centers.select("k", "cluster", "center"), ["k", "cluster"])
        total = total + F.col("s.count") * squared_distance(vector_to_array("s.mean"), F.col("center"))
    return per.groupBy("k").agg(F.sum(total).alias("inertia"))


def kmeans(
    points: DataFrame,
    k: int,
    key: str,
    seed: int = SEED,
    max_iter: int = MAX_ITERATIONS,
    restarts: int = RESTARTS,
    rows: int | None = None,
) -> tuple[DataFrame, float, DataFrame]:
    """(clusters(k, key, cluster), inertia, centers) of the best of `restarts` fits."""
    rows = points.count() if rows is None else rows
    if k > rows:
        raise ValueError(f"{k} clusters from {rows} samples")
    cost, best = fit_runs(points, key, [k], rows, seed, max_iter, restarts)[k]
    centers = centers_table(points.sparkSession, {k: best})
    return nearest_centroid(points, centers, key).select("k", key, "cluster"), cost, centers


def kmeans_sweep(
    points: DataFrame, key: str, ks: Sequence[int], seed: int = SEED, restarts: int = RESTARTS
) -> DataFrame:
    """clusters(k, key, cluster) for every k that has enough samples."""
    rows = points.count()
    possible = [k for k in ks if k <= rows]
    if not possible:
        raise ValueError(f"{rows} samples are too few for any of {list(ks)}")
    fits = fit_runs(points, key, possible, rows, seed, restarts=restarts)
    centers = centers_table(points.sparkSession, {k: c for k, (_, c) in fits.items()})
    return nearest_centroid(points, centers, key).select("k", key, "cluster")


@dataclass(frozen=True)
class Mixture:
    """Parameters of a mixture with full covariances, components in lexicographic order of their means."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    likelihood: float
    rows: int

    @property
    def bic(self) -> float:
        k, dims = self.means.shape
        free = k * dims + k * dims * (dims + 1) // 2 + k - 1
        return float(-2.0 * self.likelihood + free * math.log(self.rows))


def log_density(m: Mixture) -> Callable[[np.ndarray], np.ndarray]:
    """The function that gives (rows, components): log of weight times density. The covariances are factored once, here."""
    dims = m.means.shape[1]
    # The inverse of a triangular factor; rows are multiplied by it.
    inverse = [np.linalg.inv(np.linalg.cholesky(v)) for v in m.covariances]
    start = [
        math.log(max(w, 1e-300)) - 0.5 * dims * math.log(2.0 * math.pi) + np.log(np.diag(i)).sum() for w, i in zip(m.weights, inverse)
    ]

    def density(x: np.ndarray) -> np.ndarray:
        return np.stack([s - 0.5 * (((x - mean) @ i.T) ** 2).sum(axis=1) for s, mean, i in zip(start, m.means, inverse)], axis=1)

    return density


def log_densities(x: np.ndarray, m: Mixture) -> np.ndarray:
    return log_density(m)(x)


def _responsibilities(x: np.ndarray, density: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Share of each component in each row, and the rows' log likelihoods."""
    d = density(x)
    top = d.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(d - top).sum(axis=1, keepdims=True))
    return np.exp(d - total), total[:, 0]


def _moments(
    ready: DataFrame, count: int, mid: np.ndarray, k: int, shares: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Per component the weight, the mean and the covariance around it, and the log likelihood, in one job; relative to `mid`.

    A task sends sums, and of the symmetric products the upper triangle.
    """
    dims = len(mid)
    upper = np.triu_indices(dims)

    def sums(x: np.ndarray) -> np.ndarray:
        r, likelihood = shares(x)
        products = [((x * r[:, c : c + 1]).T @ x)[upper] for c in range(k)]
        return np.concatenate([[likelihood.sum()], r.sum(axis=0), (r.T @ x).ravel(), *products])

    flat = vector_totals(ready, sums, 1 + k + k * dims + k * len(upper[0]), count, mid)
    weight, total, packed = np.split(flat[1:], [k, k + k * dims])
    size = np.maximum(weight, 1e-10)
    means = total.reshape(k, dims) / size[:, None]
    spread = np.zeros((k, dims, dims))
    for c, triangle in enumerate(packed.reshape(k, -1)):
        spread[c][upper] = triangle
        spread[c] += np.triu(spread[c], 1).T
    return size, means, spread / size[:, None, None] - means[:, :, None] * means[:, None, :], float(flat[0])


def _stepped(
    ready: DataFrame, count: int, mid: np.ndarray, k: int, rows: int, shares: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
) -> tuple[Mixture, float]:
    """The mixture that these shares give, relative to `mid`, and the log likelihood that `shares` tells."""
    size, means, spread, likelihood = _moments(ready, count, mid, k, shares)
    return Mixture(size / size.sum(), means, spread + COVARIANCE_FLOOR * np.eye(len(mid)), math.nan, rows), likelihood


def mixture_step(points: DataFrame, model: Mixture, key: str) -> Mixture:
    """One step of expectation maximization; `likelihood` is that of the given parameters. One job."""
    mid = model.means.mean(axis=0)
    density = log_density(replace(model, means=model.means - mid))
    ready, count = prepared(points, key, model.rows), partitions(model.rows)
    new, likelihood = _stepped(ready, count, mid, len(model.weights), model.rows, lambda x: _responsibilities(x, density))
    return replace(new, means=new.means + mid, likelihood=likelihood)


def mixture_of(points: DataFrame, clusters: DataFrame, key: str) -> Mixture:
    """The mixture whose components are the clusters(key, cluster), numbered from 0 on; without a likelihood. One job, after
    the rows were counted."""
    numbered = points.join(clusters.select(key, "cluster"), key)
    tagged = numbered.select(key, F.array_append("features", F.col("cluster").cast("double")).alias("features"))
    facts = tagged.agg(F.count(F.lit(1)).alias("n"), F.max(F.element_at("features", -1)).alias("last"), F.max(F.size("features")).alias("width")).first()
    rows, k = facts["n"], int(facts["last"]) + 1

    def own(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (x[:, -1:] == np.arange(k)[None, :]).astype("float64"), np.zeros(len(x))

    ready = prepared(tagged, key, rows)
    new, _ = _stepped(ready, partitions(rows), np.zeros(facts["width"]), k, rows, own)
    return replace(new, means=new.means[:, :-1], covariances=new.covariances[:, :-1, :-1])


def fit_mixture(
    points: DataFrame, k: int, key: str, rows: int, seed: int = SEED, max_iter: int = GMM_ITERATIONS
) -> Mixture:
    """Expectation maximization from a k-means clustering. One job per iteration adds weights, sums and products per
    component over all rows; the driver holds k matrices of dims x dims. COVARIANCE_FLOOR on the diagonal keeps
    covariances of few rows regular."""
    ready = prepared(points, key, rows).persist()
    try:
        _, start = fit_runs(points, key, [k], rows, seed, restarts=1)[k]
        mid = start.mean(axis=0)
        count = partitions(rows)

        def hard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own, distance = nearest(x, start - mid)
            return (own[:, None] == np.arange(k)[None, :]).astype("float64"), -distance

        model, _ = _stepped(ready, count, mid, k, rows, hard)
        before = -math.inf
        for _ in range(max_iter + 1):
            density = log_density(model)
            new, likelihood = _stepped(ready, count, mid, k, rows, lambda x: _responsibilities(x, density))
            model = replace(model, likelihood=likelihood)
            if abs(likelihood - before) / rows < GMM_TOLERANCE:
                break
            model, before = replace(new, likelihood=likelihood), likelihood
        else:
            # The last parameters have not been looked at.
            density = log_density(model)
            _, likelihood = _stepped(ready, count, mid, k, rows, lambda x: _responsibilities(x, density))
            model = replace(model, likelihood=likelihood)
    finally:
        ready.unpersist()
    order = np.lexsort(model.means.T[::-1])
    return replace(
        model, weights=model.weights[order], means=model.means[order] + mid, covariances=model.covariances[order]
    )


def mixture_shares(points: DataFrame, model: Mixture, key: str) -> DataFrame:
    """(key, cluster, shares, likelihood): the component with the largest share, all shares, and the row's log
    likelihood."""

    density = log_density(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, likelihood = _responsibilities(feature_rows(batch), density)
            columns = [batch.column(key), pa.array(r.argmax(axis=1)), pa.array(r.tolist(), pa.list_(pa.float64())), pa.array(likelihood)]
            yield pa.RecordBatch.from_arrays(columns, [key, "cluster", "shares", "likelihood"])

    kind = points.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, cluster bigint, shares array<double>, likelihood double"
    return points.select(key, "features").mapInArrow(assign, schema)


def gaussian_mixture(
    points: DataFrame,
    k: int,
    key: str,
    seed: int = SEED,
    max_iter: int = GMM_ITERATIONS,
    rows: int | None = None,
) -> tuple[DataFrame, float, Mixture]:
    """(clusters(k, key, cluster), BIC, parameters) of a mixture with full covariances."""
    rows = points.count() if rows is None else rows
    if k > rows:
        raise ValueError(f"{k} components from {rows} samples")
    model = fit_mixture(points, k, key, rows, seed, max_iter)
    clusters = mixture_shares(points, model, key).select(F.lit(k).cast("bigint").alias("k"), key, "cluster")
    return clusters, model.bic, model


def cluster_label_join(clusters: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds the label a (k, cluster) was mapped to."""
    return clusters.join(mapping.select("k", "cluster", "label"), ["k", "cluster"])


def cluster_lookup(chosen: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Adds each sample's cluster in the clustering its row chose by `k`. A sample that has none,
    because its k could not be fitted, is an error when the row is read, never left out."""
    own = clusters.select(F.col("k").alias("__k"), F.col(key).alias("__key"), "cluster")
    found = chosen.join(own, (F.col("k") == F.col("__k")) & (F.col(key) == F.col("__key")), "left")
    lost = F.concat(F.lit("no cluster of "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    message = F.concat(lost, F.lit(" for cluster count "), F.coalesce(F.col("k").cast("string"), F.lit("null")))
    cluster = F.when(F.col("cluster").isNull(), F.raise_error(message).cast("bigint")).otherwise(F.col("cluster"))
    return found.withColumn("cluster", cluster).drop("__k", "__key")


def default_label(cluster: Column) -> Column:
    return F.when(cluster == 0, "positive").otherwise("negative")


def cluster_and_evaluate(
    points: DataFrame, k: int, key: str, method: str = "kmeans"
) -> tuple[DataFrame, DataFrame]:
    """One row (method, k, n, fit, silhouette), `fit` being the inertia or the BIC, and the clusters(k, key, cluster)."""
    from markerloom.operators.silhouette import silhouette

    rows = points.count()
    if method == "kmeans":
        clusters, fit, _ = kmeans(points, k, key, rows=rows)
    elif method == "gmm":
        clusters, fit, _ = gaussian_mixture(points, k, key, rows=rows)
    else:
        raise ValueError(f"unknown clustering method: {method}")
    report = silhouette(points, clusters, key).select(
        F.lit(method).alias("method"),
        "k",
        F.lit(rows).cast("bigint").alias("n"),
        F.lit(fit).alias("fit"),
        "silhouette",
    )
    return report, clusters
