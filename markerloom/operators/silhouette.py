"""Exact Euclidean silhouette, for all cluster counts of a sweep at once.

The mean distance to every cluster needs every distance once. Rows are hashed into the points of a finite projective
plane, and each of its lines is one task-sized group: any two points lie on exactly one line, so every pair of blocks meets
in one group, while a row is sent to the p + 1 lines of its point only, about the root of the number of blocks. A group
computes its distances as matrices, adds them up per row and cluster, and emits only those sums.
Distances do not depend on k, so one pass serves all clusterings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows per block. Blocks grow with the matrix once there are enough groups to keep a cluster busy, until a
# group has LARGEST_GROUP rows; from there on the plane grows.
BLOCK_ROWS = 256
BUSY_ORDER = 11
LARGEST_GROUP = 131_072
# Distances held at a time: 2 MB, about a core's cache.
STRIP_CELLS = 262_144


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def plane_order(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """The order p of a plane of p * p + p + 1 blocks: a prime, 1 for a triangle, or 0 for a single block."""
    blocks = -(-rows // block_rows)
    if blocks <= 1:
        return 0
    p = 1
    while p * p + p + 1 < blocks and p < BUSY_ORDER or (p + 1) * rows > LARGEST_GROUP * (p * p + p + 1):
        p += 1
        while not _prime(p):
            p += 1
    return p


def lines_of(block: Column, p: int) -> Column:
    """The lines through a point of the plane, p + 1 of its p * p + p + 1; the last one is the point's home.

    Points are the pairs (x, y), numbered x * p + y, then the slopes m, then the vertical direction. Lines are
    y = m * x + b, numbered m * p + b, then the verticals by x, then the one of all directions.
    """
    if p == 0:
        return F.array(F.lit(0))
    zero, last = F.lit(0), F.lit(p - 1)
    # `sequence` counts down from 0 to -1, but p is 1 at least.
    each = F.sequence(zero, last)
    x, y = F.floor(block / p).cast("int"), F.pmod(block, F.lit(p)).cast("int")
    through = F.transform(each, lambda m: m * p + F.pmod(y - m * x, F.lit(p)))
    far = F.array(F.lit(p * p + p))
    return (
        F.when(block < p * p, F.concat(through, F.array(F.lit(p * p) + x)))
        .when(block < p * p + p, F.concat(F.transform(each, lambda b: (block - p * p) * p + b), far))
        .otherwise(F.concat(F.transform(each, lambda c: F.lit(p * p) + c), far))
    )


def _block_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; near-coincident rows are recomputed by difference."""
    mid = a.mean(axis=0)
    a, b = a - mid, b - mid
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    # Squares and products by one matrix product.
    d2 = np.hstack([-2.0 * a, na[:, None], np.ones((len(a), 1))]) @ np.hstack([b, np.ones((len(b), 1)), nb[:, None]]).T
    # Whether any rows can be near is seen from one number.
    if d2.size and not d2.min() > 1e-4 * (na.max() + nb.max()):
        i, j = np.nonzero(d2 <= 1e-4 * (na[:, None] + nb[None, :]))
        for s in range(0, len(i), 65536):
            p, q = i[s : s + 65536], j[s : s + 65536]
            d2[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1)
    return np.sqrt(d2, out=d2)


def _members(labels: pd.Series, groups: int) -> np.ndarray:
    """One row per row and one column per group; -1 stands for no group."""
    own = np.stack(labels.to_list())
    hot = np.zeros((len(own), groups + 1))
    hot[np.repeat(np.arange(len(own)), own.shape[1]), own.ravel()] = 1.0
    return hot[:, :groups]


class _Sweep:
    """Clusterings with their (k, cluster) pairs numbered 0..groups-1, k ascending."""

    def __init__(self, clusters: DataFrame, key: str):
        # At most the sum of all k, a few dozen rows.
        rows = clusters.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n")).collect()
        if not rows:
            raise ValueError("no clusterings to score")
        self.key = key
        self.sizes = sorted((r["k"], r["cluster"], r["n"]) for r in rows)
        self.ks = sorted({k for k, _, _ in self.sizes})
        number = [x for g, (k, c, _) in enumerate(self.sizes) for x in (F.lit(f"{k}/{c}"), F.lit(g))]
        own = F.create_map(*number)[F.concat_ws("/", "k", "cluster")]
        # One entry per k, -1 where the row has no cluster for it.
        each = [F.coalesce(F.max(F.when(F.col("k") == k, F.col("own"))), F.lit(-1)) for k in self.ks]
        self.labels = (
            clusters.select(key, "k", own.alias("own")).groupBy(key).agg(F.array(*each).alias("own"))
        )

    def rows_of(self, k) -> int:
        return sum(n for kk, _, n in self.sizes if kk == k)

    def groups_of(self, k) -> list[int]:
        return [g for g, (kk, _, _) in enumerate(self.sizes) if kk == k]

    def size_column(self) -> Column:
        return F.array(*[F.lit(float(n)) for _, _, n in self.sizes])


def _distance_sums(points: DataFrame, sweep: _Sweep, block_rows: int) -> DataFrame:
    """(key, own, s): the groups of each row and its summed distances to all groups."""
    key, groups = sweep.key, len(sweep.sizes)
    p = plane_order(max(sweep.rows_of(k) for k in sweep.ks), block_rows)
    block = F.pmod(F.xxhash64(key), F.lit(p * p + p + 1)).cast("int")
    tagged = points.join(sweep.labels, key).select(F.col(key).alias("id"), "features", "own", block.alias("b"))
    # Distances within a block are its home's.
    placed = tagged.withColumn("lines", lines_of(F.col("b"), p))
    placed = placed.select("id", "features", "own", "b", F.element_at("lines", -1).alias("home"), F.explode("lines").alias("line"))

    def sums_of(pdf: pd.DataFrame) -> pd.DataFrame:
        x, hot = np.stack(pdf["features"].to_list()), _members(pdf["own"], groups)
        block, sums = pdf["b"].to_numpy(), np.zeros((len(pdf), groups))
        home = (pdf["home"] == pdf["line"]).to_numpy()
        blocks = [np.flatnonzero(block == b) for b in np.unique(block)]
        for n, one in enumerate(blocks):
            for other in blocks[n + (0 if home[one[0]] else 1) :]:
                # Strips of both sides, so that they fit whatever the blocks' sizes.
                wide = max(1, min(len(other), int(STRIP_CELLS**0.5)))
                strip = max(1, STRIP_CELLS // wide)
                for c in range(0, len(other), wide):
                    columns = other[c : c + wide]
                    for a in range(0, len(one), strip):
                        rows = one[a : a + strip]
                        d = _block_distances(x[rows], x[columns])
                        sums[rows] += d @ hot[columns]
                        if other is not one:
                            sums[columns] += d.T @ hot[rows]
        return pdf[["id", "own"]].assign(s=list(sums))

    id_type = points.schema[key].dataType.simpleString()
    return (
        placed.groupBy("line")
        .applyInPandas(sums_of, f"id {id_type}, own array<int>, s array<double>")
        .groupBy(F.col("id").alias(key))
        .agg(
            F.first("own").alias("own"),
            vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"),
        )
        .withColumn("n", sweep.size_column())
    )


def distance_sums(points: DataFrame, clusters: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The summed distances of each row to every cluster, the one pass over all pairs, for both functions below: a caller of both stores
    them and hands them on."""
    return _distance_sums(points, _Sweep(clusters, key), block_rows)


def cluster_distances(
    points: DataFrame, clusters: DataFrame, key: str, block_rows: int = BLOCK_ROWS, sums: DataFrame | None = None
) -> DataFrame:
    """(k, key, cluster, n, mean_distance): mean distance of each row to the members
    of each cluster; the row itself does not count in its own cluster. `sums` are the distance_sums of the same rows and clusters."""
    sweep = _Sweep(clusters, key)
    groups = F.array(
        *[
            F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(c).cast("bigint").alias("cluster"))
            for k, c, _ in sweep.sizes
        ]
    )

    def cell(group: Column, g: Column) -> Column:
        others = F.get("n", g) - F.when(F.array_contains("own", g), 1.0).otherwise(0.0)
        return F.struct(
            group["k"].alias("k"),
            group["cluster"].alias("cluster"),
            others.cast("bigint").alias("n"),
            F.when(others > 0, F.get("s", g) / others).alias("mean_distance"),
        )

    sums = _distance_sums(points, sweep, block_rows) if sums is None else sums
    return sums.select(key, F.inline(F.transform(groups, cell)))


def silhouette(
    points: DataFrame, clusters: DataFrame, key: str, block_rows: int = BLOCK_ROWS, sums: DataFrame | None = None
) -> DataFrame:
    """(k, silhouette): mean over all rows that have a cluster for this k; 0 with fewer than two clusters
    or no more such rows than clusters. Rows alone in their cluster score 0. `sums` are the distance_sums of the same rows and clusters."""
    sweep = _Sweep(clusters, key)
    runs = F.array(
        *[
            F.struct(
                F.lit(k).cast("bigint").alias("k"),
                F.array(*[F.lit(g) for g in groups]).alias("groups"),
                F.lit(1 < len(groups) < sweep.rows_of(k)).alias("defined"),
            )
            for k, groups in ((k, sweep.groups_of(k)) for k in sweep.ks)
        ]
    )

    def pair(run: Column, i: Column) -> Column:
        own = F.get("own", i)
        n = F.get("n", own)
        member = own >= 0
        inside = F.when(n > 1, F.get("s", own) / (n - 1))
        others = F.filter(run["groups"], lambda g: g != own)
        near = F.array_min(F.transform(others, lambda g: F.get("s", g) / F.get("n", g)))
        return F.struct(
            run["k"].alias("k"),
            run["defined"].alias("defined"),
            member.alias("member"),
            inside.alias("a"),
            near.alias("b"),
        )

    sums = _distance_sums(points, sweep, block_rows) if sums is None else sums
    top = F.greatest("a", "b")
    width = F.when(F.col("a").isNull() | F.col("b").isNull() | ~F.col("defined") | (top == 0), 0.0)
    return (
        sums.select(F.inline(F.transform(runs, pair)))
        .where("member")
        .groupBy("k")
        .agg(F.avg(width.otherwise((F.col("b") - F.col("a")) / top)).alias("silhouette"))
    )
