"""k-means over a sweep of cluster counts and restarts, all runs in step.

A sweep is ks x restarts fits of one matrix. Fitted one after the other, each would
read the matrix once per iteration. Here one job per iteration advances every run
that has not converged: tasks assign their rows to the centers of all runs and emit
sums per center, which Spark adds up. The driver holds the centers only, at most
sum(ks) x restarts of them.

Starts come from oversampled parallel seeding (Bahmani et al. 2012), for all runs in step: a few jobs draw candidates, one more counts
the rows of each, and the driver picks the starts among the weighted candidates, of which there are a few for each center.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Seed, limits and tolerance of the fits.
SEED = 42
MAX_ITERATIONS = 300
RESTARTS = 10
TOLERANCE = 1e-4

# Rows per partition of the matrix once there are enough partitions to keep a small cluster busy, and of
# fewer rows before. Up to FEW_PARTITIONS send their sums to the driver: 64 times a few hundred centers.
PARTITION_ROWS = 20_000
BUSY_PARTITIONS, LEAST_ROWS = 32, 2_000
FEW_PARTITIONS = 64
# Rows that are held against the centers of all runs at a time, so that the distances stay in a core's cache.
STRIP_ROWS = 512

# Seeding: jobs that draw candidates, candidates of each for a center, and updates on the candidates.
ROUNDS, OVERSAMPLE, CANDIDATE_ITERATIONS = 3, 3, 50

Run = tuple[int, int]  # (k, restart)


def feature_rows(batch: pa.RecordBatch) -> np.ndarray:
    rows = batch.column("features")
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return np.maximum(d, 0.0)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest center of each row, the first of equals, and the squared distance.

    The expanded form rounds, and differently for batches of other shapes; rows whose best two
    are close are compared again by difference.
    """
    own = nearest_index(x, c, squared_distances(x, c))
    return own, ((x - c[own]) ** 2).sum(axis=1)


def nearest_index(x: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The index of `nearest` from the expanded squared distances."""
    own = d.argmin(axis=1)
    best = d[np.arange(len(x)), own]
    scale = 1e-9 * ((x * x).sum(axis=1) + (c * c).sum(axis=1).max(initial=0.0) + 1.0)
    close = np.flatnonzero((d <= (best + scale)[:, None]).sum(axis=1) > 1)
    for s in range(0, len(close), 1024):
        rows = close[s : s + 1024]
        exact = ((x[rows][:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        own[rows] = exact.argmin(axis=1)
    return own


def nearest_marks(x: np.ndarray, c: np.ndarray, d: np.ndarray, k: int, out: np.ndarray) -> None:
    """Writes 1 into `out` where a center is the nearest of its run to a row, as `nearest` has it, and 0 elsewhere.

    `c` has the k centers of each of some runs, `d` a row of expanded squared distances for each, with or without the rows' own squares.
    """
    runs = len(c) // k
    d, marks = d.reshape(runs, k, len(x)), out.reshape(runs, k, len(x))
    scale = 1e-9 * ((x * x).sum(axis=1)[None, :] + (c * c).sum(axis=1).reshape(runs, k).max(axis=1)[:, None] + 1.0)
    marks[...] = d <= (d.min(axis=1) + scale)[:, None, :]
    close = marks.sum(axis=1) > 1.0
    for run in np.flatnonzero(close.any(axis=1)).tolist():
        found, at = np.flatnonzero(close[run]), c[run * k : run * k + k]
        for s in range(0, len(found), 1024):
            rows = found[s : s + 1024]
            exact = ((x[rows][:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
            marks[run][:, rows] = exact.argmin(axis=1)[None, :] == np.arange(k)[:, None]


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys and a salt (splitmix64 finalizer)."""
    z = keys + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype("float64") + 0.5) / 2.0**53


def _draws(keys: np.ndarray, seed: int, run: Run, turn: int) -> np.ndarray:
    return _uniform(keys, seed * 1_000_003 + run[0] * 10_007 + run[1] * 101 + turn)


def _times(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Exponential times at these rates: the earliest are a draw in proportion to the rates, without replacement. Rates of 0
    come last, in the order of their draws."""
    return np.where(rate > 1e-12, -np.log(u) / np.maximum(rate, 1e-12), 1e300 * (1.0 + u))


def candidates(points: DataFrame, runs: Sequence[Run], seed: int, mean: np.ndarray) -> dict[Run, np.ndarray]:
    """A row, and then ROUNDS times OVERSAMPLE rows for each center, drawn in proportion to the squared distance to the nearest
    candidate so far; one job a round. The draws are keyed by row, so no partitioning changes them."""
    found = {r: np.empty((0, len(mean))) for r in runs}
    for turn in range(ROUNDS + 1):

        def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, float, bytes]] = []
            for batch in batches:
                x = feature_rows(batch) - mean
                keys = batch.column("h").to_numpy(zero_copy_only=False).view("uint64")
                for i, (run, c) in enumerate(found.items()):
                    rate = np.ones(len(x)) if turn == 0 else squared_distances(x, c).min(axis=1)
                    time = _times(_draws(keys, seed, run, turn), rate)
                    wanted = 1 if turn == 0 else OVERSAMPLE * run[0]
                    for j in np.argsort(time, kind="stable")[:wanted].tolist():
                        held.append((i, float(time[j]), x[j].tobytes()))
            runs_, times, rows = zip(*held) if held else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs_, pa.int64()), pa.array(times, pa.float64()), pa.array(rows, pa.binary())], names=["run", "time", "row"]
            )

        drawn = points.mapInArrow(race, "run bigint, time double, row binary")
        # The limit of each run applies before the shuffle, too.
        place = F.row_number().over(W.partitionBy("run").orderBy("time", "row"))
        most = 1 if turn == 0 else OVERSAMPLE * max(k for k, _ in runs)
        drawn = drawn.withColumn("place", place).where(F.col("place") <= most)
        order = list(found)
        for r in sorted(drawn.collect(), key=lambda r: (r["run"], r["place"])):
            run = order[r["run"]]
            if turn == 0 or r["place"] <= OVERSAMPLE * run[0]:
                found[run] = np.vstack([found[run], np.frombuffer(r["row"])])
    return found


def _weighted_starts(c: np.ndarray, weight: np.ndarray, run: Run, seed: int) -> np.ndarray:
    """k-means++ and updates on weighted candidates."""
    k = run[0]
    keys = np.arange(len(c), dtype="uint64")
    at: list[int] = []
    for turn in range(k):
        rate = weight.astype("float64")
        if at:
            rate = rate * squared_distances(c, c[at]).min(axis=1)
            rate[at] = 0.0
        time = _times(_draws(keys, seed, run, ROUNDS + 1 + turn), rate)
        time[at] = np.inf
        at.append(int(time.argmin()))
    now = c[at]
    for _ in range(CANDIDATE_ITERATIONS):
        own = squared_distances(c, now).argmin(axis=1)
        share = (own[:, None] == np.arange(k)[None, :]) * weight[:, None].astype("float64")
        size = share.sum(axis=0)
        new = np.where(size[:, None] > 0, (share.T @ c) / np.maximum(size, 1.0)[:, None], now)
        if np.array_equal(new, now):
            break
        now = new
    return now


def spread_centers(points: DataFrame, runs: Iterable[Run], seed: int, mean: np.ndarray, count: int = 1) -> dict[Run, np.ndarray]:
    """Starts of all runs, in ROUNDS + 2 jobs, whatever the numbers of centers. `points` has `count` partitions."""
    found = candidates(points, list(runs), seed, mean)

    def weigh(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(squared_distances(x, c).argmin(axis=1), minlength=len(c)) for c in found.values()]).astype("float64")

    weights = vector_totals(points, weigh, sum(map(len, found.values())), count, mean)
    starts, at = {}, 0
    for run, c in found.items():
        starts[run] = _weighted_starts(c, weights[at : at + len(c)], run, seed)
        at += len(c)
    return starts


def vector_totals(
    points: DataFrame, fn: Callable[[np.ndarray], np.ndarray], width: int, count: int, mean: np.ndarray | float = 0.0
) -> np.ndarray:
    """The sum over all rows of fn(rows - mean), a vector of `width` numbers, of a matrix in `count` partitions.

    A task sends one vector. Those of many partitions are added in blocks of FEW_PARTITIONS until few are left, which the driver
    adds; all in the order of the partitions, so that the last bits are the same in every run.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += fn(feature_rows(batch) - mean)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"block": [part // FEW_PARTITIONS], "part": [part], "total": [total.tobytes()]})

    def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for batch in batches:
            for b, t in zip(batch.column("block").to_pylist(), batch.column("total").to_pylist()):
                if b != block and block is not None:
                    yield pa.RecordBatch.from_pydict({"block": [block // FEW_PARTITIONS], "part": [block], "total": [total.tobytes()]})
                if b != block:
                    block, total = b, np.zeros(width)
                total += np.frombuffer(t)
        if block is not None:
            yield pa.RecordBatch.from_pydict({"block": [block // FEW_PARTITIONS], "part": [block], "total": [total.tobytes()]})

    schema = "block bigint, part bigint, total binary"
    parts = points.mapInArrow(add_up, schema)
    while count > FEW_PARTITIONS:
        parts = parts.repartition("block").sortWithinPartitions("block", "part").mapInArrow(add_blocks, schema)
        count = -(-count // FEW_PARTITIONS)
    out = np.zeros(width)
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        out += np.frombuffer(r["total"])
    return out


def lloyd(
    points: DataFrame,
    centers: Mapping[Run, np.ndarray],
    max_iter: int,
    min_shift: float,
    mean: np.ndarray,
    count: int = 1,
) -> dict[Run, tuple[np.ndarray, float]]:
    """(centers, inertia) per run after at most max_iter updates. A run stops when its
    centers move by no more than min_shift in squares; empty clusters stay put. `points` has `count` partitions."""
    done: dict[Run, tuple[np.ndarray, float]] = {}
    now = {r: np.asarray(c, dtype="float64") for r, c in centers.items()}
    final: set[Run] = set() if max_iter > 0 else set(now)
    turn = 0
    while now:
        stacked = np.vstack(list(now.values()))
        ends = np.cumsum([len(c) for c in now.values()])
        spans = [(int(e) - len(c), int(e)) for e, c in zip(ends, now.values())]

        # Runs of as many centers that follow each other; costs count once a run has stopped.
        parts = [(k, list(part)) for k, part in groupby(spans, lambda s: s[1] - s[0])]
        alike = [(k, part[0][0], part[-1][1]) for k, part in parts]
        stopped = [s for s, r in zip(spans, now) if r in final]
        # Distances but for the rows' own squares, which change no order, by one product.
        weighed = np.hstack([-2.0 * stacked, (stacked * stacked).sum(axis=1)[:, None]])

        def sums(x: np.ndarray) -> np.ndarray:
            size, cost, total = np.zeros(len(stacked)), np.zeros(len(stacked)), np.zeros(stacked.shape)
            for s in range(0, len(x), STRIP_ROWS):
                rows = x[s : s + STRIP_ROWS]
                d = weighed @ np.hstack([rows, np.ones((len(rows), 1))]).T
                marks = np.empty(d.shape)
                for k, a, b in alike:
                    nearest_marks(rows, stacked[a:b], d[a:b], k, marks[a:b])
                for a, b in stopped:
                    own = marks[a:b].argmax(axis=0)
                    near = ((rows - stacked[a:b][own]) ** 2).sum(axis=1)
                    cost[a:b] += np.bincount(own, weights=near, minlength=b - a)
                size += marks.sum(axis=1)
                total += marks @ rows
            return np.concatenate([size, cost, total.ravel()])

        flat = vector_totals(points, sums, len(stacked) * (2 + stacked.shape[1]), count, mean)
        size, cost = flat[: len(stacked)], flat[len(stacked) : 2 * len(stacked)]
        total = flat[2 * len(stacked) :].reshape(stacked.shape)
        means = np.where(size[:, None] > 0, total / np.maximum(size, 1.0)[:, None], stacked)
        turn += 1
        moved: dict[Run, np.ndarray] = {}
        for run, (a, b) in zip(now, spans):
            if run in final:
                done[run] = (now[run], float(cost[a:b].sum()))
                continue
            new = means[a:b]
            # The last update is followed by one more pass, for the inertia.
            if ((new - now[run]) ** 2).sum() <= min_shift or turn >= max_iter:
                final.add(run)
            moved[run] = new
        now = moved
    return done


def partitions(rows: int) -> int:
    """Grows with the rows without a limit."""
    return max(1, min(BUSY_PARTITIONS, rows // LEAST_ROWS), rows // PARTITION_ROWS)


def prepared(points: DataFrame, key: str, rows: int) -> DataFrame:
    """The matrix with a hash of its key, in partitions that depend on the key only."""
    parts = partitions(rows)
    return points.select("features", F.xxhash64(key).alias("h")).repartition(parts, "h").sortWithinPartitions("h")


def centered(points: DataFrame, count: int = 1) -> tuple[np.ndarray, float]:
    """Mean per component, and the mean of their variances, of a matrix in `count` partitions."""
    width = len(points.select("features").first()["features"])

    def moments(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x), (x * x).sum()], x.sum(axis=0)])

    first = vector_totals(points, moments, width + 2, count)
    mean = first[2:] / first[0]
    return mean, float(vector_totals(points, moments, width + 2, count, mean)[1] / first[0] / width)


def fit_runs(
    points: DataFrame,
    key: str,
    ks: Sequence[int],
    rows: int,
    seed: int = SEED,
    max_iter: int = MAX_ITERATIONS,
    restarts: int = RESTARTS,
) -> dict[int, tuple[float, np.ndarray]]:
    """Per k the lowest inertia of all restarts and its centers, in lexicographic order."""
    ready = prepared(points, key, rows).persist()
    try:
        count = partitions(rows)
        mean, variance = centered(ready, count)
        starts = spread_centers(ready, [(k, r) for k in ks for r in range(restarts)], seed, mean, count)
        fits = lloyd(ready, starts, max_iter, TOLERANCE * variance, mean, count)
    finally:
        ready.unpersist()
    best: dict[int, tuple[float, np.ndarray]] = {}
    for (k, _), (c, cost) in sorted(fits.items(), key=lambda f: (f[0][0], f[1][1], f[0][1])):
        if k not in best:
            c = c + mean
            best[k] = (float(cost), c[np.lexsort(c.T[::-1])])
    return best


def centers_table(spark, centers: Mapping[int, np.ndarray]) -> DataFrame:
    """(k, cluster, center), sum(ks) rows."""
    rows = [(k, i, [float(v) for v in row]) for k, c in centers.items() for i, row in enumerate(c)]
    return spark.createDataFrame(rows, "k bigint, cluster bigint, center array<double>")
