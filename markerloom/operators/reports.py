"""Tables behind the training report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.functions.ordered import numbered
from markerloom.functions.scalars import finite
from markerloom.operators.markers import located_name
from markerloom.session import stored_small

# Widest averaging window and bars of a histogram.
MAX_WINDOW = 50
BARS = 50
# Rows of a log that one task averages.
STRETCH = 4096


def moving_average(log: DataFrame, value: str, by: str = "phase", order: str = "iteration") -> DataFrame:
    """Adds moving_average over min(50, n // 10) rows of a training log, null on the
    first rows and for windows of one. `order` is an integer, unique within `by`.

    The rows of a group are numbered and cut into stretches; each stretch also gets the last rows of the one before,
    so the windows of a long log run in as many tasks as it has stretches.
    """
    rows = numbered(log, by, order, "position")
    stretch = F.floor((F.col("position") - 1) / F.lit(STRETCH))
    ends = (F.col("position") - 1) % STRETCH >= STRETCH - MAX_WINDOW
    copies = F.when(ends, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    dealt = rows.withColumn("__own", stretch).withColumn("__stretch", F.explode(copies))
    inside = W.partitionBy(by, "__stretch").orderBy("position")
    out = F.lit(None).cast("double")
    # One number per group.
    for r in log.groupBy(by).count().collect():
        w = min(MAX_WINDOW, r["count"] // 10)
        if w > 1:
            mean = F.avg(value).over(inside.rowsBetween(1 - w, 0))
            out = F.when(F.col(by).eqNullSafe(F.lit(r[by])) & (F.col("position") >= w), mean).otherwise(out)
    averaged = dealt.withColumn("moving_average", out).where("__own = __stretch")
    return averaged.drop("position", "__own", "__stretch")


def learning_curve(log: DataFrame) -> DataFrame:
    return moving_average(log, "cumulative_payoff").select(
        "phase", "iteration", "cumulative_payoff", "average_payoff", "moving_average"
    )


def q_heatmap(q: DataFrame, min_k: int, max_k: int) -> DataFrame:
    """(state, k2..kN): the Q-table as a matrix."""
    cells = {k: F.when(F.col("action") == k - min_k, F.col("q")) for k in range(min_k, max_k + 1)}
    return q.groupBy("state").agg(
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(f"k{k}") for k, c in cells.items()]
    )


def feature_histogram(values: DataFrame, bars: int = BARS) -> DataFrame:
    """(marker, bar, lo, hi, n): equal-width bars from least to greatest finite value
    of values(marker, value), the last one closed; equal values get +-0.5."""
    clean = values.select("marker", finite(F.col("value").cast("double")).alias("x")).dropna()
    span = clean.groupBy("marker").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = stored_small(
        span.select(
            "marker",
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bars))
    bar = F.least(F.lit(bars - 1), F.floor((F.col("x") - F.col("lo")) / width)).cast("bigint")
    counts = clean.join(span, "marker").groupBy("marker", bar.alias("bar")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.withColumn("bar", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bars - 1).cast("bigint"))))
    return grid.join(counts, ["marker", "bar"], "left").select(
        "marker",
        "bar",
        (F.col("lo") + F.col("bar") * width).alias("lo"),
        (F.col("lo") + (F.col("bar") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def inner_edges(bins: DataFrame) -> DataFrame:
    """(feature, edge): the finite edges between the first and the last one."""
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    edges = bins.select("feature", F.explode(inner).alias("edge"))
    return edges.where(F.col("edge") < F.lit(float("inf")))


def cluster_scatter(summary: DataFrame, clusters: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, k, x, y, cluster) for two features looked up by containment."""
    names = [c for c in summary.columns if c != key]
    points = summary.select(
        key, F.col(located_name(names, x)).alias("x"), F.col(located_name(names, y)).alias("y")
    )
    return clusters.select("k", key, "cluster").join(points, key)


def _last(value: str, phase: int) -> Column:
    here = F.col("phase") == phase
    return F.max_by(F.when(here, F.col(value)), F.when(here, F.col("iteration")))


def summary_report(log: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: iterations and last mean payoff per phase, Q-table coverage and values."""
    phases = log.agg(
        F.count_if(F.col("phase") == 1).alias("phase1_iterations"),
        _last("average_payoff", 1).alias("phase1_average_payoff"),
        F.count_if(F.col("phase") == 2).alias("phase2_iterations"),
        _last("average_payoff", 2).alias("phase2_average_payoff"),
    )
    one = stats.select(F.struct("state_coverage", "mean_q", "max_q")).scalar()
    return phases.withColumn("__stats", one).select(
        *phases.columns, *[F.col(f"__stats.{c}").alias(c) for c in ("state_coverage", "mean_q", "max_q")]
    )
