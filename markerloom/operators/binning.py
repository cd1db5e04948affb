"""Bins per feature and the integer state they add up to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.functions.ordered import DIRECT_LIMIT, exact_quantiles
from markerloom.functions.scalars import INF, NAN
from markerloom.operators.summaries import to_long

# Edges of a feature without configured ones, and the radix of a
# bin without a given one.
DEFAULT_EDGES = (0.0, 0.5, 1.0, 2.0, 3.0, INF)
DEFAULT_BASE = 4
QUINTILES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
TIE_STEP = 1e-6

Edges = Mapping[str, Sequence[float]]


def edges_of(bins: Edges, feature: str) -> Sequence[float]:
    return bins.get(feature, DEFAULT_EDGES)


def base_of(bins: Edges, feature: str) -> int:
    return max(len(edges_of(bins, feature)) - 1, 1)


def digitize(x: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges at or below x. NaN compares greatest: top bin."""
    value = F.coalesce(x.cast("double"), F.lit(NAN))
    if len(edges) <= 2:
        return F.lit(0).cast("bigint")
    passed = [F.when(value >= F.lit(float(t)), 1).otherwise(0) for t in edges[1:-1]]
    return reduce(lambda a, b: a + b, passed).cast("bigint")


def digitize_by(x: Column, edges: Column) -> Column:
    """`digitize` with the edges in an array column."""
    value = F.coalesce(x.cast("double"), F.lit(NAN))
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda t: value >= t)).cast("bigint")


def with_default_edges(features: DataFrame, bins: DataFrame) -> DataFrame:
    """(feature, edges) for every feature; those without edges get the default."""
    default = F.array(*[F.lit(e) for e in DEFAULT_EDGES])
    return features.join(bins, "feature", "left").withColumn("edges", F.coalesce("edges", default))


def discretize(df: DataFrame, bins: Edges, features: Sequence[str]) -> DataFrame:
    """Adds <feature>_bin for the features the table has."""
    if not features:
        raise ValueError("no features to discretize")
    present = [f for f in features if f in df.columns]
    return df.withColumns({f"{f}_bin": digitize(F.col(f), edges_of(bins, f)) for f in present})


def encode_state(bins: Sequence[Column], bases: Sequence[int] | None = None) -> Column:
    """Mixed-radix number of the bins, first feature most significant."""
    if not bins:
        raise ValueError("no bins to encode")
    bases = [DEFAULT_BASE] * len(bins) if bases is None else bases
    if len(bases) != len(bins):
        raise ValueError("as many bases as bins are needed")
    state = F.lit(0).cast("bigint")
    for b, base in zip(bins, bases):
        state = state * F.lit(max(int(base), 1)) + b
    return state.cast("bigint")


def decode_state(state: Column, bases: Sequence[int]) -> list[Column]:
    """The bins a state was encoded from."""
    out, rest = [], state.cast("bigint")
    for base in reversed(bases):
        base = max(int(base), 1)
        out.append(F.pmod(rest, F.lit(base)).cast("bigint"))
        rest = F.floor(rest / F.lit(base)).cast("bigint")
    return out[::-1]


def state_column(columns: Sequence[str], bins: Edges, features: Sequence[str]) -> Column:
    """State from the <feature>_bin columns; an absent one counts as bin 0."""
    if not features:
        raise ValueError("no features to encode")
    parts, bases = [], []
    for f in features:
        base = base_of(bins, f)
        bin_ = F.col(f"{f}_bin") if f"{f}_bin" in columns else F.lit(0)
        parts.append(F.greatest(F.lit(0), F.least(F.lit(base - 1), bin_)))
        bases.append(base)
    return encode_state(parts, bases)


def state_from_bins(df: DataFrame, bins: Edges, features: Sequence[str]) -> DataFrame:
    return df.withColumn("state", state_column(df.columns, bins, features))


def state_count(bins: Edges, features: Sequence[str]) -> int:
    if not 2 <= len(features) <= 3:
        raise ValueError(f"2 or 3 state features are needed, not {list(features)}")
    return reduce(lambda n, f: n * base_of(bins, f), features, 1)


def state_space(bins: DataFrame) -> DataFrame:
    """(n_features, n_states) of a bins(feature, edges) table."""
    bases = F.collect_list(F.greatest(F.size("edges") - 1, F.lit(1)).cast("bigint"))
    product = F.aggregate(bases, F.lit(1).cast("bigint"), lambda p, b: p * b)
    return bins.agg(F.count(F.lit(1)).alias("n_features"), product.alias("n_states"))


def state_coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("state").alias("n_states"))


def edge_text(x: Column) -> Column:
    return F.when(x == F.lit(INF), "inf").otherwise(x.cast("string"))


def range_text(lo: Column, hi: Column) -> Column:
    return F.concat(F.lit("["), edge_text(lo), F.lit(", "), edge_text(hi), F.lit(")"))


def bin_catalog(bins: DataFrame) -> DataFrame:
    """(feature, bin, lo, hi, text) of a bins(feature, edges) table."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("edges") - 1),
        lambda i: F.struct(
            (i - 1).cast("bigint").alias("bin"),
            F.element_at("edges", i).alias("lo"),
            F.element_at("edges", i + 1).alias("hi"),
        ),
    )
    rows = bins.where(F.size("edges") > 1).select("feature", F.inline(pairs))
    return rows.withColumn("text", range_text(F.col("lo"), F.col("hi")))


def describe_bins(df: DataFrame, bins: Edges, features: Sequence[str]) -> DataFrame:
    """Adds `text`: the ranges of a row's bins; bins out of range are left out."""
    parts = []
    for f in features:
        edges = edges_of(bins, f)
        for i in range(len(edges) - 1):
            rng = range_text(F.lit(float(edges[i])), F.lit(float(edges[i + 1])))
            parts.append(F.when(F.col(f"{f}_bin") == i, F.concat(F.lit(f"{f}: "), rng)))
    return df.withColumn("text", F.concat_ws(" | ", *parts))


def bin_statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, bin, n, share) of the <feature>_bin columns present."""
    columns = [f"{f}_bin" for f in features if f"{f}_bin" in df.columns]
    long = to_long(df, [], columns).withColumnsRenamed({"marker": "feature", "value": "bin"})
    counts = long.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    return counts.join(totals, "feature").select(
        F.regexp_replace("feature", "_bin$", "").alias("feature"),
        "bin",
        "n",
        (F.col("n") / F.col("total")).alias("share"),
    )


def separate_ties(edges: Column) -> Column:
    """Left to right, an edge not above the one before becomes that one + 1e-6."""
    def step(done: Column, e: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        return F.concat(done, F.array(F.when(e <= last, last + F.lit(TIE_STEP)).otherwise(e)))

    return F.aggregate(edges, F.expr("cast(array() as array<double>)"), step)


def quantile_bins(
    values: DataFrame, direct_limit: int = DIRECT_LIMIT, biggest: int | None = None
) -> DataFrame:
    """(feature, edges): quintile edges per marker of values(marker, value)."""
    found = exact_quantiles(values, ["marker"], "value", QUINTILES, direct_limit, biggest)
    return found.select(F.col("marker").alias("feature"), separate_ties(F.col("q")).alias("edges"))


def bins_to_dict(bins: DataFrame) -> dict[str, list[float]]:
    """One short array per feature, brought to the driver as configuration."""
    return {r["feature"]: list(r["edges"]) for r in bins.collect()}
