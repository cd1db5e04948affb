"""One row per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.functions.ordered import DIRECT_LIMIT, exact_quantiles, split_frequent
from markerloom.functions.scalars import finite, label_from_name


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, marker, value) from one column per marker."""
    return df.unpivot(list(keys), list(columns), "marker", "value")


def sample_medians(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    direct_limit: int = DIRECT_LIMIT,
    biggest: int | None = None,
    names: Sequence[str] = (),
    sums: bool = False,
) -> DataFrame:
    """(keys, names, medians, and with `sums` n, s_<column> and g_<column>, the finite values' sum and the number of gaps): per key the exact median of the finite values; 0 if there
    are values but none is finite; null if the column holds nulls only, as for a
    marker the sample does not have. `names` are columns that follow from the keys. Keys with more than `direct_limit` values
    are counted, the others go through `median`, each row on one of the two ways."""
    if biggest is None and keys:
        few, many, top = split_frequent(df, keys, direct_limit // max(1, len(columns)))
        if few is not None and many is not None:
            sides = [sample_medians(t, keys, columns, direct_limit, n, names, sums) for t, n in ((few, 0), (many, top))]
            return sides[0].unionByName(sides[1])
        biggest = top
    elif biggest is None:
        biggest = df.count()
    good = df.select(
        *keys,
        *names,
        *[finite(F.col(c)).alias(c) for c in columns],
        *[F.col(c).isNotNull().alias(f"__{c}") for c in columns],
    )
    seen = [F.max(f"__{c}").alias(f"__{c}") for c in columns]
    carried = [F.first(n).alias(n) for n in names]
    more = []
    if sums:
        carried.append(F.count(F.lit(1)).alias("n"))
        for c in columns:
            carried += [F.sum(c).alias(f"s_{c}"), F.count_if(F.col(c).isNull()).alias(f"g_{c}")]
            more += [f"s_{c}", f"g_{c}"]
        more.append("n")
    if biggest * len(columns) <= direct_limit:
        out = good.groupBy(*keys).agg(*carried, *seen, *[F.median(c).alias(c) for c in columns])
    else:
        long = to_long(good.select(*keys, *columns), keys, columns)
        found = exact_quantiles(long, [*keys, "marker"], "value", [0.5], direct_limit, biggest)
        middle = F.col("q")[0]
        wide = found.groupBy(*keys).agg(
            *[F.max(F.when(F.col("marker") == c, middle)).alias(c) for c in columns]
        )
        # Keys without any finite value have no quantile but keep their row.
        every = good.groupBy(*keys).agg(*carried, *seen).alias("a")
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        out = every.join(wide.alias("b"), cond, "left").select("a.*", *[f"b.{c}" for c in columns])
    filled = [F.when(F.col(f"__{c}"), F.coalesce(c, F.lit(0.0))).alias(c) for c in columns]
    return out.select(*keys, *names, *more, *filled)


def summarize(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    method: str = "median",
    name: str | None = None,
    direct_limit: int = DIRECT_LIMIT,
    biggest: int | None = None,
) -> DataFrame:
    """Per-sample medians, means or all rows of the cells, with the label the `name`
    column gives. The name follows from the keys and is not grouped by.

    Cleaning fills a sample's gaps with its own median, or 0 if it has none, and
    leaves markers the sample does not have null. A median does not move when copies of it are added, and a mean moves by a known
    amount, so both come from the finite values without filling row by row.
    """
    if method == "all":
        return df.select(*keys, *([name] if name else []), *columns)
    if method not in ("median", "mean"):
        raise ValueError(f"unknown aggregation: {method}")
    names = [name] if name else []
    out = sample_medians(df, keys, columns, direct_limit, biggest, names, method == "mean")
    if method == "mean":
        means = [
            ((F.coalesce(f"s_{c}", F.lit(0.0)) + F.col(f"g_{c}") * F.col(c)) / F.col("n")).alias(c) for c in columns
        ]
        out = out.select(*keys, *names, *means)
    if name is not None:
        out = out.withColumn("label", label_from_name(F.col(name)))
    return out


def union_samples(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables whose marker columns may differ; absent ones become null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) == "positive").alias("n_positive"),
        F.count_if(F.col(label) == "negative").alias("n_negative"),
        F.count_if(F.col(label).isNotNull()).alias("n_labeled"),
    )
