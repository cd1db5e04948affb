"""Exact order statistics and running totals without one task per key.

A window or `percentile` over a key brings all rows of that key into one task.
Here every value is first rounded to a few significant bits. Rounding keeps the
order, so counts per rounded value (combined on the map side) tell which rounded
value holds a wanted rank, and only rows of that one are looked at further.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.session import checkpointed, stored_small

# Values of one key that `percentile` may hold in the memory of one task.
DIRECT_LIMIT = 100_000


def coarse(x: Column, bits: int) -> Column:
    """x rounded to `bits` significant bits (Veltkamp split), order-preserving."""
    big = F.abs(x) > F.lit(1e200)
    y = F.when(big, x * F.lit(2.0**-100)).otherwise(x)
    c = y * F.lit(float(2 ** (53 - bits) + 1))
    high = c - (c - y)
    return F.when(big, high * F.lit(2.0**100)).otherwise(high)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest key; reads the key columns only."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def split_frequent(
    df: DataFrame, keys: Sequence[str], limit: int
) -> tuple[DataFrame | None, DataFrame | None, int]:
    """The rows of keys with up to `limit` rows and those of the others, None for a side without any, and the size of the
    biggest key. One frequent key thus does not decide for all.

    One job counts; the frequent keys, at most one for each `limit` rows, are stored only if there are others too.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    frequent = F.col("__n") > limit
    found = sizes.agg(F.count_if(frequent).alias("many"), F.count_if(~frequent).alias("few"), F.max("__n").alias("top")).first()
    if not found["many"]:
        return df, None, found["top"] or 0
    if not found["few"]:
        return None, df, found["top"]
    hot = stored_small(sizes.where(frequent).select(*[F.col(k).alias(f"__{k}") for k in keys]))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi"), found["top"]


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def _narrow(counts: DataFrame, group: list[str], by: str) -> DataFrame:
    """Keep the rows of `counts` (group, by, c, before, ranks) that hold a rank."""
    w = W.partitionBy(*group).orderBy(by)
    upto = F.col("before") + F.sum("c").over(w)
    return (
        counts.withColumn("upto", upto)
        .withColumn("before", F.col("upto") - F.col("c"))
        .withColumn(
            "ranks",
            F.expr("filter(ranks, r -> r >= before and r < upto)"),
        )
        .where(F.size("ranks") > 0)
        .drop("upto", "c")
    )


def _select_ranks(rows: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """(keys, n, rank, v) for the ranks the probabilities need. Reads the rows twice;
    what is left after that, one rounded value per rank, is stored."""
    every = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    pos = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array_distinct(
        F.array(*[f(p).cast("bigint") for p in pos for f in (F.floor, F.ceil)])
    )
    level1 = (
        rows.groupBy(*keys, coarse(F.col("v"), 8).alias("b8"))
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("n", F.sum("c").over(every))
        .withColumn("before", F.lit(0).cast("bigint"))
        .withColumn("ranks", ranks)
    )
    # A few rows per key; the rows are read once for them and once for `values`.
    hit1 = stored_small(_narrow(level1, keys, "b8"))

    tagged = rows.withColumn("b8", coarse(F.col("v"), 8)).alias("r")
    wanted = hit1.alias("h")
    cond = F.col("r.b8").eqNullSafe(F.col("h.b8"))
    for k in keys:
        cond = cond & F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}"))
    values = checkpointed(
        tagged.join(wanted, cond, "left_semi")
        .groupBy(*keys, "b8", "v")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("b24", coarse(F.col("v"), 24))
        .withColumn("b40", coarse(F.col("v"), 40))
    )

    def attach(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        r = right.select(*[F.col(c).alias(f"__{c}") for c in on], "n", "before", "ranks")
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return left.join(r, cond).drop(*[f"__{c}" for c in on])

    level2 = values.groupBy(*keys, "b8", "b24").agg(F.sum("c").alias("c"))
    hit2 = _narrow(attach(level2, hit1, [*keys, "b8"]), [*keys, "b8"], "b24")
    # Each level orders at most 2**16 rounded values, and the last the 2**13 that share 40 bits.
    level3 = values.groupBy(*keys, "b8", "b24", "b40").agg(F.sum("c").alias("c"))
    hit3 = _narrow(attach(level3, hit2, [*keys, "b8", "b24"]), [*keys, "b8", "b24"], "b40")
    level4 = attach(values, hit3, [*keys, "b8", "b24", "b40"])
    hit4 = _narrow(level4, [*keys, "b8", "b24", "b40"], "v")
    return hit4.select(*keys, "n", F.explode("ranks").alias("rank"), "v")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    direct_limit: int = DIRECT_LIMIT,
    biggest: int | None = None,
) -> DataFrame:
    """(keys, n, q): exact interpolated quantiles of the non-null values per key.

    Keys up to `direct_limit` rows go through `percentile`. For the others the ranks
    are found by three counting passes, so a key may hold any share of the rows.
    `biggest` is the size of the biggest key where it is known, which saves the
    counting job, and then decides for all keys. Values must be finite.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("v")
    )
    if biggest is None:
        few, many, _ = split_frequent(rows, keys, direct_limit)
    else:
        few, many = (rows, None) if biggest <= direct_limit else (None, rows)
    parts = [f(t, keys, probs) for f, t in ((_by_percentile, few), (_by_counting, many)) if t is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _by_percentile(rows: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"),
    )


def _by_counting(rows: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    found = _select_ranks(rows, keys, probs)
    by_rank = F.map_from_entries(F.collect_list(F.struct("rank", "v")))
    grouped = found.groupBy(*keys).agg(F.first("n").alias("n"), by_rank.alias("m"))

    def at(p: float) -> Column:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo = F.element_at("m", F.floor(pos).cast("bigint"))
        hi = F.element_at("m", F.ceil(pos).cast("bigint"))
        return lo + (hi - lo) * (pos - F.floor(pos))

    return grouped.select(*keys, "n", F.array(*[at(p) for p in probs]).alias("q"))


def running_totals(df: DataFrame, order: str, amounts: Sequence[str]) -> DataFrame:
    """Adds `<amount>_before`: the sum over all rows with a smaller `order`.

    `order` must be unique. The rows are dealt to ranges of equal size by their own quantiles, added up inside each
    range, and shifted by the sums of the ranges before, one row per range.
    """
    tagged = checkpointed(df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    w = W.orderBy("__range")
    sums = tagged.groupBy("__range").agg(*[F.sum(a).alias(f"__{a}") for a in amounts])
    offsets = sums.select(
        "__range", *[(F.sum(f"__{a}").over(w) - F.col(f"__{a}")).alias(f"__{a}") for a in amounts]
    )
    inside = W.partitionBy("__range").orderBy(order)
    return (
        tagged.select(
            "*", *[(F.sum(a).over(inside) - F.col(a)).alias(f"{a}_before") for a in amounts]
        )
        .join(stored_small(offsets), "__range")
        .withColumns({f"{a}_before": F.col(f"{a}_before") + F.col(f"__{a}") for a in amounts})
        .drop("__range", *[f"__{a}" for a in amounts])
    )


def numbered(df: DataFrame, key: str, order: str, name: str, width: int = 4096) -> DataFrame:
    """Adds 1, 2, ... per key in the order of an integer that is unique within the key. Ranges of `width` numbers are
    counted first, so that no task orders all rows of a key."""
    tagged = df.withColumn("__range", F.floor(F.col(order) / F.lit(width)))
    sizes = tagged.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(key).orderBy("__range")) - F.col("__n")
    shift = stored_small(sizes.select(F.col(key).alias("__key"), F.col("__range").alias("__same"), before.alias("__before")))
    inside = F.row_number().over(W.partitionBy(key, "__range").orderBy(order))
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col("__range").eqNullSafe(F.col("__same"))
    return (
        tagged.withColumn("__at", inside)
        .join(shift, same)
        .withColumn(name, (F.col("__at") + F.col("__before")).cast("bigint"))
        .drop("__range", "__at", "__key", "__same", "__before")
    )


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Adds 0..n-1, ordered by the md5 prefix of the unique `key`, then by the key.

    4096 prefixes hold equal shares of the keys, so the rows are numbered in 4096
    independent groups and shifted by the sizes of the groups before.
    """
    tagged = df.withColumn("pre", F.substring(F.md5(F.col(key).cast("string")), 1, 3))
    sizes = tagged.groupBy("pre").agg(F.count(F.lit(1)).alias("size"))
    shift = sizes.select("pre", (F.sum("size").over(W.orderBy("pre")) - F.col("size")).alias("shift"))
    return (
        tagged.withColumn(name, F.row_number().over(W.partitionBy("pre").orderBy(key)) - 1)
        .join(F.broadcast(shift), "pre")
        .withColumn(name, (F.col(name) + F.col("shift")).cast("bigint"))
        .drop("pre", "shift")
    )
