"""Pieces of bounded size in which the rows of a group meet that are still apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one side of a piece, and their sizes together.
PIECE, PIECE_SIZE = 1024, 2_000_000


def deal(rows: DataFrame, keys: list[str], size: str, piece: int = PIECE, piece_size: int = PIECE_SIZE) -> DataFrame:
    """Rows (keys, cls, root, size) with `lo`, `hi` and `side`: the pieces that bring every two rows of equal keys and different roots together.

    Rows of keys with one root are left out. Few rows are one piece. Else the largest component is one side, and all other rows
    meet it and each other, so that n rows with one outside are dealt n rows and a piece's worth of copies of the one.
    Rows of a piece with two sides are to be compared across, those of other pieces all with each other.
    """
    parts = rows.groupBy(*keys, "root").agg(F.count("*").alias("c"), F.sum(size).alias("s"))
    wide = lambda c, s: F.greatest(F.ceil(c / F.lit(piece)), F.ceil(s / F.lit(piece_size)), F.lit(1)).cast("int")
    whole = parts.groupBy(*keys).agg(
        F.count("*").alias("roots"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "root", "s")).alias("main")
    )
    outside_c, outside_s = F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")
    whole = whole.where("roots > 1").select(
        *keys, F.col("main.root").alias("main"), wide(F.col("c"), F.col("s")).alias("all"),
        wide(F.col("main.c"), F.col("main.s")).alias("inner"), wide(outside_c, outside_s).alias("outer"),
    )
    placed = rows.join(whole, keys)
    inner, own = F.col("root") == F.col("main"), lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    spot = lambda lo, hi, side: F.struct(lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    # Outer part i and inner part j meet at (i, -1 - j), two outer parts at (i, k).
    to_inner = F.transform(F.sequence(one, F.col("inner")), lambda j: spot(own("outer"), -j, zero))
    to_outer = F.transform(
        F.sequence(zero, F.col("outer") - 1),
        lambda k: spot(F.least(own("outer"), k), F.greatest(own("outer"), k), (own("outer") > k).cast("int")),
    )
    from_inner = F.transform(F.sequence(zero, F.col("outer") - 1), lambda i: spot(i, -1 - own("inner"), one))
    spots = (
        F.when(F.col("all") == 1, F.array(spot(zero, zero, zero)))
        .when(inner, from_inner)
        .otherwise(F.concat(to_inner, to_outer))
    )
    return placed.select(*rows.columns, F.explode(spots).alias("spot")).select(*rows.columns, "spot.*")
