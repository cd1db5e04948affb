"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: cofactor of the arcsinh transform usual in cytometry.
COFACTOR = 150.0
INF = float("inf")
NAN = float("nan")


def asinh(x: Column) -> Column:
    """Inverse hyperbolic sine, accurate for tiny, huge and negative values.

    The built-in cancels for small arguments and turns large negative ones into
    -Infinity, hence the log1p form on |x| with the sign put back.
    """
    a = F.abs(x)
    near = F.log1p(a + a * a / (F.lit(1.0) + F.sqrt(a * a + 1.0)))
    far = F.log(a) + F.lit(0.6931471805599453)
    return F.signum(x) * F.when(a > 1e8, far).otherwise(near)


def scaled_asinh(x: Column, cofactor: float = COFACTOR) -> Column:
    return asinh(x.cast("double") / F.lit(cofactor))


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(INF)), x)


def zfill(x: Column, width: int) -> Column:
    """Left-pad with zeros to `width` behind any sign; never truncates."""
    signed = x.rlike("^[+-]")
    pad = F.lpad(x, width, "0")
    pad_signed = F.concat(
        F.substring(x, 1, 1),
        F.repeat(F.lit("0"), F.lit(width) - F.length(x)),
        F.substring(x, 2, width),
    )
    return F.when(F.length(x) >= width, x).when(signed, pad_signed).otherwise(pad)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def label_from_name(name: Column) -> Column:
    """positive / negative / null from a file name; the positive test wins."""
    low = F.lower(name)
    return F.when(low.contains("pos"), "positive").when(low.contains("neg"), "negative")


def clip_index(i: Column, size: Column | int) -> Column:
    top = (size if isinstance(size, Column) else F.lit(size)) - F.lit(1)
    return F.greatest(F.lit(0), F.least(top, i)).cast("bigint")


def draw(*parts: Column | str | int) -> Column:
    """Uniform number in [0, 1) keyed by the parts: same key, same number, on any
    partitioning and any engine that has md5."""
    key = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    # 13 hex digits = 52 bits, exact in a double.
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def first_max_index(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - F.lit(1)).cast("bigint")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d
    )
