"""Finding the column that carries a marker, in tables of channels or of names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _per_request(channels: DataFrame, markers: Sequence[str]) -> DataFrame:
    """(file, channels, marker): the channels of a file in file order, as one short
    array, once per requested marker."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "channel")))
    files = channels.groupBy("file").agg(F.transform(listed, lambda c: c["channel"]).alias("channels"))
    return files.withColumn("marker", F.explode(F.array(*[F.lit(m) for m in markers])))


def _first(test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter("channels", test), F.lit(0))


def resolve_markers(channels: DataFrame, markers: Sequence[str]) -> DataFrame:
    """(file, marker, channel) from channels(file, pos, channel).

    Exact name, else equal ignoring case, else the first channel containing the
    marker. Unmatched markers have no row; two markers may share a channel.
    """
    marker = F.col("marker")
    best = F.coalesce(
        _first(lambda c: c == marker),
        _first(lambda c: F.lower(c) == F.lower(marker)),
        _first(lambda c: F.lower(c).contains(F.lower(marker))),
    )
    found = _per_request(channels, markers).select("file", "marker", best.alias("channel"))
    return found.where(F.col("channel").isNotNull())


def locate_marker(channels: DataFrame, markers: Sequence[str]) -> DataFrame:
    """(file, marker, channel): first channel containing the marker, else its name."""
    marker = F.col("marker")
    hit = _first(lambda c: F.lower(c).contains(F.lower(marker)))
    return _per_request(channels, markers).select("file", "marker", F.coalesce(hit, marker).alias("channel"))


def resolved_name(columns: Sequence[str], marker: str) -> str | None:
    """The rule of `resolve_markers` on the column names of one table."""
    low = marker.lower()
    tests = (lambda c: c == marker, lambda c: c.lower() == low, lambda c: low in c.lower())
    return next((c for test in tests for c in columns if test(c)), None)


def located_name(columns: Sequence[str], marker: str) -> str:
    """The rule of `locate_marker` on the column names of one table."""
    return next((c for c in columns if marker.lower() in c.lower()), marker)


def select_markers(df: DataFrame, markers: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Resolved columns under their logical marker names, next to the `keep` columns."""
    columns = [c for c in df.columns if c not in keep]
    found = {m: resolved_name(columns, m) for m in markers}
    found = {m: c for m, c in found.items() if c is not None}
    if not found:
        raise ValueError(f"none of {list(markers)} among {columns}")
    return df.select(*keep, *[F.col(f"`{c}`").alias(m) for m, c in found.items()])
