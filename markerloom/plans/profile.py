"""From cells to one encoded row per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from markerloom.functions.ordered import DIRECT_LIMIT
from markerloom.operators.binning import Edges, discretize, state_from_bins
from markerloom.operators.cleaning import asinh_transform
from markerloom.operators.summaries import summarize


def profile_samples(
    cells: DataFrame,
    keys: Sequence[str],
    markers: Sequence[str],
    bins: Edges,
    features: Sequence[str],
    name: str | None = None,
    method: str = "median",
    direct_limit: int = DIRECT_LIMIT,
    biggest: int | None = None,
) -> DataFrame:
    """(keys, name, markers, label, <feature>_bin, state): transformed, cleaned,
    summarized and binned. Cleaning is part of the summary, so the cells are
    aggregated without being joined to anything."""
    transformed = asinh_transform(cells, markers)
    summary = summarize(transformed, keys, markers, method, name, direct_limit, biggest)
    return state_from_bins(discretize(summary, bins, features), bins, features)
