"""Bin edges, feature importance and AUC from labeled samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.operators import metrics as M
from markerloom.operators.binning import quantile_bins
from markerloom.operators.cleaning import join_labels, label_to_binary, numeric_coerce
from markerloom.operators.regression import FitError
from markerloom.operators.summaries import to_long
from markerloom.session import checkpointed
from markerloom.sources.tables import save_tables


def save_discovery(found: dict[str, object], path: str) -> None:
    """Bins, importance, top features and AUC as tables below a path; importance and AUC only if there are any."""
    spark = found["bins"].sparkSession
    top = spark.createDataFrame(list(enumerate(found["top_features"])), "rank int, feature string")
    tables = {"bins": found["bins"], "top_features": top}
    save_tables(tables | {n: found[n] for n in ("feature_importance", "auc") if found[n] is not None}, path)


def discover_bins(
    summary: DataFrame, labels: DataFrame, markers: Sequence[str], configured: Sequence[str] = ()
) -> dict[str, object]:
    """bins, feature_importance, top_features and auc of summaries joined to labels.

    If the regression cannot be fitted, the top features are the configured ones or
    the first three, and there is neither importance nor AUC.
    """
    merged = join_labels(summary.drop("label"), labels)
    if merged.isEmpty():
        raise ValueError("no labeled summaries")
    clean = checkpointed(label_to_binary(numeric_coerce(merged, markers)).select("filename", *markers, "y"))
    bins = quantile_bins(to_long(clean, [], markers).select("marker", "value"))
    points = clean.select("filename", "y", F.array(*markers).alias("features"))
    try:
        importance, scored = M.importance_and_scores(points, markers, "y")
    except FitError:  # one class only, or features that cannot be fitted
        return {
            "bins": bins,
            "feature_importance": None,
            "top_features": list(configured) or list(markers[:3]),
            "auc": None,
        }
    top = [r["feature"] for r in M.top_features(importance).collect()]
    return {
        "bins": bins,
        "feature_importance": importance,
        "top_features": top,
        "auc": M.roc_auc(scored, "score", "y"),
    }
