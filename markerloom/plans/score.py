"""Applying a learned policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.operators.cleaning import feature_matrix
from markerloom.operators.clustering import cluster_lookup, default_label
from markerloom.operators.qtable import Learning, policy, policy_lookup
from markerloom.plans.train import fit_sweep, load_params
from markerloom.session import checkpointed
from markerloom.sources.tables import load_table, read_predictions, write_predictions


def score_samples(
    samples: DataFrame,
    clusters: DataFrame,
    q: DataFrame,
    key: str,
    p: Learning = Learning(),
    n_states: int | None = None,
) -> DataFrame:
    """Predictions for samples(key, filename, state) from clusters(k, key, cluster) of these samples. Every sample
    gets one; a cluster count without a clustering is an error."""
    chosen = policy_lookup(samples, policy(q, p.n_actions), p.min_k, n_states)
    return cluster_lookup(chosen, clusters, key).select(
        "filename",
        F.col("state").alias("encoded_state"),
        F.col("k").alias("selected_cluster_count"),
        F.col("cluster").alias("assigned_cluster"),
        default_label(F.col("cluster")).alias("predicted_hiv_status"),
    )


def score_new(
    samples: DataFrame,
    key: str,
    markers: Sequence[str],
    agent: str,
    path: str,
    n_states: int | None = None,
) -> DataFrame:
    """Predictions for new samples(key, filename, state, markers), written to `path` and read back.

    The matrix and the clusterings are those of the new samples, the policy is the saved agent's. No samples, or a chosen
    cluster count that they are too few for, is an error.
    """
    if samples.isEmpty():
        raise ValueError("no samples")
    spark = samples.sparkSession
    p, _ = load_params(spark, agent)
    points, _ = feature_matrix(samples.select(key, *markers), key, markers)
    clusters = fit_sweep(checkpointed(points), key, range(p.min_k, p.max_k + 1))
    write_predictions(score_samples(samples, clusters, load_table(spark, agent, "q"), key, p, n_states), path)
    return read_predictions(spark, path)
