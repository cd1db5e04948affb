"""Rewards per cluster count and the two training phases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.operators import clustering as C
from markerloom.operators import metrics as M
from markerloom.operators import qtable as Q
from markerloom.operators.silhouette import silhouette
from markerloom.operators.cleaning import feature_matrix, labeled_only
from markerloom.session import checkpointed
from markerloom.sources.tables import load_table, save_tables

# Rewards of cluster counts that cannot be fitted, and the scale
# of the inertia reward.
FAILED_QUALITY = -1.0
FAILED_DIAGNOSIS = 0.0
INERTIA_SCALE = 10_000.0
QUALITIES = ("silhouette", "inertia")


def fit_sweep(points: DataFrame, key: str, ks: Sequence[int], restarts: int = C.RESTARTS) -> DataFrame:
    """clusters(k, key, cluster) for every k that has enough samples. The rewards
    depend on k only, so each k is fitted once for a whole training run."""
    return checkpointed(C.kmeans_sweep(points, key, ks, restarts=restarts))


def _filled(rewards: DataFrame, ks: Sequence[int], missing: float) -> DataFrame:
    """One row per k; the ones without a clustering get the failure reward."""
    every = rewards.sparkSession.createDataFrame([(int(k),) for k in sorted(set(ks))], "k bigint")
    return every.join(rewards, "k", "left").withColumn(
        "reward", F.coalesce("reward", F.lit(missing))
    )


def quality_rewards(
    points: DataFrame,
    clusters: DataFrame,
    key: str,
    ks: Sequence[int],
    quality: str = "silhouette",
    sums: DataFrame | None = None,
) -> DataFrame:
    """(k, reward): the silhouette, or minus the inertia scaled down. `sums`: see silhouette."""
    if quality not in QUALITIES:
        raise ValueError(f"unknown quality measure: {quality}")
    if quality == "silhouette":
        scored = silhouette(points, clusters, key, sums=sums).select("k", F.col("silhouette").alias("reward"))
    else:
        scored = C.inertia(points, clusters, key).select(
            "k", (-F.col("inertia") / F.lit(INERTIA_SCALE)).alias("reward")
        )
    return _filled(scored, ks, FAILED_QUALITY)


def diagnostic_rewards(
    clusters: DataFrame, truth: DataFrame, key: str, ks: Sequence[int], accuracy: str = "f1"
) -> DataFrame:
    """(k, reward): agreement of the majority vote with truth(key, truth)."""
    score = M.measure(accuracy)
    votes = M.majority_label(clusters.join(truth, key))
    scored = M.majority_outcomes(votes).select("k", score.alias("reward"))
    return _filled(scored, ks, FAILED_DIAGNOSIS)


def reward_map(rewards: DataFrame) -> dict[int, float]:
    """One number per cluster count, brought to the driver."""
    return {r["k"]: r["reward"] for r in rewards.collect()}


def train_quality(
    samples: DataFrame,
    points: DataFrame,
    clusters: DataFrame,
    key: str,
    p: Q.Learning = Q.Learning(),
    quality: str = "silhouette",
) -> tuple[DataFrame, DataFrame]:
    """Phase 1: (q, visits) of samples(key, state) from a table of zeros."""
    ks = range(p.min_k, p.max_k + 1)
    rewards = reward_map(quality_rewards(points, clusters, key, ks, quality))
    return Q.learn(samples, key, rewards, p, phase=1)


def train_diagnostic(
    samples: DataFrame,
    clusters: DataFrame,
    key: str,
    p: Q.Learning = Q.Learning(),
    accuracy: str = "f1",
    q0: DataFrame | None = None,
    done: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Phase 2: (q, visits) of labeled samples(key, state, label), going on from the
    table and the epsilon that `done` iterations of phase 1 left."""
    ks = range(p.min_k, p.max_k + 1)
    truth = samples.select(key, F.col("label").alias("truth"))
    rewards = reward_map(diagnostic_rewards(clusters, truth, key, ks, accuracy))
    return Q.learn(samples, key, rewards, p, phase=2, done=done, q0=q0)


def params_table(spark, p: Q.Learning, done: int) -> DataFrame:
    """One row: the parameters and how far the epsilon schedule has come."""
    fields = dict(vars(p)) | {"n_actions": p.n_actions, "done": done}
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in fields.items()])


def _log_tables(visits: DataFrame, p: Q.Learning, done: int = 0) -> dict[str, DataFrame]:
    return {"visits": visits, "episodes": Q.record_episode(visits), "log": Q.training_log(visits, p, done=done)}


def _of_phase(clusters: DataFrame, phase: int) -> DataFrame:
    return clusters.select(F.lit(phase).cast("bigint").alias("phase"), *clusters.columns)


def train_phase1(
    samples: DataFrame,
    key: str,
    markers: Sequence[str],
    path: str,
    p: Q.Learning = Q.Learning(),
    quality: str = "silhouette",
) -> None:
    """Phase 1 on samples(key, state, markers): their matrix, their clusterings, and the agent saved at `path`: q, visits,
    episodes, log, clusters, params."""
    if samples.isEmpty():
        raise ValueError("no samples")
    ks = range(p.min_k, p.max_k + 1)
    points, _ = feature_matrix(samples.select(key, *markers), key, markers)
    points = checkpointed(points)
    clusters = fit_sweep(points, key, ks)
    q, visits = train_quality(samples, points, clusters, key, p, quality)
    tables = {"q": q, **_log_tables(checkpointed(visits), p), "clusters": _of_phase(clusters, 1)}
    save_tables(tables | {"params": params_table(q.sparkSession, p, p.iterations)}, path)


def load_params(spark, path: str) -> tuple[Q.Learning, int]:
    """The parameters of a saved agent, and how many iterations it has done."""
    row = load_table(spark, path, "params").first().asDict()
    return Q.Learning(**{f.name: row[f.name] for f in fields(Q.Learning)}), row["done"]


def train_phase2(
    samples: DataFrame, key: str, markers: Sequence[str], agent: str, path: str, accuracy: str = "f1"
) -> None:
    """Phase 2 on the labeled ones of samples(key, state, label, markers), going on from the agent saved at `agent`, and
    the agent saved at another `path`. Matrix, medians and clusterings are those of the labeled samples."""
    spark = samples.sparkSession
    p, done = load_params(spark, agent)
    labeled = labeled_only(samples)
    ks = range(p.min_k, p.max_k + 1)
    points, _ = feature_matrix(labeled.select(key, *markers), key, markers)
    clusters = fit_sweep(checkpointed(points), key, ks)
    q, visits = train_diagnostic(labeled, clusters, key, p, accuracy, load_table(spark, agent, "q"), done)
    own = _log_tables(checkpointed(visits), p, done) | {"clusters": _of_phase(clusters, 2)}
    tables = {name: load_table(spark, agent, name).unionByName(table) for name, table in own.items()}
    save_tables({"q": q, **tables, "params": params_table(spark, p, done + p.iterations)}, path)


def train_full(
    first: DataFrame,
    second: DataFrame,
    key: str,
    markers: Sequence[str],
    path: str,
    p: Q.Learning = Q.Learning(),
    quality: str = "silhouette",
    accuracy: str = "f1",
) -> None:
    """Phase 1 on the samples `first`, phase 2 on the labeled ones of `second`; the agents are saved at
    `path`/phase1 and `path`."""
    train_phase1(first, key, markers, f"{path}/phase1", p, quality)
    train_phase2(second, key, markers, f"{path}/phase1", path, accuracy)
