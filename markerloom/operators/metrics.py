"""Labels of clusters and agreement with known labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.functions.ordered import running_totals
from markerloom.operators.regression import FitError, fit_logistic
from markerloom.session import checkpointed

POSITIVE, NEGATIVE = "positive", "negative"
MEASURES = ("f1", "mcc", "accuracy")


def majority_label(members: DataFrame, truth: str = "truth") -> DataFrame:
    """(k, cluster, n_pos, n_neg, label): positive only if positives outnumber the rest."""
    hit = F.coalesce(F.col(truth) == POSITIVE, F.lit(False))
    return (
        members.groupBy("k", "cluster")
        .agg(F.count_if(hit).alias("n_pos"), F.count_if(~hit).alias("n_neg"))
        .withColumn("label", F.when(F.col("n_pos") > F.col("n_neg"), POSITIVE).otherwise(NEGATIVE))
    )


def outcome_counts(truth: Column, pred: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates tp, fp, fn, tn of boolean columns, each row counting `weight` times."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    cells = {"tp": truth & pred, "fp": ~truth & pred, "fn": truth & ~pred, "tn": ~truth & ~pred}
    return [F.sum(F.when(c, w).otherwise(F.lit(0))).cast("bigint").alias(n) for n, c in cells.items()]


def majority_outcomes(labels: DataFrame) -> DataFrame:
    """(k, tp, fp, fn, tn) of the majority vote, from its table alone: no second
    pass over the samples."""
    voted = F.col("label") == POSITIVE
    sums = {
        "tp": F.when(voted, F.col("n_pos")),
        "fp": F.when(voted, F.col("n_neg")),
        "fn": F.when(~voted, F.col("n_pos")),
        "tn": F.when(~voted, F.col("n_neg")),
    }
    return labels.groupBy("k").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])


def f1_score() -> Column:
    whole = 2.0 * F.col("tp") + F.col("fp") + F.col("fn")
    return F.when(whole > 0, 2.0 * F.col("tp") / whole).otherwise(0.0)


def mcc_score() -> Column:
    """Matthews correlation moved to [0, 1]; 0.5 where it is undefined."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    mcc = F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(0.0)
    return (mcc + 1.0) / 2.0


def accuracy_score() -> Column:
    whole = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return F.when(whole > 0, (F.col("tp") + F.col("tn")) / whole).otherwise(0.0)


def measure(name: str) -> Column:
    """Score column over tp, fp, fn, tn."""
    scores = {"f1": f1_score, "mcc": mcc_score, "accuracy": accuracy_score}
    if name not in scores:
        raise ValueError(f"unknown accuracy measure: {name}")
    return scores[name]()


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n) over all pairs of occurring labels, absent pairs with 0."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    classes = F.array_sort(F.array_union(F.collect_set("truth"), F.collect_set("pred")))
    grid = (
        counts.agg(classes.alias("classes"))
        .select(F.explode("classes").alias("truth"), "classes")
        .select("truth", F.explode("classes").alias("pred"))
    )
    return grid.join(counts, ["truth", "pred"], "left").select(
        "truth", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(n_pos, n_neg, auc): share of (positive, negative) pairs in the right order,
    ties half. Works on counts per distinct score; null where a class is absent."""
    per_score = checkpointed(
        df.groupBy(F.col(score).cast("double").alias("s")).agg(
            F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("m")
        )
    )
    ranked = running_totals(per_score, "s", ["m"])
    wins = F.sum(F.col("p") * (F.col("m_before") + F.col("m") / 2.0))
    sums = ranked.agg(F.sum("p").alias("n_pos"), F.sum("m").alias("n_neg"), wins.alias("wins"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return sums.select("n_pos", "n_neg", F.when(pairs > 0, F.col("wins") / pairs).alias("auc"))


class ClassCountError(FitError):
    """The labels do not have two classes."""


def importance_and_scores(
    points: DataFrame, columns: Sequence[str], label: str
) -> tuple[DataFrame, DataFrame]:
    """(feature, abs_coefficient) and the points with their score, from a logistic
    regression with the L2 penalty of C = 1 on unscaled features."""
    classes = points.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("c")).first()
    if classes["c"] != 2:
        raise ClassCountError("two classes are needed")
    model = fit_logistic(points, label, classes["n"])
    rows = [(c, abs(float(w))) for c, w in zip(columns, model.weights)]
    importance = points.sparkSession.createDataFrame(rows, "feature string, abs_coefficient double")
    return importance, points.withColumn("score", model.score("features"))


def top_features(importance: DataFrame, n: int = 3) -> DataFrame:
    return importance.orderBy(F.desc("abs_coefficient"), "feature").limit(n)
