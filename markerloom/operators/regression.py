"""Logistic regression by Newton steps on aggregated Gram matrices.

A step is one job: tasks add up the loss, the gradient and the weighted products of their rows, and send one vector; the driver
solves a system of as many unknowns as there are features. Rows are shifted by the features' means, which changes the
intercept only, as that is not penalized.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.operators.kmeans import partitions, prepared, vector_totals

# The fit ends when every component of the gradient is this small against the feature's absolute values.
GRADIENT = 1e-9
MAX_STEPS = 100


class FitError(ValueError):
    """No minimum was found, or the features are not finite."""


@dataclass(frozen=True)
class Logistic:
    """Weights of the features, the intercept, and how many jobs the fit took."""

    weights: np.ndarray
    intercept: float
    jobs: int

    def score(self, features: str) -> Column:
        """The probability of the label 1."""
        weights = F.array(*map(F.lit, self.weights.tolist()))
        sums = F.zip_with(features, weights, lambda x, w: x * w)
        return 1.0 / (1.0 + F.exp(-(F.aggregate(sums, F.lit(0.0), lambda a, v: a + v) + F.lit(self.intercept))))


def fit_logistic(points: DataFrame, label: str, rows: int, penalty: float = 1.0) -> Logistic:
    """The minimum of the summed log loss of `features` and a label of 0 and 1, plus penalty / 2 times the squared weights.

    Newton steps, halved while they do not lower the loss enough; the loss is convex, so the minimum is the only one.
    """
    row = F.concat(F.transform("features", lambda x: x.cast("double")), F.array(F.col(label).cast("double")))
    ready, count = prepared(points.select(row.alias("features")), "features", rows).persist(), partitions(rows)
    try:
        width = len(ready.select("features").first()["features"]) - 1
        first = vector_totals(ready, lambda x: np.concatenate([x.sum(axis=0), np.abs(x).sum(axis=0)]), 2 * width + 2, count)
        if not np.isfinite(first).all():
            raise FitError("features that are not finite")
        mean = np.concatenate([first[:width] / rows, [0.0]])
        # What is small: against the sums of absolute values, and those of the intercept's ones.
        scale = GRADIENT * np.concatenate([first[width + 1 : 2 * width + 1] + 1.0, [rows]])
        ridge = np.concatenate([np.full(width, penalty), [0.0]])
        upper = np.triu_indices(width + 1)

        def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def sums(z: np.ndarray) -> np.ndarray:
                x, y = np.column_stack([z[:, :width], np.ones(len(z))]), z[:, width]
                t = x @ beta
                loss = np.logaddexp(0.0, t) - y * t
                p = np.exp(-np.logaddexp(0.0, -t))
                gram = (x * (p * (1.0 - p))[:, None]).T @ x
                return np.concatenate([[loss.sum()], x.T @ (p - y), gram[upper]])

            flat = vector_totals(ready, sums, 1 + width + 1 + len(upper[0]), count, mean)
            half = np.zeros((width + 1, width + 1))
            half[upper] = flat[width + 2 :]
            hessian = half + np.triu(half, 1).T + np.diag(ridge)
            return float(flat[0] + 0.5 * (ridge * beta * beta).sum()), flat[1 : width + 2] + ridge * beta, hessian

        beta, jobs = np.zeros(width + 1), 2
        loss, gradient, hessian = at(beta)
        while (np.abs(gradient) > scale).any():
            size = np.sqrt(np.maximum(np.diag(hessian), 1e-300))
            step = np.linalg.lstsq(hessian / np.outer(size, size), gradient / size, rcond=None)[0] / size
            share = 1.0
            while True:
                jobs += 1
                if jobs > MAX_STEPS:
                    raise FitError(f"no minimum in {MAX_STEPS} steps")
                found = at(beta - share * step)
                # Close to the minimum the losses differ by rounding only.
                if found[0] <= loss - 1e-4 * share * float(gradient @ step) + 1e-12 * abs(loss):
                    break
                share /= 2.0
            beta, (loss, gradient, hessian) = beta - share * step, found
    finally:
        ready.unpersist()
    return Logistic(beta[:width], float(beta[width] - beta[:width] @ mean[:width]), jobs)
