"""Clusterings, their evaluation, and label agreement."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from markerloom.catalog import fixtures as X
from markerloom.catalog.base import big, query, r6, rounded, table
from markerloom.functions.scalars import squared_distance
from markerloom.operators import clustering as C
from markerloom.operators import metrics as ME
from markerloom.operators.cleaning import normalize_label_rows
from markerloom.operators.kmeans import centered, centers_table, lloyd, prepared
from markerloom.operators.silhouette import cluster_distances, distance_sums
from markerloom.operators.silhouette import silhouette as silhouette_of
from markerloom.plans.discover import discover_bins, save_discovery
from markerloom.plans.train import diagnostic_rewards, fit_sweep, quality_rewards
from markerloom.session import checkpointed, new_path
from markerloom.sources.tables import load_table, parquet

V = "vec_id"


def _fixed(spark, sf):
    points = X.vectors(spark, sf).select(V, "features")
    return points, X.fixed_clusters(points, V)


@query("SELECT k, vec_id, cluster, round(distance2, 6) + 0.0 AS distance2 FROM vnear", ("vnear",))
def nearest_centroid(spark, sf):
    points = X.vectors(spark, sf).select(V, "features")
    return rounded(C.nearest_centroid(points, X.first_centers(points, V), V), "distance2")


@query(
    """SELECT k, cluster, i - 1 AS dim, round(avg(features[i]), 6) + 0.0 AS center, count(*) AS n
FROM vasg JOIN vec USING (vec_id), range(1, 65) t(i) GROUP BY 1, 2, 3""",
    ("vasg", "vec"),
)
def kmeans_step(spark, sf):
    points = X.vectors(spark, sf).select(V, "features")
    step = C.kmeans_step(points, X.first_centers(points, V), V)
    rows = step.select("k", "cluster", "n", F.posexplode("center").alias("dim", "center"))
    return rows.select("k", "cluster", big("dim").alias("dim"), r6("center").alias("center"), "n")


@query(
    """SELECT k, vec_id, cluster, n, round(mean_distance, 6) + 0.0 AS mean_distance FROM vmean""",
    ("vmean",),
)
def pairwise_distance(spark, sf):
    """Distances of all pairs of rows, summed per row and cluster as they arise."""
    points, clusters = _fixed(spark, sf)
    return rounded(cluster_distances(points, clusters, V), "mean_distance")


@query("SELECT k, round(silhouette, 6) + 0.0 AS silhouette FROM vsil", ("vsil",))
def silhouette(spark, sf):
    points, clusters = _fixed(spark, sf)
    return rounded(silhouette_of(points, clusters, V), "silhouette")


table(
    "vinertia",
    """SELECT k, sum((x - m) * (x - m)) AS inertia FROM (
  SELECT k, features[i] AS x, avg(features[i]) OVER (PARTITION BY k, cluster, i) AS m
  FROM vasg JOIN vec USING (vec_id), range(1, 65) t(i)) GROUP BY 1""",
    ("vasg", "vec"),
)


@query("SELECT k, round(inertia, 6) + 0.0 AS inertia FROM vinertia", ("vinertia",))
def inertia(spark, sf):
    points, clusters = _fixed(spark, sf)
    return rounded(C.inertia(points, clusters, V), "inertia")


@query(
    """SELECT s.k, round(silhouette, 6) + 0.0 AS by_silhouette, round(-inertia / 10000, 9) + 0.0 AS by_inertia
FROM vsil s JOIN vinertia USING (k)""",
    ("vsil", "vinertia"),
)
def quality_reward(spark, sf):
    points, clusters = _fixed(spark, sf)
    a = quality_rewards(points, clusters, V, X.KS).withColumnRenamed("reward", "a")
    b = quality_rewards(points, clusters, V, X.KS, "inertia").withColumnRenamed("reward", "b")
    return a.join(b, "k").select(
        "k", r6("a").alias("by_silhouette"), (F.round("b", 9) + 0.0).alias("by_inertia")
    )


STEPS, K_STEPS = 3, 5
table("l0ctr", f"SELECT cluster, center FROM vctr WHERE k = {K_STEPS}", ("vctr",))
for _n in range(1, STEPS + 2):
    table(
        f"l{_n}asg",
        f"""SELECT vec_id, features, cluster, d * d AS d2 FROM (
  SELECT p.vec_id, p.features, c.cluster, list_distance(p.features, c.center) AS d FROM vec p, l{_n - 1}ctr c)
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1""",
        ("vec", f"l{_n - 1}ctr"),
    )
    table(
        f"l{_n}ctr",
        f"""SELECT cluster, list(m ORDER BY i) AS center FROM (
  SELECT cluster, i, avg(features[i]) AS m FROM l{_n}asg, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1""",
        (f"l{_n}asg",),
    )


@query(
    f"""SELECT cluster, i - 1 AS dim, round(center[i], 6) + 0.0 AS center,
  (SELECT round(sum(d2), 6) + 0.0 FROM l{STEPS + 1}asg) AS inertia
FROM l{STEPS}ctr, range(1, 65) t(i)""",
    (f"l{STEPS}ctr", f"l{STEPS + 1}asg"),
)
def kmeans_iterations(spark, sf):
    """Three iterations of the sweep's fit from given centers."""
    points = X.vectors(spark, sf).select(V, "features")
    first = X.first_centers(points, V, [K_STEPS]).orderBy("cluster").collect()
    start = np.array([r["center"] for r in first])
    ready = prepared(points, V, points.count()).persist()
    count = ready.rdd.getNumPartitions()
    mean, _ = centered(ready, count)
    run = (K_STEPS, 0)
    centers, cost = lloyd(ready, {run: start - mean}, STEPS, 0.0, mean, count)[run]
    ready.unpersist()
    rows = centers_table(spark, {K_STEPS: centers + mean}).select("cluster", F.posexplode("center").alias("dim", "center"))
    return rows.select("cluster", big("dim").alias("dim"), r6("center").alias("center"), r6(F.lit(cost)).alias("inertia"))


# ---- fits: the queries hold a fit against what defines it ------------------------

FIT_K = 5


def _center_check(points, clusters, centers):
    """(n, clusters, wrong_nearest, wrong_center): rows in all, groups, rows that are nearer to another center than to
    their own, and centers that are not the mean of their rows (within the tolerance of the fit)."""
    rows = sorted(centers.collect(), key=lambda r: r["cluster"])
    at = F.array(*[F.array(*[F.lit(float(v)) for v in r["center"]]) for r in rows])
    far = F.transform(at, lambda c: F.aggregate(F.zip_with("features", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    placed = points.join(clusters, V).withColumn("far", far)
    own = F.get("far", F.col("cluster").cast("int"))
    near = placed.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("cluster").alias("clusters"),
        F.count_if(own > F.array_min("far") + 1e-9).alias("wrong_nearest"),
    )
    means = C.cluster_means(points, clusters, V).join(centers.withColumnRenamed("center", "fitted"), ["k", "cluster"])
    off = F.aggregate(F.zip_with("center", "fitted", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    moved = means.agg(F.count_if(off > 1e-2).alias("wrong_center"))
    row = near.first().asDict() | moved.first().asDict()
    return points.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{c} bigint" for c in row))


@query(
    f"""SELECT count(*) AS n, {FIT_K}::BIGINT AS clusters, 0::BIGINT AS wrong_nearest, 0::BIGINT AS wrong_center, true AS same_inertia, true AS beats_first_centers
FROM vec""",
    ("vec",),
)
def kmeans(spark, sf):
    """Every row at its nearest center, centers at the means, the inertia recomputed, and lower than around the first
    rows as centers."""
    points = X.vectors(spark, sf).select(V, "features")
    clusters, cost, centers = C.kmeans(points, FIT_K, V)
    clusters = checkpointed(clusters)
    around = C.inertia(points, clusters, V, centers).first()["inertia"]
    plain = C.nearest_centroid(points, X.first_centers(points, V, [FIT_K]), V).agg(F.sum("distance2")).first()[0]
    return _center_check(points, clusters, centers).select(
        "*", F.lit(abs(around - cost) <= 1e-6 * cost).alias("same_inertia"), F.lit(cost <= plain).alias("beats_first_centers")
    )


# ---- a step of the mixture from given parameters, on the first eight components ----

STEP_DIMS, STEP_K = 8, 3
# Weights, and the triangular factor of the covariances by its diagonal and the one below.
STEP_WEIGHTS, STEP_DIAGONAL, STEP_BELOW = (0.5, 0.3, 0.2), 1.25, 0.375


def _step_sql() -> None:
    """z solves L z = x - mean from the first component on."""
    tables = ["SELECT p.vec_id, p.features AS x, c.cluster, c.center AS m FROM vec p, (SELECT * FROM vctr WHERE k = 3) c"]
    for i in range(1, STEP_DIMS + 1):
        before = "" if i == 1 else f" - {STEP_BELOW}::DOUBLE * z{i - 1}"
        tables.append(f"SELECT *, (x[{i}] - m[{i}]{before}) / {STEP_DIAGONAL}::DOUBLE AS z{i} FROM ({tables[-1]})")
    square = " + ".join(f"z{i} * z{i}" for i in range(1, STEP_DIMS + 1))
    weight = "CASE cluster " + " ".join(f"WHEN {c} THEN ln({w}::DOUBLE)" for c, w in enumerate(STEP_WEIGHTS)) + " END"
    const = f"{STEP_DIMS} * (0.5::DOUBLE * ln(2 * pi()) + ln({STEP_DIAGONAL}::DOUBLE))"
    table("emlog", f"SELECT vec_id, x, cluster, {weight} - 0.5::DOUBLE * ({square}) - {const} AS d FROM ({tables[-1]})", ("vec", "vctr"))
    table("emtop", "SELECT vec_id, max(d) AS top FROM emlog GROUP BY 1", ("emlog",))
    table("emall", "SELECT vec_id, top + ln(sum(exp(d - top))) AS l FROM emlog JOIN emtop USING (vec_id) GROUP BY vec_id, top", ("emlog", "emtop"))
    table("emr", "SELECT vec_id, x, cluster, exp(d - l) AS r FROM emlog JOIN emall USING (vec_id)", ("emlog", "emall"))
    table("emn", "SELECT cluster, sum(r) AS n FROM emr GROUP BY 1", ("emr",))
    table(
        "emm",
        f"SELECT cluster, i, sum(r * x[i]) / sum(r) AS m FROM emr, range(1, {STEP_DIMS + 1}) t(i) GROUP BY 1, 2",
        ("emr",),
    )
    table(
        "emc",
        f"""SELECT e.cluster, a.i, b.i AS j, sum(r * (x[a.i] - a.m) * (x[b.i] - b.m)) / sum(r) + CASE WHEN a.i = b.i THEN {C.COVARIANCE_FLOOR}::DOUBLE ELSE 0 END AS c
FROM emr e JOIN emm a ON a.cluster = e.cluster JOIN emm b ON b.cluster = e.cluster AND b.i >= a.i GROUP BY 1, 2, 3""",
        ("emr", "emm"),
    )


_step_sql()


@query(
    """SELECT c.cluster, c.i - 1 AS i, c.j - 1 AS j, round(n / (SELECT count(*) FROM vec), 6) + 0.0 AS weight, round(m, 6) + 0.0 AS mean,
  round(c, 5) + 0.0 AS covariance, (SELECT round(sum(l), 4) + 0.0 FROM emall) AS likelihood
FROM emc c JOIN emm m ON m.cluster = c.cluster AND m.i = c.i JOIN emn n ON n.cluster = c.cluster""",
    ("emc", "emm", "emn", "emall", "vec"),
)
def mixture_step(spark, sf):
    """One step of expectation maximization from given weights, means and covariances: all parameters and the likelihood."""
    points = X.vectors(spark, sf).select(V, "features")
    first = X.first_centers(points, V, [STEP_K]).orderBy("cluster").collect()
    points = points.withColumn("features", F.slice("features", 1, STEP_DIMS))
    factor = np.diag([STEP_DIAGONAL] * STEP_DIMS) + np.diag([STEP_BELOW] * (STEP_DIMS - 1), -1)
    means = np.array([r["center"][:STEP_DIMS] for r in first])
    given = C.Mixture(np.array(STEP_WEIGHTS), means, np.stack([factor @ factor.T] * STEP_K), math.nan, points.count())
    m = C.mixture_step(points, given, V)
    rows = [
        (c, i, j, float(m.weights[c]), float(m.means[c, i]), float(m.covariances[c, i, j]), m.likelihood)
        for c in range(STEP_K)
        for i in range(STEP_DIMS)
        for j in range(i, STEP_DIMS)
    ]
    out = spark.createDataFrame(rows, "cluster bigint, i bigint, j bigint, weight double, mean double, covariance double, likelihood double")
    return rounded(out, "weight", "mean").withColumns(
        {"covariance": F.round("covariance", 5) + 0.0, "likelihood": F.round("likelihood", 4) + 0.0}
    )


def _settled(model, step) -> tuple[bool, bool, bool]:
    """Whether a step leaves weights, means and covariances where they are, up to the tolerance of the fit."""
    size = [np.trace(c) for c in model.covariances]
    moved = [float(((a - b) ** 2).sum()) / s for a, b, s in zip(model.means, step.means, size)]
    other = [float(np.linalg.norm(a - b) / np.linalg.norm(a)) for a, b in zip(model.covariances, step.covariances)]
    return tuple(bool(x) for x in (np.abs(model.weights - step.weights).max() < 0.02, max(moved) < 0.02, max(other) < 0.15))


@query(
    """SELECT count(*) AS n, 3::BIGINT AS clusters, 0::BIGINT AS wrong_choice, true AS same_bic, true AS weights_settled, true AS means_settled,
  true AS covariances_settled FROM vec""",
    ("vec",),
)
def gaussian_mixture(spark, sf):
    """A step from the fitted parameters moves none of them; the largest share is the cluster; the BIC follows from the
    likelihood that the step tells."""
    points = X.vectors(spark, sf).select(V, "features")
    clusters, bic, model = C.gaussian_mixture(points, 3, V)
    shares = C.mixture_shares(points, model, V).join(clusters.withColumnRenamed("cluster", "chosen"), V)
    at = F.array_position("shares", F.array_max("shares")) - 1
    row = shares.agg(F.count(F.lit(1)).alias("n"), F.count_if(at != F.col("chosen")).alias("wrong_choice")).first()
    step = C.mixture_step(points, model, V)
    k, dims = model.means.shape
    free = k * dims + k * dims * (dims + 1) / 2 + k - 1
    again = -2.0 * step.likelihood + free * math.log(row["n"])
    out = [(row["n"], len(model.weights), row["wrong_choice"], abs(again - bic) <= 1e-6 * abs(bic), *_settled(model, step))]
    names = "same_bic boolean, weights_settled boolean, means_settled boolean, covariances_settled boolean"
    return spark.createDataFrame(out, f"n bigint, clusters bigint, wrong_choice bigint, {names}")


def plain_silhouettes(points, clusters, key, sums=None):
    """(k, silhouette) from the definition, over the mean distances, which have a query of their own."""
    cells = cluster_distances(points, clusters, key, sums=sums).join(clusters.withColumnRenamed("cluster", "own"), ["k", key])
    each = cells.groupBy("k", key).agg(
        F.max(F.when(F.col("cluster") == F.col("own"), F.col("mean_distance"))).alias("a"),
        F.min(F.when(F.col("cluster") != F.col("own"), F.col("mean_distance"))).alias("b"),
    )
    value = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.groupBy("k").agg(F.avg(value).alias("silhouette"))


def plain_f1(clusters, truth, key):
    """(k, f1) of the majority label, from the definition."""
    rows = clusters.join(truth, key).where("truth IS NOT NULL").withColumn("own", (F.col("truth") == "positive").cast("int"))
    sizes = rows.groupBy("k", "cluster").agg(F.sum("own").alias("p"), F.sum(1 - F.col("own")).alias("q"))
    # A tie is negative.
    tp = F.sum(F.when(F.col("p") > F.col("q"), F.col("p")).otherwise(0))
    fp = F.sum(F.when(F.col("p") > F.col("q"), F.col("q")).otherwise(0))
    fn = F.sum(F.when(F.col("p") > F.col("q"), 0).otherwise(F.col("p")))
    score = sizes.groupBy("k").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    whole = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return score.select("k", F.when(whole > 0, 2.0 * F.col("tp") / whole).otherwise(0.0).alias("f1"))


@query(
    """SELECT method, 4::BIGINT AS k, count(*) AS n, count(*) AS clustered, true AS same_silhouette, true AS same_fit
FROM vec, (VALUES ('kmeans'), ('gmm')) t(method) GROUP BY 1""",
    ("vec",),
)
def cluster_and_evaluate(spark, sf):
    """Both methods: the silhouette from its definition over the clusters, the inertia around their means, and the BIC of a
    mixture that a step does not move."""
    points = checkpointed(X.vectors(spark, sf).select(V, "features"))
    out = None
    for method in ("kmeans", "gmm"):
        report, clusters = C.cluster_and_evaluate(points, 4, V, method)
        clusters, row = checkpointed(clusters), report.first()
        sizes = clusters.agg(F.count(F.lit(1)).alias("clustered"), F.countDistinct("cluster").alias("k")).first()
        direct = plain_silhouettes(points, clusters, V).first()["silhouette"]
        if method == "kmeans":
            spread = C.inertia(points, clusters, V).first()["inertia"]
            fit = abs(spread - row["fit"]) <= 1e-3 * spread
        else:
            fit = _same_mixture(points, clusters, row["fit"])
        one = (method, sizes["k"], row["n"], sizes["clustered"], abs(direct - row["silhouette"]) < 1e-9, fit)
        part = spark.createDataFrame(
            [one], "method string, k bigint, n bigint, clustered bigint, same_silhouette boolean, same_fit boolean"
        )
        out = part if out is None else out.unionByName(part)
    return out


def _same_mixture(points, clusters, bic) -> bool:
    """Whether the mixture that the clusters themselves make is about as likely as the fit claims."""
    hard = C.mixture_of(points, clusters, V)
    k, dims = hard.means.shape
    free = k * dims + k * dims * (dims + 1) / 2 + k - 1
    again = -2.0 * C.mixture_step(points, hard, V).likelihood + free * math.log(hard.rows)
    return bool(abs(again - bic) <= 0.01 * abs(bic))


@query(
    """SELECT k, count(*) AS n, k AS clusters, 0::BIGINT AS wrong_nearest, true AS same_quality, true AS same_diagnosis, k > 2 AS inertia_falls
FROM vec, range(2, 11) t(k) GROUP BY 1""",
    ("vec",),
)
def k_sweep(spark, sf):
    """A sweep of fitted clusterings over k = 2..10: all rows and clusters, rows nearer to the mean of another cluster than to their own's
    (beyond the tolerance), both rewards against their definitions over the clusters, and the inertia against the one before."""
    points = checkpointed(X.vectors(spark, sf).select(V, "features"))
    clusters = fit_sweep(points, V, X.KS)
    # All pairs are gone through once for the rewards and the definition.
    sums = checkpointed(distance_sums(points, clusters, V))
    quality = quality_rewards(points, clusters, V, X.KS, sums=sums).withColumnRenamed("reward", "quality")
    truth = X.vector_truth(spark, sf)
    diagnosis = diagnostic_rewards(clusters, truth, V, X.KS).withColumnRenamed("reward", "diagnosis")
    sizes = clusters.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("clusters"))
    spread = C.inertia(points, clusters, V)
    before = spread.select((F.col("k") + 1).alias("k"), F.col("inertia").alias("before"))
    means = C.cluster_means(points, clusters, V).select("k", "cluster", "center")
    near = C.nearest_centroid(points, means, V).withColumnsRenamed({"cluster": "closest", "distance2": "least"})
    own = clusters.join(points, V).join(F.broadcast(means), ["k", "cluster"]).select("k", V, squared_distance(F.col("features"), F.col("center")).alias("own"))
    wrong = near.join(own, ["k", V]).groupBy("k").agg(F.count_if(F.sqrt("own") > F.sqrt("least") + 0.05).alias("wrong_nearest"))
    every = quality.join(diagnosis, "k").join(sizes, "k").join(spread, "k").join(before, "k", "left").join(wrong, "k")
    every = every.join(plain_silhouettes(points, clusters, V, sums), "k").join(plain_f1(clusters, truth, V), "k")
    return every.select(
        "k",
        "n",
        "clusters",
        "wrong_nearest",
        (F.abs(F.col("quality") - F.col("silhouette")) < 1e-9).alias("same_quality"),
        (F.abs(F.col("diagnosis") - F.col("f1")) < 1e-9).alias("same_diagnosis"),
        F.coalesce(F.col("inertia") < F.col("before"), F.lit(False)).alias("inertia_falls"),
    )


def _gradients(scored, importance, names):
    """(feature, gap): how far each weight is from minus the gradient of the unpenalized loss, which it equals at the
    minimum of the loss with C = 1, relative to the sum of the feature's absolute values."""
    each = [F.sum((F.col("score") - F.col("y")) * F.get("features", F.lit(i))).alias(f"g{i}") for i in range(len(names))]
    each += [F.sum(F.abs(F.get("features", F.lit(i)))).alias(f"s{i}") for i in range(len(names))]
    row = scored.agg(*each).first()
    sums = [(n, abs(row[f"g{i}"]), row[f"s{i}"]) for i, n in enumerate(names)]
    table_ = scored.sparkSession.createDataFrame(sums, "feature string, gradient double, size double")
    gap = F.abs(F.col("abs_coefficient") - F.col("gradient")) / F.greatest(F.col("size"), F.lit(1.0))
    return importance.join(table_, "feature").select("feature", gap.alias("gap"))


@query("SELECT 'd' || i AS feature, 0.0::DOUBLE AS gap FROM range(64) t(i)")
def feature_importance(spark, sf):
    points = checkpointed(X.vectors(spark, sf).withColumn("y", F.col("label") % 2))
    names = [f"d{i}" for i in range(64)]
    importance, scored = ME.importance_and_scores(points, names, "y")
    return _gradients(scored, importance, names).select("feature", (F.round("gap", 4) + F.lit(0.0)).alias("gap"))


FOUND = ["size", "rest", "root"]


@query(
    """SELECT feature, i - 1 AS pos, round(e[i], 6) + 0.0 AS edge, true AS top, true AS auc_in_range FROM (
SELECT feature, list_reduce([[x] FOR x IN q], lambda a, x: list_append(a, CASE WHEN x[1] <= a[-1] THEN a[-1] + 1e-6 ELSE x[1] END)) AS e
FROM (SELECT feature, quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q
  FROM (SELECT unnest(['size', 'rest', 'root']) AS feature, unnest([size, rest, root]) AS v FROM docall JOIN labn USING (filename)) GROUP BY 1)),
range(1, 7) t(i)""",
    ("docall", "labn"),
)
def bin_discovery(spark, sf):
    """Edges of the features of all labeled files; stored and read back with importance, top features and AUC."""
    found = discover_bins(X.every_document(spark, sf), normalize_label_rows(X.label_rows(spark, sf)), FOUND)
    path = new_path(spark, "discovery")
    save_discovery(found, path)
    bins, top, weights, auc = (load_table(spark, path, n) for n in ("bins", "top_features", "feature_importance", "auc"))
    known = top.join(weights, "feature").select("feature", (F.col("abs_coefficient") >= 0).alias("top"))
    rows = bins.join(known, "feature", "left").select("feature", F.posexplode("edges").alias("pos", "edge"), "top")
    value = auc.first()["auc"]
    return rows.select(
        "feature", big("pos").alias("pos"), r6("edge").alias("edge"), F.coalesce("top", F.lit(False)).alias("top"),
        F.lit(value is not None and 0.0 <= value <= 1.0).alias("auc_in_range"),
    )


# ---- label agreement ----------------------------------------------------------

table(
    "vmaj",
    """SELECT k, cluster, count(*) FILTER (truth = 'positive') AS n_pos, count(*) FILTER (truth <> 'positive') AS n_neg,
  CASE WHEN count(*) FILTER (truth = 'positive') > count(*) FILTER (truth <> 'positive') THEN 'positive' ELSE 'negative' END AS label
FROM vasg JOIN vtruth USING (vec_id) GROUP BY 1, 2""",
    ("vasg", "vtruth"),
)


def _majority(spark, sf):
    _, clusters = _fixed(spark, sf)
    return clusters, ME.majority_label(clusters.join(X.vector_truth(spark, sf), V))


@query("SELECT * FROM vmaj", ("vmaj",))
def majority_label(spark, sf):
    return _majority(spark, sf)[1]


@query("SELECT k, vec_id, cluster, label FROM vasg JOIN vmaj USING (k, cluster)", ("vasg", "vmaj"))
def cluster_label_join(spark, sf):
    clusters, votes = _majority(spark, sf)
    return C.cluster_label_join(clusters, votes)


@query(
    "SELECT k, vec_id, CASE WHEN cluster = 0 THEN 'positive' ELSE 'negative' END AS label FROM vasg", ("vasg",)
)
def default_label(spark, sf):
    _, clusters = _fixed(spark, sf)
    return clusters.select("k", V, C.default_label(F.col("cluster")).alias("label"))


table(
    "vout",
    """SELECT k, count(*) FILTER (truth = 'positive' AND label = 'positive')::DOUBLE AS tp,
  count(*) FILTER (truth <> 'positive' AND label = 'positive')::DOUBLE AS fp,
  count(*) FILTER (truth = 'positive' AND label <> 'positive')::DOUBLE AS fn,
  count(*) FILTER (truth <> 'positive' AND label <> 'positive')::DOUBLE AS tn
FROM vasg JOIN vmaj USING (k, cluster) JOIN vtruth USING (vec_id) GROUP BY 1""",
    ("vasg", "vmaj", "vtruth"),
)
F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END"
ROOT = "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"
MCC = f"(CASE WHEN {ROOT} > 0 THEN (tp * tn - fp * fn) / {ROOT} ELSE 0 END + 1) / 2"
ACC = "(tp + tn) / (tp + fp + fn + tn)"


@query(
    f"SELECT k, round({F1}, 6) + 0.0 AS f1, round({MCC}, 6) + 0.0 AS mcc, round({ACC}, 6) + 0.0 AS accuracy FROM vout",
    ("vout",),
)
def diagnostic_reward(spark, sf):
    _, clusters = _fixed(spark, sf)
    truth = X.vector_truth(spark, sf)
    out = None
    for m in ME.MEASURES:
        one = diagnostic_rewards(clusters, truth, V, X.KS, m).select("k", r6("reward").alias(m))
        out = one if out is None else out.join(one, "k")
    return out


table(
    "lout",
    """SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (quality <> 1 AND toxic = 1)::DOUBLE AS fp,
  count(*) FILTER (quality = 1 AND toxic <> 1)::DOUBLE AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1)::DOUBLE AS tn FROM labels""",
)


def _outcomes(spark, sf):
    return parquet(spark, sf, "labels").agg(*ME.outcome_counts(F.col("quality") == 1, F.col("toxic") == 1))


def _metric(name: str, sql: str, column) -> None:
    @query(f"SELECT round({sql}, 6) + 0.0 AS {name} FROM lout", ("lout",), name=f"{name}_metric")
    def run(spark, sf):
        return _outcomes(spark, sf).select(r6(column()).alias(name))


_metric("f1", F1, ME.f1_score)
_metric("mcc", MCC, ME.mcc_score)
_metric("accuracy", ACC, ME.accuracy_score)


@query(
    """SELECT t.c AS truth, p.c AS pred, count(l.doc_id) AS n
FROM (VALUES (0), (1)) t(c) CROSS JOIN (VALUES (0), (1)) p(c) LEFT JOIN labels l ON l.quality = t.c AND l.toxic = p.c GROUP BY 1, 2"""
)
def confusion_matrix(spark, sf):
    return ME.confusion_matrix(parquet(spark, sf, "labels"), "quality", "toxic")


@query(
    """SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
  round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) + 0.0 AS auc
FROM (SELECT y, avg(rn) OVER (PARTITION BY s) AS r FROM (
  SELECT quality::BIGINT AS y, n_chars % 50 + 0.5 * (doc_id % 3) AS s,
    row_number() OVER (ORDER BY n_chars % 50 + 0.5 * (doc_id % 3)) AS rn FROM labels JOIN documents USING (doc_id)))"""
)
def roc_auc(spark, sf):
    docs, labels = parquet(spark, sf, "documents"), parquet(spark, sf, "labels")
    score = (F.col("n_chars") % 50 + F.col("doc_id") % 3 * 0.5).cast("double")
    scored = labels.join(docs.select("doc_id", "n_chars"), "doc_id").withColumn("s", score)
    return rounded(ME.roc_auc(scored, "s", "quality"), "auc")


@query(
    """SELECT 'd' || (i - 1) AS feature, round(abs(avg(features[i])), 6) + 0.0 AS abs_coefficient
FROM vec, range(1, 65) t(i) GROUP BY i ORDER BY abs(avg(features[i])) DESC, feature LIMIT 3""",
    ("vec",),
)
def top_features(spark, sf):
    """Top 3 of an importance table; here the absolute means of the components."""
    cells = X.vectors(spark, sf).select(F.posexplode("features").alias("dim", "x"))
    table_ = cells.groupBy("dim").agg(F.abs(F.avg("x")).alias("abs_coefficient"))
    named = table_.select(F.concat(F.lit("d"), F.col("dim").cast("string")).alias("feature"), "abs_coefficient")
    return rounded(ME.top_features(named), "abs_coefficient")
