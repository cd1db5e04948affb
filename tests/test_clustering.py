import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.operators import clustering as C
from markerloom.operators import kmeans as K
from markerloom.operators import metrics as ME
from markerloom.operators.silhouette import cluster_distances, lines_of, plane_order, silhouette


def points_of(spark, x, parts=3):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, features array<double>").repartition(parts)


def clusters_of(spark, labels, k=2):
    rows = [(k, i, int(c)) for i, c in enumerate(labels)]
    return spark.createDataFrame(rows, "k bigint, id bigint, cluster bigint")


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == c].mean() for c in set(labels.tolist()) - {own})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block_rows", [7, 40, 2048])
def test_silhouette_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 4)) + 1e3
    x[5] = x[6] = x[7]
    two, five = rng.integers(0, 2, 90), rng.integers(0, 5, 90) * 3
    five[11] = 99
    both = clusters_of(spark, two, 2).unionByName(clusters_of(spark, five, 6))
    got = {r["k"]: r["silhouette"] for r in silhouette(points_of(spark, x), both, "id", block_rows).collect()}
    assert got == {2: pytest.approx(brute_silhouette(x, two), abs=1e-9), 6: pytest.approx(brute_silhouette(x, five), abs=1e-9)}


def test_silhouette_of_one_hot_cluster(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    labels = (np.arange(300) % 50 == 0).astype(int)
    got = silhouette(points_of(spark, x), clusters_of(spark, labels), "id", 32).first()["silhouette"]
    assert got == pytest.approx(brute_silhouette(x, labels), abs=1e-9)


def test_undefined_silhouettes_are_zero(spark):
    x = np.arange(6.0).reshape(3, 2)
    for labels in ([0, 0, 0], [0, 1, 2]):
        assert silhouette(points_of(spark, x), clusters_of(spark, labels), "id").first()["silhouette"] == 0.0
    same = np.ones((4, 2))
    assert silhouette(points_of(spark, same), clusters_of(spark, [0, 0, 1, 1]), "id").first()["silhouette"] == 0.0


def test_string_keys(spark):
    x = np.random.default_rng(2).normal(size=(20, 2))
    labels = np.arange(20) % 3
    points = points_of(spark, x).withColumn("id", F.concat(F.lit("p"), "id"))
    clusters = clusters_of(spark, labels).withColumn("id", F.concat(F.lit("p"), "id"))
    assert silhouette(points, clusters, "id", 6).first()["silhouette"] == pytest.approx(brute_silhouette(x, labels))
    assert cluster_distances(points, clusters, "id", 6).count() == 60


def test_planes_grow_with_the_rows():
    assert [plane_order(n) for n in (1, 256, 257, 700, 2000, 10**5, 10**6)] == [0, 0, 1, 1, 3, 11, 11]
    for rows in (10**7, 10**8):
        p = plane_order(rows)
        assert (p + 1) * rows <= 131_072 * (p * p + p + 1)


@pytest.mark.parametrize("p", [0, 1, 2, 3, 5, 11])
def test_any_two_blocks_meet_on_one_line(spark, p):
    """Also a block with itself, at its home; a row has p + 1 copies, 12 at the most until groups are full."""
    points = spark.range(p * p + p + 1).select(F.col("id").cast("int").alias("b"))
    found = {r["b"]: r["lines"] for r in points.select("b", lines_of(F.col("b"), p).alias("lines")).collect()}
    assert all(len(set(lines)) == len(lines) == p + 1 for lines in found.values())
    assert all(0 <= line <= p * p + p for lines in found.values() for line in lines)
    for a in found:
        for b in found:
            if a != b:
                assert len(set(found[a]) & set(found[b])) == 1


@pytest.mark.parametrize("limit", [10_000, 2])
def test_nearest_centroid(spark, limit):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    rows = [(k, c, x[c].tolist()) for k in (2, 4) for c in range(k)]
    centers = spark.createDataFrame(rows, "k bigint, cluster bigint, center array<double>")
    got = {(r["k"], r["id"]): (r["cluster"], r["distance2"]) for r in C.nearest_centroid(points_of(spark, x), centers, "id", limit).collect()}
    assert len(got) == 120
    for (k, i), (c, d2) in got.items():
        d = ((x[i] - x[:k]) ** 2).sum(1)
        assert c == d.argmin() and d2 == pytest.approx(d.min(), abs=1e-12)


def test_inertia(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3)) + 1e4
    labels = rng.choice([0, 3, 8], 50)
    labels[0] = 5
    clusters, points = clusters_of(spark, labels), points_of(spark, x)
    mean = sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in set(labels.tolist()))
    assert C.inertia(points, clusters, "id").first()["inertia"] == pytest.approx(mean, rel=1e-9)
    given = {c: rng.normal(size=3) + 1e4 for c in set(labels.tolist())}
    rows = [(2, c, v.tolist()) for c, v in given.items()]
    centers = spark.createDataFrame(rows, "k bigint, cluster bigint, center array<double>")
    want = sum(((x[labels == c] - v) ** 2).sum() for c, v in given.items())
    assert C.inertia(points, clusters, "id", centers).first()["inertia"] == pytest.approx(want, rel=1e-9)


def blobs(n=200, k=4, seed=5):
    rng = np.random.default_rng(seed)
    truth = np.arange(n) % k
    return rng.normal(size=(k, 3))[truth] * 20 + rng.normal(size=(n, 3)), truth


def test_kmeans_finds_blobs_in_lexicographic_order(spark):
    x, truth = blobs()
    clusters, cost, centers = C.kmeans(points_of(spark, x), 4, "id", restarts=3)
    labels = np.array([r["cluster"] for r in clusters.orderBy("id").collect()])
    for t in range(4):
        assert len(set(labels[truth == t])) == 1
    mid = [r["center"] for r in centers.orderBy("cluster").collect()]
    assert mid == sorted(mid)
    want = sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in range(4))
    assert cost == pytest.approx(want, rel=1e-9)


def test_kmeans_does_not_depend_on_partitioning(spark):
    x = np.random.default_rng(6).normal(size=(300, 5))
    fits = []
    for parts in (1, 4, 9):
        fit = K.fit_runs(points_of(spark, x, parts), "id", [2, 5], 300, restarts=2)
        fits.append({k: (cost, c) for k, (cost, c) in fit.items()})
    for other in fits[1:]:
        for k in (2, 5):
            assert other[k][0] == pytest.approx(fits[0][k][0], rel=1e-12)
            np.testing.assert_allclose(other[k][1], fits[0][k][1], atol=1e-9)


def test_inertia_falls_with_k_and_restarts(spark):
    x = np.random.default_rng(7).normal(size=(250, 4))
    points = points_of(spark, x)
    many = K.fit_runs(points, "id", [2, 3, 4, 5], 250, restarts=4)
    costs = [many[k][0] for k in (2, 3, 4, 5)]
    assert costs == sorted(costs, reverse=True)
    few = K.fit_runs(points, "id", [5], 250, restarts=1)
    assert many[5][0] <= few[5][0] + 1e-9


def test_lloyd_equals_numpy(spark):
    x = np.random.default_rng(8).normal(size=(120, 3))
    start = x[:4].copy()
    want = start.copy()
    for _ in range(5):
        own = ((x[:, None] - want[None]) ** 2).sum(-1).argmin(1)
        want = np.array([x[own == c].mean(0) for c in range(4)])
    cost = ((x[:, None] - want[None]) ** 2).sum(-1).min(1).sum()
    ready = K.prepared(points_of(spark, x, 4), "id", 120).repartition(5)
    for count in (5, K.FEW_PARTITIONS + 1):
        got, inertia = K.lloyd(ready, {(4, 0): start}, 5, -1.0, np.zeros(3), count)[4, 0]
        np.testing.assert_allclose(got, want, atol=1e-12)
        assert inertia == pytest.approx(cost, rel=1e-12)


def test_identical_rows_still_give_k_centers(spark):
    x = np.ones((10, 2))
    cost, centers = K.fit_runs(points_of(spark, x), "id", [3], 10, restarts=2)[3]
    assert cost == pytest.approx(0.0) and centers.shape == (3, 2)


def test_more_clusters_than_samples(spark):
    points = points_of(spark, np.eye(3))
    with pytest.raises(ValueError):
        C.kmeans(points, 4, "id")
    with pytest.raises(ValueError):
        C.gaussian_mixture(points, 4, "id")
    assert {r["k"] for r in C.kmeans_sweep(points, "id", range(2, 6), restarts=1).collect()} == {2, 3}


def test_gaussian_mixture(spark):
    x, truth = blobs(120, 2)
    clusters, bic, model = C.gaussian_mixture(points_of(spark, x), 2, "id")
    labels = np.array([r["cluster"] for r in clusters.orderBy("id").collect()])
    assert len(set(zip(labels.tolist(), truth.tolist()))) == 2
    assert bic < C.gaussian_mixture(points_of(spark, x), 3, "id")[1]
    for c in range(2):
        own = x[labels == c]
        np.testing.assert_allclose(model.means[c], own.mean(axis=0), atol=1e-2)
        np.testing.assert_allclose(model.covariances[c], np.cov(own.T, bias=True), atol=2e-2)


def test_mixture_step_equals_numpy(spark):
    x = np.random.default_rng(12).normal(size=(90, 3)) + np.repeat(np.eye(3) * 3, 30, axis=0)
    weights, means = np.array([0.2, 0.8]), np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 2.0]])
    covariances = np.stack([np.eye(3) * 2, np.eye(3) + 0.3])
    given = C.Mixture(weights, means, covariances, np.nan, 90)
    dense = np.stack(
        [
            w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(v), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * v))
            for w, m, v in zip(weights, means, covariances)
        ]
    ).T
    r = dense / dense.sum(axis=1, keepdims=True)
    step = C.mixture_step(points_of(spark, x, 5), given, "id")
    assert step.likelihood == pytest.approx(np.log(dense.sum(axis=1)).sum())
    np.testing.assert_allclose(step.weights, r.mean(axis=0))
    for c in range(2):
        mean = r[:, c] @ x / r[:, c].sum()
        np.testing.assert_allclose(step.means[c], mean)
        np.testing.assert_allclose(step.covariances[c], (x - mean).T @ ((x - mean) * r[:, c : c + 1]) / r[:, c].sum() + 1e-6 * np.eye(3))


def test_a_wrong_mixture_does_not_settle(spark):
    from dataclasses import replace

    from markerloom.catalog.groups import _settled

    points = points_of(spark, blobs(150, 3)[0])
    _, _, model = C.gaussian_mixture(points, 3, "id")
    assert _settled(model, C.mixture_step(points, model, "id")) == (True, True, True)
    for wrong in (
        replace(model, covariances=model.covariances * 1.5),
        replace(model, means=model.means + 1.0),
        replace(model, weights=np.array([0.8, 0.1, 0.1])),
    ):
        assert not all(_settled(wrong, C.mixture_step(points, wrong, "id")))


def test_seeding_needs_few_jobs_and_any_number_of_centers(spark):
    x, _ = blobs(400, 4)
    ready = K.prepared(points_of(spark, x, 6), "id", 400)
    mean = x.mean(axis=0)
    runs = [(k, r) for k in (2, 7, 40) for r in range(2)]
    starts = K.spread_centers(ready, runs, 1, mean)
    for (k, _), c in starts.items():
        assert c.shape == (k, x.shape[1]) and len(np.unique(c, axis=0)) == k
    again = K.spread_centers(K.prepared(points_of(spark, x, 3), "id", 400), runs, 1, mean)
    assert all((again[r] == starts[r]).all() for r in runs)


def test_mixture_of_fewer_rows_than_dimensions(spark):
    x = np.random.default_rng(3).normal(size=(12, 30))
    clusters, bic, model = C.gaussian_mixture(points_of(spark, x), 3, "id")
    assert np.isfinite(bic) and clusters.count() == 12 and model.weights.sum() == pytest.approx(1.0)


def test_ties_go_to_the_lower_number(spark):
    grid = np.array([(a, b) for a in range(40) for b in range(40)], dtype=float) * 1e3 + 0.1
    centers = [(2, i, [a * 1e3 + 0.1, b * 1e3 + 0.1]) for i, (a, b) in enumerate([(0, 0), (10, 10), (0, 10), (10, 0), (20, 5)])]
    table = spark.createDataFrame(centers, "k bigint, cluster bigint, center array<double>")
    at = np.array([c for *_, c in centers])
    want = (((grid[:, None] - at[None]) / 1e3).round() ** 2).sum(-1).argmin(1)
    got = C.nearest_centroid(points_of(spark, grid), table, "id").orderBy("id").collect()
    assert [r["cluster"] for r in got] == want.tolist()


@pytest.mark.parametrize("few", [64, 2])
def test_same_bits_for_any_partitioning(spark, monkeypatch, few):
    monkeypatch.setattr(K, "FEW_PARTITIONS", few)
    monkeypatch.setattr(K, "LEAST_ROWS", 20)
    x = np.random.default_rng(5).normal(size=(200, 3))
    fits = [K.fit_runs(points_of(spark, x).repartition(n), "id", [3], 200, restarts=2)[3] for n in (1, 7, 40)]
    assert K.partitions(200) == 10
    for cost, centers in fits[1:]:
        assert cost == fits[0][0] and (centers == fits[0][1]).all()


def test_no_sample_is_lost(spark):
    chosen = spark.createDataFrame([(1, 2), (2, 5)], "id bigint, k bigint")
    clusters = spark.createDataFrame([(2, 1, 0), (2, 2, 1)], "k bigint, id bigint, cluster bigint")
    assert C.cluster_lookup(chosen.where("k = 2"), clusters, "id").collect() == [(1, 2, 0)]
    with pytest.raises(Exception, match="no cluster of 2 for cluster count 5"):
        C.cluster_lookup(chosen, clusters, "id").collect()


def test_silhouette_of_a_ragged_sweep(spark):
    x, _ = blobs(60, 3)
    points = points_of(spark, x)
    rows = [(2, i, i % 2) for i in range(0, len(x), 2)] + [(3, i, i % 3) for i in range(len(x))]
    rows = [(k, i, (i // 2) % 2 if k == 2 else c) for k, i, c in rows]
    clusters = spark.createDataFrame(rows, "k bigint, id bigint, cluster bigint")
    both = {r["k"]: r["silhouette"] for r in silhouette(points, clusters, "id").collect()}
    for k in (2, 3):
        alone = silhouette(points, clusters.where(F.col("k") == k), "id").first()["silhouette"]
        assert both[k] == pytest.approx(alone, abs=1e-12)


def test_cluster_and_evaluate(spark):
    points = points_of(spark, blobs(80, 3)[0])
    report, clusters = C.cluster_and_evaluate(points, 3, "id")
    row = report.first()
    assert clusters.count() == 80
    assert (row["method"], row["k"], row["n"]) == ("kmeans", 3, 80) and 0.5 < row["silhouette"] <= 1
    assert C.cluster_and_evaluate(points, 3, "id", "gmm")[0].first()["method"] == "gmm"
    with pytest.raises(ValueError):
        C.cluster_and_evaluate(points, 3, "id", "dbscan")


# ---- agreement with labels ---------------------------------------------------


def test_majority_and_tie(spark):
    rows = [(2, 0, "positive"), (2, 0, "negative"), (2, 1, "positive"), (2, 1, "positive"), (2, 1, None)]
    got = {r["cluster"]: (r["n_pos"], r["n_neg"], r["label"]) for r in ME.majority_label(spark.createDataFrame(rows, "k int, cluster int, truth string")).collect()}
    assert got == {0: (1, 1, "negative"), 1: (2, 1, "positive")}


@pytest.mark.parametrize("truth, pred", [("1100110", "1010100"), ("111", "111"), ("000", "000"), ("01", "10"), ("0011", "0000")])
def test_scores(spark, truth, pred):
    df = spark.createDataFrame([(a == "1", b == "1") for a, b in zip(truth, pred)], "t boolean, p boolean")
    row = df.agg(*ME.outcome_counts(F.col("t"), F.col("p"))).select(
        ME.f1_score().alias("f1"), ME.mcc_score().alias("mcc"), ME.accuracy_score().alias("acc")
    ).first()
    t, p = (np.array([c == "1" for c in s]) for s in (truth, pred))
    tp, fp, fn = (t & p).sum(), (~t & p).sum(), (t & ~p).sum()
    assert row["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
    assert row["acc"] == pytest.approx((t == p).mean())
    mcc = 0.0 if t.std() == 0 or p.std() == 0 else np.corrcoef(t, p)[0, 1]
    assert row["mcc"] == pytest.approx((mcc + 1) / 2)


def test_unknown_measure():
    with pytest.raises(ValueError):
        ME.measure("auc")


def test_confusion_matrix_has_all_pairs(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "t string, p string")
    got = {(r["truth"], r["pred"]): r["n"] for r in ME.confusion_matrix(df, "t", "p").collect()}
    assert len(got) == 9 and got["a", "b"] == 2 and got["b", "c"] == 1 and got["c", "c"] == 0


def test_auc(spark):
    rng = np.random.default_rng(9)
    s, y = rng.integers(0, 12, 200) / 7.0, rng.integers(0, 2, 200)
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean()
    assert ME.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(want)
    assert ME.roc_auc(df.where("y = 1"), "s", "y").first()["auc"] is None


def test_regression_minimizes_the_penalized_loss(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(150, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=150) > 0).astype(int)
    df = points_of(spark, x).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id bigint, y int"), "id")
    importance, scored = ME.importance_and_scores(df, ["a", "b", "c"], "y")
    w = {r["feature"]: r["abs_coefficient"] for r in importance.collect()}
    rows = scored.orderBy("id").collect()
    p = np.array([r["score"] for r in rows])
    gradient = x.T @ (p - y)
    # C = 1: the weights equal minus the gradient of the unpenalized loss.
    np.testing.assert_allclose(np.abs(gradient), [w[c] for c in "abc"], atol=1e-4)
    assert [r["feature"] for r in ME.top_features(importance, 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        ME.importance_and_scores(df.where("y = 1"), ["a", "b", "c"], "y")


def test_newton_steps_reach_the_minimum(spark):
    """Features of very different size and place, and classes that can be separated, in few jobs."""
    from markerloom.operators.regression import FitError, fit_logistic

    rng = np.random.default_rng(14)
    x = rng.normal(size=(300, 3)) * [1.0, 100.0, 0.01] + [5.0, 3000.0, 0.0]
    for y, most in (((x[:, 0] > 5) ^ (rng.random(300) < 0.2), 15), (x[:, 1] > 3000, 25)):
        y = y.astype(int)
        rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "features array<double>, y int").repartition(3)
        fit = fit_logistic(rows, "y", 300)
        p = 1 / (1 + np.exp(-(x @ fit.weights + fit.intercept)))
        gradient = np.append(x.T @ (p - y) + fit.weights, (p - y).sum())
        assert (np.abs(gradient) <= 1e-8 * np.append(np.abs(x).sum(axis=0) + 1, 300)).all()
        assert fit.jobs <= most
        got = [r["s"] for r in rows.select("features", fit.score("features").alias("s")).collect()]
        want = {tuple(a): b for a, b in zip(x.tolist(), p)}
        assert got == pytest.approx([want[tuple(r["features"])] for r in rows.select("features").collect()])
    with pytest.raises(FitError):
        fit_logistic(spark.createDataFrame([([float("nan")], 0), ([1.0], 1)], "features array<double>, y int"), "y", 2)


def test_nearest_marks_of_runs_side_by_side():
    """The same centers as `nearest` for every run, at ties the first and only one."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (300, 4)).astype("float64")
    for k in (1, 2, 5):
        c = rng.integers(0, 3, (3 * k, 4)).astype("float64")
        d = -2.0 * c @ x.T + (c * c).sum(axis=1)[:, None]
        marks = np.full(d.shape, 7.0)
        K.nearest_marks(x, c, d, k, marks)
        for run in range(3):
            own, _ = K.nearest(x, c[run * k : run * k + k])
            assert np.array_equal(marks[run * k : run * k + k], own[None, :] == np.arange(k)[:, None])


def test_small_matrices_have_few_tasks():
    """A task costs more than the updates of some thousand rows."""
    assert K.partitions(2_000) == 1 and K.partitions(12_800) == 6
    assert K.partitions(600_000) == 32 and K.partitions(6_000_000) == 300


def test_sums_of_one_pass_serve_both(spark, monkeypatch):
    import markerloom.operators.silhouette as S

    x = np.random.default_rng(9).normal(size=(40, 3))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    clusters = spark.createDataFrame([(k, i, i % k) for k in (2, 3) for i in range(40)], "k long, id long, cluster long")
    apart = [sorted(map(tuple, f(points, clusters, "id").collect())) for f in (S.silhouette, S.cluster_distances)]
    sums = S.distance_sums(points, clusters, "id").persist()
    monkeypatch.setattr(S, "_distance_sums", None)
    for f, want in zip((S.silhouette, S.cluster_distances), apart):
        got = sorted(map(tuple, f(points, clusters, "id", sums=sums).collect()))
        assert [r[:-1] for r in got] == [r[:-1] for r in want] and np.allclose([r[-1] for r in got], [r[-1] for r in want], rtol=1e-12)
    sums.unpersist()


def test_strips_of_near_and_equal_rows(monkeypatch):
    """Distances of far, near and equal rows in the same strip."""
    import markerloom.operators.silhouette as S

    rng = np.random.default_rng(10)
    a = rng.normal(size=(30, 5)) + 1000.0
    b = np.vstack([a[:10], a[10:20] + 1e-7, rng.normal(size=(10, 5))])
    want = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    assert np.allclose(S._block_distances(a, b), want, rtol=1e-9, atol=0.0)
