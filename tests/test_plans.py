import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.operators import qtable as Q
from markerloom.operators.binning import bins_to_dict
from markerloom.plans import train as TR
from markerloom.plans.discover import discover_bins
from markerloom.plans.profile import profile_samples
from markerloom.plans.score import score_new, score_samples
from markerloom.session import new_path
from markerloom.sources import tables as T
from markerloom.sources.commits import newest_commit
from markerloom.streaming.scoring import read_parts, run_available, stream_score
from markerloom.streaming.updates import current_table, stream_q_update

P = Q.Learning(min_k=2, max_k=4, iterations=20, batch=5)
INF = float("inf")
BINS = {"a": [0.0, 0.5, 1.0, 2.0, 3.0, INF], "b": [0.0, 0.5, 1.0, 2.0, 3.0, INF]}


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(24):
        name = f"s{s:02d}_" + ("pos" if s % 2 else "neg" if s % 3 else "none") + ".fcs"
        rows += [(s, name, *[float(v) for v in rng.normal(loc=(s % 4) * 150 - 40, scale=60, size=2)]) for _ in range(9)]
    cells = spark.createDataFrame(rows, "sid bigint, filename string, a double, b double")
    return profile_samples(cells, ["sid"], ["a", "b"], BINS, ["a", "b"], name="filename").persist()


def points(samples):
    return samples.select("sid", F.array("a", "b").alias("features"))


def test_full_run_and_scoring(spark, samples):
    path = new_path(spark, "agent")
    TR.train_full(samples.where("label = 'positive'"), samples, "sid", ["a", "b"], path, P)
    log = T.load_table(spark, path, "log")
    assert {(r["phase"], r["count"]) for r in log.groupBy("phase").count().collect()} == {(1, 20), (2, 20)}
    assert log.where("phase = 2 AND iteration = 19").first()["exploration_rate"] == pytest.approx(0.3 * 0.995**40)
    params = T.load_table(spark, path, "params").first()
    assert (params["done"], params["n_actions"], params["gamma"]) == (40, 3, 0.9)
    assert T.load_table(spark, path, "episodes").count() == 40
    first = T.load_table(spark, f"{path}/phase1", "visits")
    positive = {r["state"] for r in samples.where("label = 'positive'").select("state").collect()}
    assert {r["state"] for r in first.select("state").collect()} <= positive
    assert TR.load_params(spark, path) == (P, 40)
    new = score_new(samples, "sid", ["a", "b"], path, new_path(spark, "scored"), 25)
    assert new.count() == 24 and new.where("assigned_cluster IS NULL").count() == 0
    with pytest.raises(ValueError):
        score_new(samples.limit(0), "sid", ["a", "b"], path, "x")
    with pytest.raises(Exception, match="no cluster"):
        # All states prefer four clusters, which two samples cannot have.
        always = spark.createDataFrame([(s, 2, 1.0) for s in range(25)], "state bigint, action bigint, q double")
        two = samples.limit(2).persist()
        score_samples(two, TR.fit_sweep(points(two), "sid", [2, 3, 4]), always, "sid", P, 25).collect()
    q = T.load_table(spark, path, "q")
    clusters = TR.fit_sweep(points(samples), "sid", [2, 3, 4], restarts=2)
    scored = score_samples(samples, clusters, q, "sid", P, 25)
    assert scored.columns == ["filename", "encoded_state", "selected_cluster_count", "assigned_cluster", "predicted_hiv_status"]
    rows = scored.collect()
    assert len(rows) == 24
    for r in rows:
        assert 2 <= r["selected_cluster_count"] <= 4 and r["assigned_cluster"] < r["selected_cluster_count"]
        assert (r["assigned_cluster"] == 0) == (r["predicted_hiv_status"] == "positive")
    out = new_path(spark, "predictions")
    T.write_predictions(scored, out)
    back = T.read_predictions(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows))


def test_failed_cluster_counts_get_the_penalty(spark, samples):
    few = samples.where("sid < 3")
    clusters = TR.fit_sweep(points(few), "sid", [2, 3, 4, 5], restarts=1)
    quality = TR.reward_map(TR.quality_rewards(points(few), clusters, "sid", [2, 3, 4, 5]))
    assert quality[4] == quality[5] == -1.0 and quality[3] == 0.0
    truth = few.select("sid", F.lit("positive").alias("truth"))
    diagnosis = TR.reward_map(TR.diagnostic_rewards(clusters, truth, "sid", [2, 3, 4, 5]))
    assert diagnosis == {2: 1.0, 3: 1.0, 4: 0.0, 5: 0.0}


def _agent(spark, samples):
    path = new_path(spark, "agent")
    TR.train_phase1(samples, "sid", ["a", "b"], path, P)
    return path


def test_phase2_has_a_matrix_of_its_own(spark, samples, monkeypatch):
    """Gaps of labeled samples are filled with the median of the labeled ones."""
    odd = samples.withColumn("a", F.when(F.col("sid") == 1, None).otherwise(F.col("a"))).persist()
    seen = []
    real = TR.fit_sweep
    monkeypatch.setattr(TR, "fit_sweep", lambda points, *a, **k: seen.append(points) or real(points, *a, **k))
    TR.train_phase2(odd, "sid", ["a", "b"], _agent(spark, odd), new_path(spark, "two"))
    labeled = odd.where("label IS NOT NULL")
    filled = {r["sid"]: r["features"] for r in seen[-1].collect()}
    assert filled.keys() == {r["sid"] for r in labeled.collect()}
    assert filled[1][0] == pytest.approx(np.median([r["a"] for r in labeled.collect() if r["a"] is not None]))


def test_unknown_measures_and_empty_input(spark, samples):
    with pytest.raises(ValueError):
        TR.quality_rewards(points(samples), None, "sid", [2], "gap")
    with pytest.raises(ValueError):
        TR.diagnostic_rewards(None, None, "sid", [2], "auc")
    with pytest.raises(ValueError):
        TR.train_full(samples.limit(0), samples, "sid", ["a", "b"], "x", P)
    with pytest.raises(ValueError):
        TR.train_phase2(samples.where("label IS NULL"), "sid", ["a", "b"], _agent(spark, samples), "x")
    with pytest.raises(ValueError):
        TR.fit_sweep(points(samples).limit(1), "sid", [2, 3])


def test_discovery(spark, samples):
    labels = samples.select("filename", F.when(F.col("sid") % 2 == 1, "HEU").otherwise("UE").alias("label"))
    found = discover_bins(samples, labels, ["a", "b"])
    edges = bins_to_dict(found["bins"])
    a = np.array([r["a"] for r in samples.collect()])
    np.testing.assert_allclose(edges["a"], np.quantile(a, [0, 0.2, 0.4, 0.6, 0.8, 1]), rtol=1e-12)
    assert set(found["top_features"]) == {"a", "b"} and 0 <= found["auc"].first()["auc"] <= 1
    one_class = discover_bins(samples, labels.withColumn("label", F.lit("HEU")), ["a", "b"], ["b"])
    assert one_class["top_features"] == ["b"] and one_class["auc"] is None
    with pytest.raises(ValueError):
        discover_bins(samples, labels.limit(0), ["a", "b"])


def test_saved_bins_and_labels(spark, samples):
    path = new_path(spark, "bins")
    bins = spark.createDataFrame([("a", [0.0, 1.0])], "feature string, edges array<double>")
    T.save_tables({"bins": bins}, path)
    assert bins_to_dict(T.load_table(spark, path, "bins")) == {"a": [0.0, 1.0]}
    csv = new_path(spark, "labels")
    rows = [("7", "HEU", "x"), (None, "UE", "x"), ("12345", "UE", "x"), ("9", None, "x")]
    spark.createDataFrame(rows, "FCSFileName string, Label string, Extra string").write.option("header", True).csv(csv)
    assert {r["filename"] for r in T.scan_labels(spark, csv).collect()} == {"0007.FCS", "12345.FCS"}


def test_stream_scores_like_batch(spark, samples):
    arriving = new_path(spark, "arriving")
    summaries = samples.select("sid", "a", "b")
    summaries.repartition(5).write.parquet(arriving)
    q = spark.createDataFrame([(s, (s * 7) % 3, 1.0) for s in range(0, 25, 2)], "state bigint, action bigint, q double")
    stream = stream_score(read_parts(spark, summaries.schema, arriving, 2), q, BINS, ["a", "b"], P)
    out = run_available(stream.select("sid", "state", "action", "k"), new_path(spark, "out"), new_path(spark, "cp"))
    got = {r["sid"]: (r["state"], r["action"], r["k"]) for r in out.collect()}
    for r in samples.collect():
        action = (r["state"] * 7) % 3 if r["state"] % 2 == 0 else 0
        assert got[r["sid"]] == (r["state"], action, action + 2)


def test_stream_updates_in_any_order(spark):
    """Transitions that arrive out of order, twice, and over several runs, one file a micro-batch."""
    rng = np.random.default_rng(3)
    schema = "state bigint, seq bigint, action bigint, reward double"
    rows = [(s, i + 1, int(rng.integers(0, 9)), float(rng.random())) for s in range(4) for i in range(60)]
    mixed = [rows[i] for i in rng.permutation(len(rows))]
    arriving, path, progress = (new_path(spark, n) for n in ("arriving", "versions", "cp"))
    for turn in range(3):
        part = mixed[turn * 80 : (turn + 1) * 80] + mixed[:10]
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(arriving)
        q = stream_q_update(read_parts(spark, spark.read.parquet(arriving).schema, arriving, 1), path, progress)
        if turn == 0:
            assert current_table(spark, path, "pending").count() > 0
    assert current_table(spark, path, "pending").count() == 0
    got = {(r["state"], r["action"]): r["q"] for r in q.collect()}
    want = {(r["state"], r["action"]): r["q"] for r in Q.q_update(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)
    assert {r["last"] for r in current_table(spark, path, "applied").collect()} == {60}


def test_stream_waits_for_gaps(spark):
    schema = "state bigint, seq bigint, action bigint, reward double"
    arriving, path, progress = (new_path(spark, n) for n in ("arriving", "versions", "cp"))
    spark.createDataFrame([(1, 1, 0, 1.0), (1, 3, 0, 1.0), (2, 2, 0, 1.0)], schema).write.parquet(arriving)
    q = stream_q_update(read_parts(spark, spark.read.parquet(arriving).schema, arriving, 1), path, progress)
    assert {(r["state"], r["action"]): r["q"] for r in q.where("q <> 0").collect()} == {(1, 0): pytest.approx(0.1)}
    assert sorted((r["state"], r["seq"]) for r in current_table(spark, path, "pending").collect()) == [(1, 3), (2, 2)]


SCHEMA = "state bigint, seq bigint, action bigint, reward double"


def _fed(spark, parts, path, progress, **options):
    """The parts as one file and one micro-batch each."""
    arriving = new_path(spark, "arriving")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(arriving)
    stream = read_parts(spark, spark.read.parquet(arriving).schema, arriving, 1)
    return stream_q_update(stream, path, progress, **options)


@pytest.mark.parametrize("chunk_rows", [7, 65_536])
def test_stream_of_states_longer_than_a_chunk(spark, chunk_rows):
    """The same bits whether a state fits in an array or is folded in chunks, in batches that leave gaps."""
    rng = np.random.default_rng(8)
    rows = [(s, i + 1, int(rng.integers(0, 9)), float(rng.random())) for s, n in ((1, 60), (2, 5), (3, 30)) for i in range(n)]
    mixed = [rows[i] for i in rng.permutation(len(rows))]
    parts = [mixed[i::3] for i in range(3)]
    q = _fed(spark, parts, new_path(spark, "versions"), new_path(spark, "cp"), chunk_rows=chunk_rows)
    got = {(r["state"], r["action"]): r["q"] for r in q.collect()}
    want = {(r["state"], r["action"]): r["q"] for r in Q.q_update(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_of_different_deliveries_the_least_counts(spark):
    for rows in ([(1, 1, 3, 5.0), (1, 1, 3, 2.0), (1, 1, 4, 1.0)], [(1, 1, 4, 1.0), (1, 1, 3, 2.0), (1, 1, 3, 5.0)]):
        for chunk_rows in (1, 100):
            q = _fed(spark, [rows], new_path(spark, "versions"), new_path(spark, "cp"), chunk_rows=chunk_rows)
            assert {(r["action"], round(r["q"], 9)) for r in q.where("q <> 0").collect()} == {(3, 0.2)}


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_bytes_of_a_batch_follow_the_touched_states(spark):
    """One batch fills the table; of 49 more each touches one state, and writes one bucket."""
    path, progress = new_path(spark, "versions"), new_path(spark, "cp")
    parts = [[(s, 1, s % 9, 1.0) for s in range(4000)]] + [[(i * 31, 2, 1, 0.5)] for i in range(49)]
    _fed(spark, parts, path, progress, buckets=64)
    number, commit = newest_commit(spark, path)
    assert number == 49
    # The first version lost the buckets that were written again.
    kept = [b for b, v in commit["versions"].items() if v == 0]
    assert len(kept) >= 64 - 49
    whole = _bytes(f"{path}/version=0") * 64 / len(os.listdir(f"{path}/version=0"))
    for n in (48, 49):
        assert 0 < _bytes(f"{path}/version={n}") < whole / 16
    assert current_table(spark, path, "applied").where("last = 2").count() == 49
    assert current_table(spark, path).count() == 9 * 4000


def test_a_failed_save_leaves_the_old_tables(spark):
    path = new_path(spark, "agent")
    for n in (1, 2, 3):
        T.save_tables({"q": spark.range(n), "visits": spark.range(n + 10)}, path)
    bad = spark.range(5).select(F.raise_error(F.lit("stopped")).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        T.save_tables({"q": spark.range(99), "visits": bad}, path)
    assert [T.load_table(spark, path, t).count() for t in ("q", "visits")] == [3, 13]
    T.save_tables({"q": spark.range(4), "visits": spark.range(14)}, path)
    assert [T.load_table(spark, path, t).count() for t in ("q", "visits")] == [4, 14]
    with pytest.raises(FileNotFoundError):
        T.load_table(spark, new_path(spark, "nothing"), "q")
