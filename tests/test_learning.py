import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.operators import qtable as Q
from markerloom.operators import reports as R

P = Q.Learning()


def q_of(spark, cells):
    return spark.createDataFrame([(s, a, float(v)) for (s, a), v in cells.items()], "state bigint, action bigint, q double")


def loop(rows, q=None, n=9, alpha=0.1, gamma=0.9):
    """Reference loop over (state, order, action, reward)."""
    q, errors = {s: np.array(v, float) for s, v in (q or {}).items()}, {}
    for s, o, a, r in sorted(rows):
        row = q.setdefault(s, np.zeros(n))
        a = min(max(a, 0), n - 1)
        errors[s, o] = r + gamma * row.max() - row[a]
        row[a] += alpha * errors[s, o]
    return q, errors


def transitions(spark, rows):
    return spark.createDataFrame(rows, "state bigint, seq bigint, action bigint, reward double").repartition(6)


def as_rows(df, n=9):
    out = {}
    for r in df.collect():
        out.setdefault(r["state"], np.zeros(n))[r["action"]] = r["q"]
    return out


def log(n=3000, states=4, seed=0, hot=0.6, low=-1.0):
    rng = np.random.default_rng(seed)
    state = np.where(rng.random(n) < hot, 0, rng.integers(0, states, n))
    return [(int(s), i * 3 + 5, int(rng.integers(-1, 11)), float(rng.uniform(low, 1))) for i, s in enumerate(state)]


def test_single_updates(spark):
    got = as_rows(Q.q_update(transitions(spark, [(0, 1, 2, 1.0)])))
    assert got[0][2] == pytest.approx(0.1)


@pytest.mark.parametrize("chunk_rows, low", [(100_000, -1.0), (400, -1.0), (150, -5.0)])
def test_update_equals_loop(spark, chunk_rows, low):
    rows = log(low=low)
    start = {0: np.linspace(-2, 3, 9), 7: np.ones(9)}
    q0 = q_of(spark, {(s, a): v for s, row in start.items() for a, v in enumerate(row)})
    got = as_rows(Q.q_update(transitions(spark, rows), q0=q0, chunk_rows=chunk_rows))
    want, _ = loop(rows, {0: start[0]})
    assert got.keys() == want.keys()
    for s in want:
        np.testing.assert_allclose(got[s], want[s], atol=1e-9)


def test_actions_without_updates_keep_their_value(spark):
    rows = [(0, i, 3 if i < 20 else 5, 0.1) for i in range(200)]
    q0 = {(0, 8): 50.0, (0, 1): -4.0}
    got = as_rows(Q.q_update(transitions(spark, rows), q0=q_of(spark, q0), chunk_rows=16))
    start = np.zeros(9)
    start[8], start[1] = 50.0, -4.0
    np.testing.assert_allclose(got[0], loop(rows, {0: start})[0][0], atol=1e-9)


@pytest.mark.parametrize("chunk_rows", [100_000, 250])
def test_td_errors(spark, chunk_rows):
    rows = log(1200)
    got = {(r["state"], r["seq"]): r["td_error"] for r in Q.td_error(transitions(spark, rows), chunk_rows=chunk_rows).collect()}
    want = loop(rows)[1]
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_sweep(spark):
    q = q_of(spark, {(0, 1): 0.5, (2, 2): 0.7, (3, 0): -1.0})
    moves = spark.createDataFrame([(0, 1, 2, 2.0), (1, 0, 3, 1.0)], "state bigint, action bigint, next_state bigint, reward double")
    got = {(r["state"], r["action"]): r["q"] for r in Q.q_sweep(moves, q).collect()}
    # The absent entries of state 3 are 0, above its only stored value.
    assert got == {(0, 1): pytest.approx(0.713), (1, 0): pytest.approx(0.1), (2, 2): 0.7, (3, 0): -1.0}
    assert sorted(r["q"] for r in Q.q_sweep(moves).collect()) == pytest.approx([0.1, 0.2])


def test_policy_and_values(spark):
    q = q_of(spark, {(0, 3): 0.5, (0, 6): 0.5, (1, 0): -2.0, (1, 1): -1.0, (2, 8): 0.8})
    policy = {r["state"]: r["action"] for r in Q.policy(q, 9, 5).collect()}
    assert policy == {0: 3, 1: 2, 2: 8, 3: 0, 4: 0}
    values = {r["state"]: r["value"] for r in Q.state_values(q, 9).collect()}
    assert values == {0: 0.5, 1: 0.0, 2: 0.8}


def test_lookup_clips_and_defaults(spark):
    greedy = spark.createDataFrame([(0, 4), (9, 8)], "state bigint, action bigint")
    asked = spark.createDataFrame([(-1,), (0,), (5,), (1000,)], "state bigint")
    got = sorted((r["state"], r["action"], r["k"]) for r in Q.policy_lookup(asked, greedy, 2, 10).collect())
    assert got == [(0, 4, 6), (0, 4, 6), (5, 0, 2), (9, 8, 10)]


def test_table_statistics(spark):
    dense = np.zeros((16, 9))
    dense[0, :2], dense[1, 0], dense[4, 4] = [1.0, 2.0], 0.5, -3.0
    cells = {(s, a): dense[s, a] for s in range(16) for a in range(9) if dense[s, a]} | {(5, 5): 0.0}
    got = Q.q_table_stats(q_of(spark, cells), 16, 9).first()
    nz = dense[dense != 0]
    assert got["entries"] == 144 and got["non_zero_entries"] == 4
    for name, want in {
        "mean_q": dense.mean(), "std_q": dense.std(), "min_q": -3.0, "max_q": 2.0,
        "non_zero_percentage": 400 / 144, "state_coverage": 300 / 16,
        "mean_non_zero_q": nz.mean(), "std_non_zero_q": nz.std(),
    }.items():
        assert got[name] == pytest.approx(want, abs=1e-12), name
    empty = Q.q_table_stats(q_of(spark, {(0, 0): 0.0}).limit(0), 16, 9).first()
    assert (empty["mean_q"], empty["max_q"], empty["non_zero_entries"], empty["mean_non_zero_q"]) == (0.0, 0.0, 0, None)


def test_epsilon(spark):
    t = spark.createDataFrame([(0,), (357,), (358,), (999,)], "iteration bigint")
    got = {r["iteration"]: (r["eps_used"], r["eps_logged"]) for r in Q.epsilon_schedule(t, P).collect()}
    assert got[0] == (pytest.approx(0.3), pytest.approx(0.2985))
    assert got[357][0] > 0.05 and got[358][0] == 0.05 and got[999] == (0.05, 0.05)
    later = {r["iteration"]: r["eps_used"] for r in Q.epsilon_schedule(t, P, done=10).collect()}
    assert later[0] == pytest.approx(0.3 * 0.995**10)
    reset = {r["iteration"]: r["eps_used"] for r in Q.epsilon_schedule(t, P, done=10, reset=True).collect()}
    assert reset[0] == 0.3


def test_action_space(spark):
    actions = Q.action_space(spark.createDataFrame([(2, 10)], "min_k int, max_k int"))
    assert {r["action"]: r["k"] for r in actions.collect()} == {a: a + 2 for a in range(9)}
    ks = spark.createDataFrame([(5,)], "k bigint")
    assert Q.require_actions(ks, actions).first()["action"] == 3
    with pytest.raises(ValueError):
        Q.require_actions(ks.unionByName(spark.createDataFrame([(15,)], "k bigint")), actions)


def samples(spark, n, states=5, parts=4):
    return spark.range(n).select(F.col("id").alias("sid"), (F.col("id") % states).alias("state")).repartition(parts)


def test_minibatches(spark):
    p = Q.Learning(iterations=400, batch=10)
    rows = Q.minibatch(samples(spark, 37), "sid", p).collect()
    by = {}
    for r in rows:
        by.setdefault(r["iteration"], []).append((r["rank"], r["sid"]))
    assert len(by) == 400
    counts = np.zeros(37)
    for drawn in by.values():
        assert sorted(k for k, _ in drawn) == list(range(1, 11))
        assert len({s for _, s in drawn}) == 10
        counts[[s for _, s in drawn]] += 1
    # Every sample is equally likely: 400 * 10 / 37, standard deviation about 9.
    assert abs(counts - 400 * 10 / 37).max() < 45
    again = Q.minibatch(samples(spark, 37, parts=1), "sid", p).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_few_samples_are_all_taken_in_order(spark):
    rows = Q.minibatch(samples(spark, 7), "sid", Q.Learning(iterations=3, batch=10)).collect()
    orders = {i: [r["idx"] for r in sorted(rows, key=lambda r: r["rank"]) if r["iteration"] == i] for i in range(3)}
    assert orders == {i: list(range(7)) for i in range(3)}
    assert Q.minibatch(samples(spark, 0), "sid", Q.Learning(iterations=3)).count() == 0


def replay(visits, rewards, q=None):
    """Plays the visits in order and checks the greedy choices on the way."""
    q = {s: v.copy() for s, v in (q or {}).items()}
    for v in sorted(visits, key=lambda v: (v["iteration"], v["rank"])):
        row = q.setdefault(v["state"], np.zeros(9))
        if not v["explored"]:
            assert v["action"] == row.argmax()
        assert v["reward"] == rewards[v["action"] + 2]
        row[v["action"]] += 0.1 * (v["reward"] + 0.9 * row.max() - row[v["action"]])
    return q


REWARDS = dict(zip(range(2, 11), [0.3, 0.41, 0.5, 0.45, 0.2, 0.1, 0.35, 0.25, -1.0]))


@pytest.mark.parametrize("fold", [20_000, 170])
def test_learning_equals_a_loop(spark, monkeypatch, fold):
    monkeypatch.setattr(Q, "FOLD_VISITS", fold)
    p = Q.Learning(iterations=60, batch=10)
    q0 = {0: np.linspace(0, 1, 9), 44: np.full(9, 2.0)}
    start = q_of(spark, {(s, a): v for s, row in q0.items() for a, v in enumerate(row)})
    q, visits = Q.learn(samples(spark, 50), "sid", REWARDS, p, phase=2, done=5, q0=start)
    rows = visits.collect()
    assert len(rows) == 600 and {r["phase"] for r in rows} == {2}
    want = replay(rows, REWARDS, q0)
    got = as_rows(q)
    assert got.keys() == want.keys()
    for s in want:
        np.testing.assert_allclose(got[s], want[s], atol=1e-12)
    explored = np.mean([r["explored"] for r in rows])
    assert 0.15 < explored < 0.4


def test_best_action_approaches_its_fixed_point(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, int(a), REWARDS[int(a) + 2]) for i, a in enumerate(rng.integers(0, 9, 60_000))]
    got = as_rows(Q.q_update(transitions(spark, rows)))[0]
    best = max(REWARDS.values())
    assert got.argmax() == 2 and got[2] == pytest.approx(10 * best, rel=1e-6)
    want = [r + 0.9 * 10 * best for r in REWARDS.values()]
    np.testing.assert_allclose(got, [w if i != 2 else 10 * best for i, w in enumerate(want)], rtol=1e-6)


def visits_of(spark, rewards_per_iteration):
    rows = [
        (1, i, k + 1, 0, a, a % 2 == 0, float(r))
        for i, batch in enumerate(rewards_per_iteration)
        for k, (a, r) in enumerate(batch)
    ]
    return spark.createDataFrame(rows, "phase bigint, iteration bigint, rank bigint, state bigint, action bigint, explored boolean, reward double")


def test_logs_and_statistics(spark):
    visits = visits_of(spark, [[(1, 0.5), (2, 0.5)], [(1, 1.0), (3, 1.0)], [(2, 0.75), (2, 0.75)]])
    logged = {r["iteration"]: r for r in Q.training_log(visits, P).collect()}
    assert (logged[2]["cumulative_payoff"], logged[2]["average_payoff"], logged[2]["action_diversity"]) == (1.5, 0.75, 1)
    assert logged[0]["exploration_rate"] == pytest.approx(0.2985)
    stats = Q.agent_statistics(visits, P).first()
    assert (stats["n_episodes"], stats["mean_reward"], stats["min_reward"], stats["max_reward"]) == (3, 1.5, 1.0, 2.0)
    assert stats["std_reward"] == pytest.approx(np.std([1.0, 2.0, 1.5])) and stats["last_10_mean_reward"] == 1.5
    assert (stats["total_exploration"], stats["total_exploitation"], stats["exploration_rate"]) == (3, 3, 0.5)
    nothing = Q.agent_statistics(visits.limit(0), P).first()
    assert (nothing["n_episodes"], nothing["mean_reward"], nothing["exploration_rate"], nothing["min_reward"]) == (0, 0.0, 0.0, None)
    actions = Q.action_space(spark.createDataFrame([(2, 10)], "min_k int, max_k int"))
    counts = [(r["label"], r["n"]) for r in Q.action_distribution(visits, actions).collect()]
    assert counts == [("k=2", 0), ("k=3", 2), ("k=4", 3), ("k=5", 1)] + [(f"k={k}", 0) for k in range(6, 11)]


@pytest.mark.parametrize("n", [5, 19, 20, 137, 700])
def test_moving_average(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "phase int, iteration int, v double")
    got = [r["moving_average"] for r in R.moving_average(df, "v").orderBy("iteration").collect()]
    w = min(50, n // 10)
    for i, g in enumerate(got):
        if w <= 1 or i < w - 1:
            assert g is None
        else:
            assert g == pytest.approx(x[i - w + 1 : i + 1].mean())


def test_histogram(spark):
    x = np.random.default_rng(1).normal(size=400)
    rows = [("a", float(v)) for v in x] + [("flat", 2.0)] * 3 + [("a", math.nan), ("a", None), ("a", math.inf)]
    got = R.feature_histogram(spark.createDataFrame(rows, "marker string, value double")).collect()
    counts, edges = np.histogram(x, bins=50)
    mine = sorted((r["bar"], r["n"], r["lo"]) for r in got if r["marker"] == "a")
    assert [m[1] for m in mine] == counts.tolist()
    np.testing.assert_allclose([m[2] for m in mine], edges[:-1])
    flat = {r["bar"]: r for r in got if r["marker"] == "flat"}
    assert (flat[0]["lo"], flat[49]["hi"], flat[25]["n"]) == (1.5, 2.5, 3)


def test_heatmap_and_report(spark):
    q = q_of(spark, {(3, 0): 1.5, (3, 8): -1.0})
    row = R.q_heatmap(q, 2, 10).first()
    assert (row["k2"], row["k5"], row["k10"]) == (1.5, 0.0, -1.0)
    visits = visits_of(spark, [[(1, 0.5)], [(1, 1.0)]])
    both = visits.unionByName(visits.withColumn("phase", F.lit(2).cast("bigint")).withColumn("reward", F.col("reward") * 2))
    report = R.summary_report(Q.training_log(both, P), Q.q_table_stats(q, 16, 9)).first()
    assert (report["phase1_iterations"], report["phase1_average_payoff"], report["phase2_average_payoff"]) == (2, 1.0, 2.0)
    assert report["max_q"] == 1.5 and report["state_coverage"] == pytest.approx(100 / 16)
