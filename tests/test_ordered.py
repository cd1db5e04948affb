import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markerloom.functions.ordered import coarse, dense_index, exact_quantiles, running_totals, split_frequent

PROBS = [0.0, 0.2, 0.5, 0.777, 1.0]


def quantiles(spark, groups, **kw):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    return {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", PROBS, **kw).collect()}


def test_hot_key_by_counting_equals_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {
        "hot": rng.normal(size=4001),
        "tight": 1e6 + rng.random(500) * 1e-3,
        "ties": rng.integers(0, 3, 400),
        "wide": np.concatenate([-np.logspace(-300, 250, 111), np.logspace(-300, 300, 112), [0.0]]),
        "one": [7.0],
    }
    got = quantiles(spark, groups, direct_limit=10)
    for k, v in groups.items():
        np.testing.assert_allclose(got[k], np.quantile(np.asarray(v, float), PROBS), rtol=1e-12, err_msg=k)


def test_direct_and_counted_agree(spark):
    rng = np.random.default_rng(2)
    groups = {k: rng.exponential(size=n) - 0.5 for k, n in (("a", 10), ("b", 333), ("c", 1))}
    direct, counted = quantiles(spark, groups), quantiles(spark, groups, direct_limit=0)
    for k in groups:
        np.testing.assert_allclose(direct[k], counted[k], rtol=1e-13)


def test_null_keys_and_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", 5.0)], "k string, v double")
    for limit in (100, 0):
        got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", [0.5], direct_limit=limit).collect()}
        assert got == {None: [2.0], "a": [5.0]}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=2, max_size=200))
def test_rounding_keeps_the_order(spark, values):
    df = spark.createDataFrame([(v,) for v in sorted(values)], "v double").coalesce(1)
    for bits in (8, 16, 24):
        got = [r[0] for r in df.select(coarse(F.col("v"), bits)).collect()]
        assert got == sorted(got)


def test_running_totals(spark):
    rng = np.random.default_rng(3)
    order = np.unique(rng.normal(size=700))
    amount = rng.integers(0, 9, len(order))
    df = spark.createDataFrame(list(zip(order.tolist(), amount.tolist())), "s double, a bigint")
    got = {r["s"]: r["a_before"] for r in running_totals(df.repartition(7), "s", ["a"]).collect()}
    before = np.cumsum(amount) - amount
    assert got == dict(zip(order.tolist(), before.tolist()))


@pytest.mark.parametrize("parts", [1, 7])
def test_dense_index_is_a_numbering(spark, parts):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "key").repartition(parts)
    rows = dense_index(df, "key").collect()
    assert sorted(r["idx"] for r in rows) == list(range(1000))
    first = {r["key"]: r["idx"] for r in rows}
    again = {r["key"]: r["idx"] for r in dense_index(df.repartition(3), "key").collect()}
    assert first == again


def test_only_frequent_keys_are_counted(spark):
    """One key of a third of the rows: it is counted, all others, a null key too, go through percentile."""
    rng = np.random.default_rng(11)
    groups = {"hot": rng.normal(size=500), None: rng.normal(size=60)} | {f"k{i}": rng.normal(size=50) for i in range(19)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    few, many, top = split_frequent(df, ["k"], 100)
    assert top == 500 and many.count() == 500 and few.count() == len(rows) - 500
    assert {r[0] for r in many.select("k").distinct().collect()} == {"hot"}
    found = exact_quantiles(df, ["k"], "v", PROBS, direct_limit=100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "percentile(v" in plan and "map_from_entries" in plan
    got = {r["k"]: r["q"] for r in found.collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        np.testing.assert_allclose(got[k], np.quantile(v, PROBS), rtol=1e-12)
    assert split_frequent(df, ["k"], 1000)[1] is None and split_frequent(df, ["k"], 10)[0] is None


def test_medians_of_frequent_and_rare_samples(spark):
    from markerloom.operators.summaries import summarize

    rng = np.random.default_rng(12)
    rows = [(s, f"{s}_pos", float(a), None if i % 7 == 0 else float(b)) for s, n in ((1, 300), (2, 20), (3, 5)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame(rows, "s bigint, name string, a double, b double").repartition(4)
    for method in ("median", "mean"):
        whole = {r["s"]: r for r in summarize(df, ["s"], ["a", "b"], method, "name").collect()}
        split = {r["s"]: r for r in summarize(df, ["s"], ["a", "b"], method, "name", direct_limit=100).collect()}
        assert whole.keys() == split.keys() == {1, 2, 3}
        for s, r in whole.items():
            assert split[s]["label"] == r["label"] == "positive"
            assert split[s]["a"] == pytest.approx(r["a"]) and split[s]["b"] == pytest.approx(r["b"])
