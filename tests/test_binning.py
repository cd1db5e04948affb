import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.operators import binning as B

EDGES = [0.0, 0.5, 1.0, 2.0, 3.0, math.inf]
BINS = {"IFNa": EDGES, "TNFa": EDGES}


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "values, want",
    [
        ([0.1, 0.6, 1.2, 3.0, 4.0], [0, 1, 2, 4, 4]),
        ([0.5, 1.0, 2.0, 3.0], [1, 2, 3, 4]),
        ([-7.0, math.inf, -math.inf, math.nan, None], [0, 4, 0, 4, 4]),
    ],
)
def test_digitize(spark, values, want):
    assert column(spark, values, lambda x: B.digitize(x, EDGES)) == want
    assert column(spark, values, lambda x: B.digitize_by(x, F.array(*[F.lit(e) for e in EDGES]))) == want


def test_digitize_equals_numpy(spark):
    rng = np.random.default_rng(0)
    values = (rng.normal(size=300) * 3).tolist()
    cuts = [-5.0, -1.0, 0.25, 0.25, 4.0, 6.0]
    want = np.clip(np.digitize(values, cuts[1:-1]), 0, 4).tolist()
    assert column(spark, values, lambda x: B.digitize(x, cuts)) == want


def test_two_edges_or_fewer_give_bin_zero(spark):
    for cuts in ([0.0, 1.0], [0.0], []):
        assert column(spark, [-1.0, 0.5, 9.0], lambda x: B.digitize(x, cuts)) == [0, 0, 0]


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "bins, bases, want",
    [
        ([1, 2], [5, 5], 7),
        ([1, 2, 1], [5, 5, 5], 36),
        ([3, 3, 3], [5, 5, 5], 93),
        ([1, 2], None, 6),
        ([3, 3], None, 15),
        ([1, 2, 1], None, 25),
        ([3, 3, 3], None, 63),
        ([4, 7], [0, -3], 11),
    ],
)
def test_encode(spark, bins, bases, want):
    assert one(spark, B.encode_state([F.lit(b) for b in bins], bases)) == want


def test_encode_refuses_bad_input():
    with pytest.raises(ValueError):
        B.encode_state([])
    with pytest.raises(ValueError):
        B.encode_state([1, 2], [5])


def test_decode_undoes_encode(spark):
    bases = [5, 4, 3]
    df = spark.range(60).select("id", *[b.alias(f"b{i}") for i, b in enumerate(B.decode_state(F.col("id"), bases))])
    back = df.select("id", B.encode_state([F.col(f"b{i}") for i in range(3)], bases).alias("s"))
    assert back.where("id <> s").count() == 0
    assert [one(spark, b) for b in B.decode_state(F.lit(36), [5, 5, 5])] == [1, 2, 1]


def test_state_from_table(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3), (9, -4)], "IFNa_bin int, TNFa_bin int")
    got = [r["state"] for r in B.state_from_bins(df, BINS, ["IFNa", "TNFa"]).collect()]
    assert got == [0, 6, 12, 18, 20]


def test_absent_marker_is_bin_zero_and_missing_value_top_bin(spark):
    df = spark.createDataFrame([(0.7, None), (0.7, 0.1)], "IFNa double, TNFa double")
    feats = ["IFNa", "CD99", "TNFa"]
    done = B.state_from_bins(B.discretize(df, BINS, feats), BINS, feats)
    assert "CD99_bin" not in done.columns
    assert [r["state"] for r in done.collect()] == [25 + 4, 25 + 0]


def test_discretize_needs_features(spark):
    with pytest.raises(ValueError):
        B.discretize(spark.range(1), BINS, [])


def test_bin_statistics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 3], [0, 1, 1, 2, 2, 3])), "IFNa_bin int, TNFa_bin int")
    got = {(r["feature"], r["bin"]): (r["n"], r["share"]) for r in B.bin_statistics(df, ["IFNa", "TNFa", "X"]).collect()}
    assert got["IFNa", 0] == (2, pytest.approx(1 / 3))
    assert got["TNFa", 3] == (1, pytest.approx(1 / 6))
    assert len(got) == 8


def test_state_count():
    assert B.state_count({"a": [0, 1, 2], "b": EDGES}, ["a", "b", "other"]) == 2 * 5 * 5
    for feats in (["a"], ["a", "b", "c", "d"]):
        with pytest.raises(ValueError):
            B.state_count(BINS, feats)


def test_describe_bins(spark):
    df = spark.createDataFrame([(0, 4), (1, 9)], "IFNa_bin int, TNFa_bin int")
    got = [r["text"] for r in B.describe_bins(df, BINS, ["IFNa", "TNFa"]).collect()]
    assert got == ["IFNa: [0.0, 0.5) | TNFa: [3.0, inf)", "IFNa: [0.5, 1.0)"]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_tied_quintiles_are_moved_apart(spark, limit):
    values = [0.4] + [1.4] * 20 + [1.9]
    df = spark.createDataFrame([("IL6", v) for v in values], "marker string, value double")
    edges = B.bins_to_dict(B.quantile_bins(df, direct_limit=limit))["IL6"]
    want = [0.4, 1.4, 1.4 + 1e-6, 1.4 + 2e-6, 1.4 + 3e-6, 1.9]
    assert edges == pytest.approx(want, abs=1e-12)
