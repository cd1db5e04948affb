import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.functions.scalars import asinh, basename, label_from_name, zfill
from markerloom.operators import cleaning as CL
from markerloom.operators import markers as MK
from markerloom.operators import summaries as S

NAN, INF = math.nan, math.inf


def values(spark, xs, make, kind="double"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_asinh_equals_numpy(spark):
    xs = [0.0, 1e-9, -1e-9, 1.0, -3.5, 1e9, -1e9, 1e200, -1e300, INF, -INF, NAN]
    np.testing.assert_allclose(values(spark, xs, asinh), np.arcsinh(xs), rtol=1e-14)


def test_zfill_never_truncates(spark):
    got = values(spark, ["7", "12345", "0012", "-5", "+12345", "", None], lambda x: zfill(x, 4), "string")
    assert got == ["7".zfill(4), "12345", "0012", "-5".zfill(4), "+12345", "0000", None]


def test_labels_from_names(spark):
    names = ["p1_Positive.fcs", "neg_POS.fcs", "x_NEGATIVE.fcs", "plain.fcs"]
    assert values(spark, names, label_from_name, "string") == ["positive", "positive", "negative", None]
    assert values(spark, ["file:/a/b/c.fcs", "c.fcs"], basename, "string") == ["c.fcs", "c.fcs"]


def cells(spark):
    rows = [
        ("a", 1.0, NAN, None),
        ("a", 2.0, INF, None),
        ("a", 4.0, None, None),
        ("a", NAN, -INF, None),
        ("b", -INF, 3.0, 1.0),
        ("b", 8.0, 5.0, NAN),
        ("c", None, 1.0, 2.0),
    ]
    return spark.createDataFrame(rows, "s string, x double, y double, z double")


@pytest.mark.parametrize("limit", [100_000, 0])
def test_clean_values(spark, limit):
    out = CL.clean_values(cells(spark), ["s"], ["x", "y", "z"], direct_limit=limit)
    got = sorted(((r["s"], r["x"], r["y"], r["z"]) for r in out.collect()), key=str)
    # z is absent from a, x from c; y of a has values, none of them finite.
    want = [
        ("a", 1.0, 0.0, None),
        ("a", 2.0, 0.0, None),
        ("a", 2.0, 0.0, None),
        ("a", 4.0, 0.0, None),
        ("b", 8.0, 3.0, 1.0),
        ("b", 8.0, 5.0, 1.0),
        ("c", None, 1.0, 2.0),
    ]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("limit", [100_000, 0])
@pytest.mark.parametrize("method", ["median", "mean"])
def test_summary_equals_summary_of_cleaned_cells(spark, method, limit):
    rng = np.random.default_rng(4)
    rows = []
    for s in "abcdefg":
        for _ in range(int(rng.integers(1, 30))):
            rows.append((s, *[NAN if rng.random() < 0.3 else float(rng.normal()) for _ in range(2)]))
    df = spark.createDataFrame(rows, "s string, x double, y double")
    got = S.summarize(df, ["s"], ["x", "y"], method, direct_limit=limit)
    clean = CL.clean_values(df, ["s"], ["x", "y"])
    f = F.median if method == "median" else F.avg
    want = clean.groupBy("s").agg(f("x").alias("x"), f("y").alias("y"))
    a, b = ({r["s"]: (r["x"], r["y"]) for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys()
    for s in a:
        assert a[s] == pytest.approx(b[s], abs=1e-12)


def test_summarize_methods(spark):
    df = cells(spark)
    named = S.summarize(df.withColumn("f", F.concat("s", F.lit("_pos.fcs"))), ["s"], ["x"], name="f")
    assert {r["label"] for r in named.collect()} == {"positive"}
    assert S.summarize(df, ["s"], ["x"], "all").columns == ["s", "x"]
    with pytest.raises(ValueError):
        S.summarize(df, ["s"], ["x"], "mode")


def test_no_samples_give_an_empty_summary(spark):
    assert S.summarize(cells(spark).limit(0), ["s"], ["x", "y"]).count() == 0


def test_feature_matrix(spark):
    rows = [(1, 1.0, None, NAN, "pos"), (2, INF, 4.0, NAN, None), (3, 5.0, 8.0, NAN, None)]
    df = spark.createDataFrame(rows, "id bigint, `IFNa-PE` double, il6 double, empty double, label string")
    points, names = CL.feature_matrix(df.withColumnRenamed("IFNa-PE", "IFNa_PE"), "id")
    assert names == ["IFNa_PE", "il6"]
    got = {r["id"]: r["features"] for r in points.collect()}
    assert got == {1: [1.0, 6.0], 2: [3.0, 4.0], 3: [5.0, 8.0]}
    picked, names = CL.feature_matrix(df.withColumnRenamed("IFNa-PE", "IFNa_PE"), "id", ["ifna", "none"])
    assert names == ["IFNa_PE"]
    with pytest.raises(ValueError):
        CL.feature_matrix(df.select("id", "label"), "id")
    with pytest.raises(ValueError):
        CL.feature_matrix(df.select("id", "empty"), "id")


def test_numeric_coerce(spark):
    df = spark.createDataFrame([("1",), ("x",), ("inf",), (None,), ("4",)], "v string")
    assert sorted(r["v"] for r in CL.numeric_coerce(df, ["v"]).collect()) == [1.0, 2.5, 2.5, 2.5, 4.0]


def test_label_to_binary(spark):
    def y(labels):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string")
        return [r["y"] for r in CL.label_to_binary(df).orderBy("i").collect()]

    assert y(["HEU", "UE", "heu", None]) == [1, 0, 1, 0]
    assert y(["1", "0", "-1", "x", "2.5"]) == [1, 0, 0, 0, 1]


def test_labels_rows_and_joins(spark):
    raw = spark.createDataFrame([("7", "HEU"), ("12345", "UE"), (None, "UE"), ("0012", None)], "id string, label string")
    labels = CL.normalize_label_rows(raw)
    assert {(r["filename"], r["label"]) for r in labels.collect()} == {("0007.FCS", "HEU"), ("12345.FCS", "UE")}
    files = spark.createDataFrame([("0007.FCS", 1.0)], "filename string, x double")
    assert [r["filename"] for r in CL.missing_files(labels, files).collect()] == ["12345.FCS"]
    assert [r["label"] for r in CL.join_labels(files, labels).collect()] == ["HEU"]
    with pytest.raises(ValueError):
        CL.labeled_only(raw.where("label IS NULL"))


def test_marker_rules(spark):
    names = ["FSC-A", "IL12-PE", "il1", "IFNa", "CD14 APC"]
    asked = ["IFNa", "IL1", "CD14", "CD99"]
    channels = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "file string, pos int, channel string")
    got = {r["marker"]: r["channel"] for r in MK.resolve_markers(channels, asked).collect()}
    assert got == {"IFNa": "IFNa", "IL1": "il1", "CD14": "CD14 APC"}
    found = {r["marker"]: r["channel"] for r in MK.locate_marker(channels, asked).collect()}
    assert found == {"IFNa": "IFNa", "IL1": "IL12-PE", "CD14": "CD14 APC", "CD99": "CD99"}
    for m in asked:
        assert MK.resolved_name(names, m) == got.get(m)
        assert MK.located_name(names, m) == found[m]
    # Two markers may share a column.
    table = spark.createDataFrame([(1.0,)], "`IL12-PE` double")
    assert MK.select_markers(table, ["IL1", "IL12"]).columns == ["IL1", "IL12"]
    with pytest.raises(ValueError):
        MK.select_markers(table, ["CD99"])


def test_a_null_key_is_a_sample(spark):
    rows = [(1, 1.0), (None, 3.0), (None, None), (None, 5.0), (1, float("nan"))]
    df = spark.createDataFrame(rows, "s bigint, a double")
    cleaned = CL.clean_values(df, ["s"], ["a"]).collect()
    assert sorted(r["a"] for r in cleaned if r["s"] is None) == [3.0, 4.0, 5.0] and len(cleaned) == 5
    means = {r["s"]: r["a"] for r in S.summarize(df, ["s"], ["a"], "mean").collect()}
    assert means == {1: 1.0, None: 4.0}
