import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.sources import measurements as FCS
from markerloom.sources.fcs_bytes import encode_fcs

RNG = np.random.default_rng(5)
VALUES = RNG.normal(size=(1000, 3)) * 200


def put(folder, name, content):
    path = folder / name
    os.makedirs(path.parent, exist_ok=True)
    path.write_bytes(content)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("fcs")
    names = ["IFNa-PE", "CD14 APC", "a/b"]
    ints = np.abs(VALUES).astype(int)
    put(root, "float_pos.fcs", encode_fcs(names, VALUES))
    put(root, "deep/er/double_neg.FCS", encode_fcs(names, VALUES, "D", little=False))
    put(root, "int16.Fcs", encode_fcs(names, ints, "I", little=False, bits=16))
    put(root, "deep/int32.fcs", encode_fcs(["x", "ifna"], ints[:, :2], "I"))
    put(root, "empty.fcs", encode_fcs(names, VALUES[:0]))
    put(root, "cut.fcs", encode_fcs(names, VALUES)[:-1])
    put(root, "other.fcs", encode_fcs(["FSC", "SSC"], VALUES[:, :2]))
    put(root, "junk.fcs", b"no such format")
    put(root, "zero.fcs", b"")
    put(root, "notes.txt", b"ignored")
    return root


def test_manifest(spark, folder):
    files = FCS.scan_files(spark, str(folder))
    rows = {r["filename"]: r for r in FCS.scan_manifest(files, ["ifna", "cd14"]).collect()}
    bad = {"cut.fcs", "other.fcs", "junk.fcs", "zero.fcs"}
    assert {n for n, r in rows.items() if r["error"]} == bad
    assert "notes.txt" not in rows and "no bytes" in rows["zero.fcs"]["error"]
    assert rows["float_pos.fcs"]["n_events"] == 1000 and rows["empty.fcs"]["n_events"] == 0
    counts = FCS.manifest_counts(FCS.scan_manifest(files, ["ifna", "cd14"])).first()
    assert (counts["loaded"], counts["failed"]) == (5, 4)


@pytest.mark.parametrize("slice_bytes", [1, 100, 1 << 20])
def test_decode(spark, folder, slice_bytes):
    if slice_bytes == 1:
        files = FCS.scan_files(spark, str(folder)).where(F.col("path").endswith("float_pos.fcs"))
    else:
        files = FCS.scan_files(spark, str(folder))
    rows = FCS.decode_measurements(files, ["IFNa", "CD14"], slice_bytes).collect()
    by = {}
    for r in rows:
        by.setdefault(r["filename"], []).append((r["event"], r["IFNa"], r["CD14"]))
    want = {"float_pos.fcs": VALUES.astype("f4")}
    if slice_bytes > 1:
        ints = np.abs(VALUES).astype(int)
        want |= {"double_neg.FCS": VALUES, "int16.Fcs": ints}
        assert [x[2] for x in by["int32.fcs"]] == [None] * 1000
        assert [x[1] for x in sorted(by["int32.fcs"])] == ints[:, 1].tolist()
        assert set(by) == set(want) | {"int32.fcs"}
    for name, matrix in want.items():
        got = sorted(by[name])
        assert [g[0] for g in got] == list(range(1000))
        np.testing.assert_array_equal([g[1:] for g in got], matrix[:, :2].astype(float))


def test_decode_long_and_channels(spark, folder):
    files = FCS.scan_files(spark, str(folder))
    long = FCS.decode_long(files, 5000).groupBy("filename", "channel").count().collect()
    assert {(r["filename"], r["channel"]) for r in long if r["filename"] == "float_pos.fcs"} == {
        ("float_pos.fcs", c) for c in ("IFNa-PE", "CD14 APC", "a/b")
    }
    names = {r["channel"]: r["pos"] for r in FCS.channels(files).where(F.col("file").endswith("int32.fcs")).collect()}
    assert names == {"x": 0, "ifna": 1}


@pytest.mark.parametrize("method, reduce", [("median", np.median), ("mean", np.mean)])
def test_load_batch(spark, folder, method, reduce):
    files = FCS.scan_files(spark, str(folder))
    got = {r["filename"]: r for r in FCS.load_batch(files, ["ifna", "cd14"], method, slice_bytes=3000).collect()}
    assert set(got) == {"float_pos.fcs", "double_neg.FCS", "int16.Fcs", "int32.fcs", "empty.fcs"}
    assert np.isnan([got["empty.fcs"][m] for m in ("ifna", "cd14")]).all()
    want = reduce(np.arcsinh(VALUES / 150), axis=0)
    assert [got["double_neg.FCS"][m] for m in ("ifna", "cd14")] == pytest.approx(want[:2].tolist(), abs=1e-12)
    assert got["int32.fcs"]["cd14"] is None
    assert got["float_pos.fcs"]["label"] == "positive" and got["double_neg.FCS"]["label"] == "negative"


def test_gaps_in_a_file(spark):
    nan, inf = float("nan"), float("inf")
    matrix = np.array([[1.0, nan], [nan, inf], [3.0, -inf], [8.0, nan]])
    files = spark.createDataFrame([("/x/gap.fcs", bytearray(encode_fcs(["a", "b"], matrix)))], "path string, content binary")
    files = files.withColumn("length", F.length("content").cast("bigint"))
    row = FCS.load_batch(files, ["a", "b", "c"], transform=False).first()
    assert (row["a"], row["b"], row["c"]) == (3.0, 0.0, None)
    assert FCS.load_batch(files, ["a"], "mean", transform=False).first()["a"] == pytest.approx((1 + 3 + 8 + 3) / 4)
    cells = FCS.load_batch(files, ["a", "b"], "all", transform=False).collect()
    assert sorted((r["a"], r["b"]) for r in cells) == [(1.0, 0.0), (3.0, 0.0), (3.0, 0.0), (8.0, 0.0)]
    with pytest.raises(ValueError):
        FCS.load_batch(files, ["a"], "mode")


def test_empty_and_missing_folder(spark, tmp_path):
    assert FCS.decode_measurements(FCS.scan_files(spark, str(tmp_path)), ["a"]).count() == 0
    with pytest.raises(FileNotFoundError):
        FCS.scan_files(spark, str(tmp_path / "none"))


def test_files_of_several_splits(spark, folder):
    """The same cells and summaries however a file is cut, and from rows that hold the files."""
    files = FCS.scan_files(spark, str(folder))
    rows = FCS.scan_contents(spark, str(folder)).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    names = ["IFNa", "CD14"]
    cells = [sorted(map(str, t.collect())) for t in (
        FCS.decode_measurements(files, names),
        FCS.decode_measurements(files, names, slice_bytes=64, split_bytes=1000),
        FCS.decode_measurements(rows, names),
    )]
    assert cells[0] == cells[1] == cells[2]
    for method in ("median", "mean"):
        found = [
            {r["path"]: r for r in t.collect()}
            for t in (
                FCS.load_batch(files, names, method),
                FCS.load_batch(files, names, method, split_bytes=1000),
                FCS.load_batch(rows, names, method),
            )
        ]
        for other in found[1:]:
            assert other.keys() == found[0].keys()
            for path, row in found[0].items():
                assert other[path]["label"] == row["label"]
                for m in names:
                    assert (row[m] is None) == (other[path][m] is None)
                    assert row[m] is None or np.isclose(row[m], other[path][m], equal_nan=True)


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: 92,000 events of 24,000 bytes, zeros but for the last one, read by several tasks."""
    width, events, begin = 3000, 92_000, 200_000
    fields = {"$BYTEORD": "1,2,3,4", "$DATATYPE": "D", "$MODE": "L", "$PAR": width, "$TOT": events, "$BEGINDATA": begin}
    for i in range(1, width + 1):
        fields |= {f"$P{i}B": 64, f"$P{i}N": f"P{i}"}
    text = ("/" + "".join(f"{k}/{v}/" for k, v in fields.items())).encode()
    assert 58 + len(text) < begin
    path = tmp_path / "large_pos.fcs"
    with open(path, "wb") as out:
        out.write(("FCS3.1    " + f"{58:8d}{57 + len(text):8d}" + f"{0:8d}" * 4).encode() + text)
        out.truncate(begin + events * width * 8)
        out.seek(begin + (events - 1) * width * 8)
        out.write(np.full(width, 7.5).tobytes())
    files = FCS.scan_files(spark, str(tmp_path))
    assert files.first()["length"] > 2 * 10**9
    assert FCS.scan_manifest(files).first()["n_events"] == events
    cells = FCS.decode_measurements(files, ["P2"]).withColumn("task", F.spark_partition_id())
    row = cells.agg(F.count("*").alias("n"), F.sum("P2").alias("s"), F.max_by("event", "P2").alias("at"), F.countDistinct("task").alias("tasks")).first()
    assert (row["n"], row["s"], row["at"]) == (events, 7.5, events - 1)
    assert row["tasks"] > 2


def test_folders_are_listed_in_common_batches(tmp_path):
    """Tasks send one batch for many folders, not one each."""
    import pyarrow as pa

    for i in range(40):
        put(tmp_path, f"{i}/a.fcs", b"FCS")
        put(tmp_path, f"{i}/b.txt", b"ignored")
    folders = pa.RecordBatch.from_pydict({"path": [f"{tmp_path}/{i}" for i in range(40)]})
    found = list(FCS._listed(iter([folders])))
    assert len(found) == 1
    assert found[0].column("path").to_pylist() == [f"{tmp_path}/{i}/a.fcs" for i in range(40)]
    assert found[0].column("length").to_pylist() == [3] * 40 and not any(found[0].column("folder").to_pylist())


def test_many_small_files_in_common_batches(spark, tmp_path, monkeypatch):
    """Cells and summaries do not depend on how many files a task sends together; a file without events or without a marker is between others."""
    for i in range(30):
        names = ["IFNa-PE", "CD14 APC"] if i % 3 else ["IFNa-PE", "x"]
        put(tmp_path, f"{i}.fcs", encode_fcs(names, VALUES[10 * i : 10 * i + i % 4, :2]))
    files = FCS.scan_files(spark, str(tmp_path))
    sent = FCS._over_slices
    batches = spark.sparkContext.accumulator(0)

    def counted(ready, fn, schema, *rest):
        def run(found):
            for batch in fn(found):
                batches.add(1)
                yield batch

        return sent(ready, run, schema, *rest)

    monkeypatch.setattr(FCS, "_over_slices", counted)
    cells = FCS.decode_measurements(files, ["ifna", "cd14"]).collect()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < batches.value <= tasks
    assert len(cells) == sum(i % 4 for i in range(30))
    for r in cells:
        i = int(r["filename"].split(".")[0])
        want = VALUES[10 * i + r["event"], :2].astype("f4").astype(float).tolist()
        assert [r["ifna"], r["cd14"]] == [want[0], want[1] if i % 3 else None]
    batches.value = 0
    rows = {int(r["filename"].split(".")[0]): r for r in FCS.load_batch(files, ["ifna", "cd14"], transform=False).collect()}
    assert 0 < batches.value <= tasks and len(rows) == 30
    for i, r in rows.items():
        want = np.median(VALUES[10 * i : 10 * i + i % 4, :2].astype("f4").astype(float), axis=0) if i % 4 else np.full(2, np.nan)
        assert np.isclose(r["ifna"], want[0], equal_nan=True) and (r["cd14"] is None) == (i % 3 == 0)
        assert i % 3 == 0 or np.isclose(r["cd14"], want[1], equal_nan=True)


def test_cells_of_a_file_from_rows_in_any_order():
    """Files come apart at their keys, whatever batches cut them, also where two files have one hash; nulls are keys and last in the order."""
    import pyarrow as pa

    from markerloom.catalog import samples

    rng = np.random.default_rng(3)
    rows = [(int(s) if s else None, int(o) if o else None, int(n) if n else None, *map(float, rng.random(4))) for s, o, n in rng.integers(0, 6, (400, 3))]
    part = lambda r: None if r[1] is None else r[1] // 2
    key = lambda r: (r[0], part(r))
    h = {k: i // 2 for i, k in enumerate(sorted({key(r) for r in rows}, key=str))}
    rows.sort(key=lambda r: h[key(r)])
    names = ["h", "sample_id", "part", "ord", "line", *samples.M]
    kinds = [pa.int64()] * 5 + [pa.float64()] * 4
    columns = [pa.array(c, kind) for c, kind in zip(zip(*[(h[key(r)], r[0], part(r), *r[1:]) for r in rows]), kinds)]
    whole = pa.RecordBatch.from_arrays(columns, names)
    want = {}
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or 0, r[6])):
        want.setdefault(key(r), []).append(r[3:])
    for size in (1, 7, 400):
        got = list(samples._files_of(whole.slice(a, size) for a in range(0, 400, size)))
        assert len(got) == len(want)
        assert {(s, p): [tuple(v) for v in x.tolist()] for s, p, x in got} == want
