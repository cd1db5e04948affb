"""The n-gram join against all pairs of shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from markerloom.llm import ngram_join, queries
from markerloom.llm.dealing import deal

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)])


def by_hand(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    ids = {}
    for i, (key, _) in enumerate(docs):
        ids.setdefault(top(i), []).append(key)
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in ids.items()}
    return sorted(((key, len(sets[i]), least[top(i)]) for i, (key, _) in enumerate(docs)), key=str)


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def family(n, seed, length=60):
    """Texts around one, with few to many words changed, and cut or lengthened ones."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{i}"
        cut = rng.randrange(12)
        out.append(" ".join(w[cut:] if i % 3 else w + [f"y{i}"] * cut))
    return out


def test_whole_table(spark, given):
    got = queries.QUERIES["op12_ngram_join"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = by_hand([(r.doc_id, r.text) for r in given("documents").collect()])
    assert ordered(got) == want
    assert len({c for *_, c in want}) < len(want)


def test_odd_rows_and_clashing_columns(odd, clashing):
    want = by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert ordered(ngram_join.jaccard_components(odd)) == want
    assert ordered(ngram_join.jaccard_components(clashing)) == want


def test_nothing(nothing):
    assert ngram_join.jaccard_components(nothing).count() == 0


@pytest.mark.parametrize("piece, few, group", [(4, 4, 9), (1024, 4, 1024), (1024, 0, 1024)])
def test_families_in_pieces(spark, monkeypatch, piece, few, group):
    """In small and large pieces, by pairs and by rows, by groups of pairs and by each pair."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "PIECE", group)
    texts = [t for seed in range(3) for t in family(60, seed)] + family(40, 9, 7) + family(20, 4, 3)
    docs = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5000, texts[1].upper()), (5001, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert ordered(ngram_join.jaccard_components(df, piece=piece)) == by_hand(docs)


def test_rarest_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 5, ngram_join.TABLE)
    for n in range(1, 60):
        base = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        for drop in range(n):
            a, b = np.unique(base[:n]), np.unique(base[drop : n + drop // 2])
            if len(b) and ngram_join.similar(a, b):
                x, y = ngram_join.rarest(a, table).tolist(), ngram_join.rarest(b, table).tolist()
                first = next(i for i, h in enumerate(x) if h in y)
                places = np.array([first]), np.array([y.index(x[first])])
                assert ngram_join.fitting(np.array([len(a)]), np.array([len(b)]), *places).all()


def test_tree_leaves_every_similar_pair():
    rng = np.random.default_rng(2)
    for n in (1, 2, 15, 17, 200, 600):
        bases = [rng.integers(0, 2**63, 80, dtype=np.uint64) for _ in range(1 + n // 20)]
        sets = [np.unique(np.r_[bases[rng.integers(len(bases))][rng.integers(0, 20) :], rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)]) for _ in range(n)]
        points = np.frombuffer(b"".join(map(ngram_join.group_counts, sets)), "u1").reshape(n, -1)
        sizes = np.array([len(x) for x in sets])
        found = set()
        for i, j in ngram_join.CountTree(points, sizes).pairs():
            found |= {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist())}
        want = {(i, j) for j in range(n) for i in range(j) if ngram_join.similar(sets[i], sets[j])}
        assert want <= found
        assert n < 200 or len(found) <= n * n // 4
        half = n // 2
        across = set()
        for i, j in ngram_join.CountTree(points[:half], sizes[:half]).pairs(ngram_join.CountTree(points[half:], sizes[half:])):
            across |= set(zip(i.tolist(), (j + half).tolist()))
        assert {(i, j) for i, j in want if i < half <= j} <= across


def test_counts_that_do_not_fit():
    big = np.full((1, ngram_join.GROUPS), ngram_join._FULL, np.uint8)
    size = np.array([ngram_join.GROUPS * 70_000])
    assert ngram_join.may_be(big, big, size, size).all()


def dealt_pairs(rows):
    pieces = {}
    for r in rows:
        pieces.setdefault((r.key, r.lo, r.hi), []).append(r)
    pairs = set()
    for here in pieces.values():
        two = len({r.side for r in here}) > 1
        pairs |= {(r.key, r.cls, s.cls) for r in here for s in here if r.cls < s.cls and r.root != s.root and (not two or r.side != s.side)}
    return pairs, max(map(len, pieces.values()))


def test_dealing_brings_all_apart_together(spark):
    rng = random.Random(3)
    rows = [(key, cls, rng.choice([1, 1, 1, cls, 2]), 10) for key in range(4) for cls in range(40 * key + 2)] + [(9, c, 1, 10) for c in range(9)]
    df = spark.createDataFrame(rows, "key long, cls long, root long, n long")
    pairs, largest = dealt_pairs(deal(df, ["key"], "n", 8).collect())
    assert pairs == {(k, a, b) for k, a, r, _ in rows for l, b, s, _ in rows if k == l and a < b and r != s}
    assert largest <= 40


@pytest.mark.parametrize("n", [3000, 6000, 12_000])
def test_dealing_one_outlier_grows_with_the_rows(spark, n):
    rows = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("cls"), F.least("id", F.lit(1)).alias("root"), F.lit(1).alias("n"))
    assert deal(rows, ["key"], "n").count() <= n + n // 1024 + 2


def keyed_classes(rng, n):
    """(cls, n, keys) whose keys are shared by some, places beyond 255 and 65,535 among them."""
    common = rng.integers(-(2**63), 2**63, 300)
    out = []
    for cls in range(n):
        keys = rng.integers(-(2**63), 2**63, 70_000 if cls == 5 else rng.integers(0, 40))
        spots = rng.integers(0, len(keys), 4) if len(keys) else []
        keys[spots] = rng.choice(common, len(spots), replace=False)
        out.append((int(cls * 7 + (cls % 3 << 33)), 5 * len(keys) + 2, keys.tolist()))
    return out


@pytest.mark.parametrize("dealt", [1, 100, 1 << 19])
def test_keys_in_common(monkeypatch, dealt):
    monkeypatch.setattr(ngram_join, "DEALT", dealt)
    rows = keyed_classes(np.random.default_rng(5), 400)
    where = {}
    for cls, n, keys in rows:
        for pos, key in enumerate(keys):
            where.setdefault(key, []).append((cls, n, pos))
    want = set()
    for members in where.values():
        if len(members) > 1 and any(9 * (n - pos) >= 8 * n for _, n, pos in members):
            want |= {(*m, min(c for c, *_ in members)) for m in members}
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 150]), kinds)], names=["cls", "n", "keys"]) for i in range(0, 400, 150)]
    dealt_rows = pa.Table.from_batches(list(ngram_join._to_buckets(iter(batches)))).sort_by("bucket")
    found = pa.Table.from_batches(list(ngram_join._shared(iter(dealt_rows.to_batches())))).to_pylist()
    assert {(r["cls"], r["n"], r["pos"], r["least"]) for r in found} == want and len(found) == len(want)
    assert {len({r["least"] for r in found if r["key"] == k}) for k in {r["key"] for r in found}} == {1}


def test_bytes_that_are_shuffled():
    """A row of a shuffle had 20 bytes for each key, and 240 for a point."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(200, 800), dtype=np.uint64)) for _ in range(3000)]
    keys = [x[: len(x) // 5].view(np.int64) for x in sets]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(3000)), pa.array([len(x) for x in sets]), pa.array(keys, pa.list_(pa.int64()))], names=["cls", "n", "keys"]
    )
    data = b"".join(b"".join(b.column("keys").to_pylist()) for b in ngram_join._to_buckets(iter([batch])))
    assert len(pa.compress(data, "lz4", asbytes=True)) < 12 * sum(map(len, keys))
    points = [ngram_join._packed(ngram_join.group_counts(x)) for x in sets]
    assert sum(map(len, points)) < 180 * len(points)
    assert ngram_join._points(pa.array(points)).tobytes() == b"".join(map(ngram_join.group_counts, sets))


def test_rows_with_a_partner():
    """Pieces of one and two sides, small ones and one too large to look at."""
    rng = np.random.default_rng(7)
    rows = []
    for key in range(120):
        many = 100 if key == 60 else int(rng.integers(1, 9))
        two = bool(rng.integers(0, 2))
        rows += [(key, 0, 0, int(two and rng.integers(0, 2)), c, int(rng.integers(1, 4)), int(rng.integers(40, 80)), int(rng.integers(0, 14))) for c in range(many)]
    names = ["key", "lo", "hi", "side", "cls", "root", "n", "pos"]
    table = pa.table(dict(zip(names, zip(*rows))))
    got = {(r["key"], r["cls"]) for r in ngram_join._with_partner(table).to_pylist()}
    want = set()
    for a in rows:
        mine = [b for b in rows if b[0] == a[0]]
        two = len({b[3] for b in mine}) > 1
        for b in mine:
            fits = 9 * min(a[6] - a[7], b[6] - b[7]) >= 4 * (a[6] + b[6])
            if len(mine) > ngram_join.FEW or (a[4] != b[4] and a[5] != b[5] and fits and (not two or a[3] != b[3])):
                want.add((a[0], a[4]))
    assert got == want and len(got) < len(rows)
