import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.llm import near_copies as nc
from markerloom.llm.near_copies import drop_near_copies, forest, long_fingerprint, simhash_blocks

WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "en", "ir", "ost", "um", "ale", "eri", "on")]


def text(rng, n):
    return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]


def similarity(a, b):
    x, y = (set(zip(*(w[i:] for i in range(5)))) for w in (a, b))
    return len(x & y) / len(x | y)


def family(rng, changes, n=200):
    """A text and a copy in which some words are replaced."""
    base = text(rng, n)
    copy = list(base)
    for i in rng.sample(range(n), changes):
        copy[i] = "changed" + str(rng.random())
    return base, copy


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(3)
    rows, pairs = [], []
    for i in range(120):
        base, copy = family(rng, i % 5)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy).upper() if i % 7 == 0 else " ".join(copy))]
        pairs.append((2 * i, similarity(base, copy)))
    rows += [(1000 + i, " ".join(text(rng, 60))) for i in range(300)]
    # A passage that many texts share, in texts of their own.
    passage = " ".join(text(rng, 55))
    rows += [(2000 + i, " ".join([*text(rng, 150), passage, *text(rng, 150)])) for i in range(60)]
    kept = {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows if i >= 1000 or i % 2 == 0} <= kept
    near = [i + 1 for i, s in pairs if s >= 0.8]
    assert len(near) > 80 and np.mean([i not in kept for i in near]) >= 0.95


def test_distance_estimates_similarity():
    rng = random.Random(1)
    apart = {}
    for changes in (0, 2, 4, 20):
        base, copy = family(rng, changes, 400)
        a, b = (np.frombuffer(long_fingerprint(" ".join(w).encode()), np.uint8)[8 * nc.FIRST :] for w in (base, copy))
        apart[changes] = int(np.bitwise_count(a ^ b).sum())
    assert apart[0] == 0 and apart[0] < apart[4] <= nc.MAX_DISTANCE < apart[20]


@pytest.mark.parametrize("sides", [False, True])
def test_forest_connects_what_all_pairs_connect(sides):
    rng = np.random.default_rng(2)
    centers = rng.integers(0, 2**63, (4, nc.SECOND), dtype=np.uint64)
    prints = centers[rng.integers(0, 4, 80)].copy()
    prints[:, 0] ^= rng.integers(0, 2**40, 80, dtype=np.uint64)
    starts, ends = np.array([0, 30, 31]), np.array([30, 31, 80])
    side = rng.integers(0, 2, 80) if sides else np.zeros(80, int)
    a, b = forest(prints, starts, ends, side)

    def groups(links):
        root = list(range(80))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in links:
            root[find(int(x))] = find(int(y))
        return [sorted(i for i in range(80) if find(i) == find(j)) for j in range(80)]

    every = []
    for s, e in zip(starts, ends):
        mixed = len(set(side[s:e].tolist())) > 1
        for i in range(s, e):
            for j in range(i + 1, e):
                if (not mixed or side[i] != side[j]) and np.bitwise_count(prints[i] ^ prints[j]).sum() <= nc.MAX_DISTANCE:
                    every.append((i, j))
    assert groups(zip(a, b)) == groups(every) and len(a) < 80


def test_a_block_that_many_share(spark, monkeypatch):
    """Groups larger than GROUP are dealt to pairs of buckets without losing a link."""
    monkeypatch.setattr(nc, "GROUP", 16)
    rng = random.Random(6)
    base = text(rng, 300)
    rows = []
    for i in range(120):
        copy = list(base)
        copy[rng.randrange(300)] = f"other{i}"
        rows.append((i, " ".join(copy)))
    assert [r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_odd_rows(odd, clashing, nothing):
    kept = drop_near_copies(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 6, 7, 8]
    assert [r.text for r in kept if r.doc_id is None] == ["A text without an id, which is long enough to hold some words."]
    wide = drop_near_copies(clashing)
    assert wide.columns == clashing.columns and wide.count() == len(kept)
    assert drop_near_copies(nothing).count() == 0


def test_many_copies_are_one_class(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a text that everybody copies " * 5).alias("text"))
    assert drop_near_copies(docs).count() == 1


def edited(rng, kind, n):
    """A text and a copy with one edit of the kind, whose similarity is a little over 0.8."""
    base = text(rng, n)
    more = [f"new{rng.random()}" for _ in range(n)]
    at, order = rng.randrange(n // 2), rng.sample(range(n), n)
    for size in range(n // 3, 0, -1):
        if kind == "appended":
            copy = base + more[:size]
        elif kind == "truncated":
            copy = base[: n - size]
        elif kind == "block":
            copy = base[:at] + more[:size] + base[at + size :]
        else:
            copy = list(base)
            for i in order[:size]:
                copy[i] = more[i]
        if similarity(base, copy) >= 0.8:
            return base, copy


@pytest.mark.parametrize("kind", ["appended", "truncated", "block", "words"])
def test_copies_of_every_kind_share_a_block(kind):
    rng = random.Random(8)
    shared = []
    for i in range(60):
        pair = edited(rng, kind, rng.randrange(100, 400))
        assert 0.8 <= similarity(*pair) < 0.9
        a, b = (np.frombuffer(long_fingerprint(" ".join(w).encode())[: 8 * nc.FIRST], "<u4") for w in pair)
        shared.append(bool((a == b).any()))
    assert all(shared)


def test_texts_of_little_similarity_share_few_blocks():
    rng = random.Random(9)
    prints = [np.frombuffer(long_fingerprint(" ".join(text(rng, 200)).encode())[: 8 * nc.FIRST], "<u4") for _ in range(80)]
    assert sum((a == b).any() for i, a in enumerate(prints) for b in prints[:i]) == 0


@pytest.mark.parametrize("group", [1024, 4])
def test_links_are_those_of_all_pairs_at_the_similarity(spark, monkeypatch, group):
    """Also where the smallest text of a block is like none of the others that share it."""
    monkeypatch.setattr(nc, "GROUP", group)
    rng = random.Random(12)
    texts = []
    for family_of in range(12):
        base = text(rng, 120)
        for _ in range(9):
            copy = list(base)
            at, size = rng.randrange(90), rng.randrange(1, 30)
            copy[at : at + size] = text(rng, size)
            texts.append(copy if rng.random() < 0.6 else base + text(rng, rng.randrange(1, 50)))
    rng.shuffle(texts)
    root = list(range(len(texts)))
    between = 0
    for j in range(len(texts)):
        for i in range(j):
            near = similarity(texts[i], texts[j])
            between += 0.65 <= near < 0.8
            if near >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, r in enumerate(root) if r == i} and between > 50


def test_simhash_blocks_are_its_components(spark):
    a, b = 0x0123456789ABCDEF, -5
    prints = [(0, a), (1, a ^ 3), (2, a ^ 15), (3, a), (4, b), (5, b), (6, 77)]
    found = {r.cls: bytes(r.v) for r in simhash_blocks(spark.createDataFrame(prints, "cls long, print long")).collect()}
    assert found.keys() == {0, 1, 2, 3, 4, 5} and {len(v) for v in found.values()} == {nc.BLOCK_BYTES}
    assert len({found[i] for i in (0, 1, 2, 3)}) == 1 and found[4] == found[5] != found[0]


def test_texts_of_a_simhash_component_are_compared(spark):
    """Also where they share no block of MinHash values; and only similar ones are linked."""
    rng = random.Random(4)
    base = text(rng, 100)
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(["other", *base]), " ".join(text(rng, 100))]
    sets = [nc.shingle_set(t.encode()) for t in texts]
    # First parts of which no two blocks are equal.
    prints = [np.arange(2 * nc.FIRST, dtype="<u4") + 1000 * i for i in range(4)]
    fps = [bytearray(p.tobytes() + nc.fingerprint_of(x)[8 * nc.FIRST :]) for p, x in zip(prints, sets)]
    classes = spark.createDataFrame([(i, fp, len(x)) for i, (fp, x) in enumerate(zip(fps, sets))], "cls long, fp binary, size long")
    shingles = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "cls long, shingles binary")
    more = spark.createDataFrame([(i, bytearray(b"same")) for i in range(4)], "cls long, v binary")
    sets_of = lambda wanted: shingles.join(wanted, "cls", "left_semi")
    assert nc.near_links(classes, sets_of).count() == 0
    links = {(r.a, r.b) for r in nc.near_links(classes, sets_of, more).collect()}
    assert {(0, 1), (0, 2)} <= links and not any(3 in x for x in links)
