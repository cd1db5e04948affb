import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from markerloom.llm import simhash
from markerloom.llm.components import connected_components
from markerloom.llm.simhash import fingerprint, near_duplicates


def slow_fingerprint(text, width=3):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, ids):
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for p, k in zip(prints, ids):
        if k is not None:
            least[find(p)] = min(least.get(find(p), k), k)
    return [least.get(find(p)) for p in prints]


def test_fingerprint_matches_definition(spark):
    for text in ["", "one", "Two words", "A b  C\td\n" * 40, "ÄÖ ü Ä x Y", "same same same same same"]:
        assert fingerprint(text.encode()) % 2**64 == slow_fingerprint(text)
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert fingerprint(b"A b\nc") == row.h


def test_whole_table_against_brute_force(spark, given):
    docs = given("documents")
    rows = docs.collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    expected = dict(zip([r.doc_id for r in rows], zip([f"{p:016x}" for p in prints], slow_components(prints, [r.doc_id for r in rows]))))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert found == expected


@pytest.mark.parametrize("pairwise", [256, 2])
def test_links_of_crowded_blocks(spark, pairwise):
    """A chain, a dense crowd around one fingerprint, and strangers, with and without the path for large groups."""
    rng = random.Random(5)
    crowd = {7} | {7 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)}
    chain = {1 << 40}
    at = 1 << 40
    for i in range(0, 30, 2):
        at ^= (1 << i) | (1 << i + 1)
        chain.add(at)
    prints = sorted(crowd | chain | {rng.getrandbits(64) for _ in range(100)})
    table = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    roots = connected_components(simhash.fingerprint_links(table, pairwise)).collect()
    found = {r.node % 2**64: r.root for r in roots}
    expected = slow_components(prints, prints)
    groups = {}
    for p, c in zip(prints, expected):
        groups.setdefault(c, set()).add(p)
    for members in groups.values():
        if len(members) > 1:
            assert len({found[p] for p in members}) == 1
        else:
            assert not members & found.keys()
    assert len(set(found.values())) == sum(len(m) > 1 for m in groups.values())


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(5, 5)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[1000 + i] for i in range(51)} == {1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, clashing, nothing):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {None, 1, 2, 3} and {r.component_id for r in zero} == {1}
    same = [r for r in rows if r.doc_id in (5, 9)]
    assert len(same) == 3 and {r.component_id for r in same} == {5}
    assert sorted(map(str, near_duplicates(clashing).collect())) == sorted(map(str, rows))
    assert near_duplicates(nothing).count() == 0


def test_many_copies_are_one_node(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a text that everybody copies " * 5).alias("text"))
    assert near_duplicates(docs).select("component_id").distinct().collect()[0][0] == 0


def test_block_masks_leave_one_untouched():
    masks = simhash.block_masks()
    rng = np.random.default_rng(1)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
        assert any(not m & flips for m in masks)
