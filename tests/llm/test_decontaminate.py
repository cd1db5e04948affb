import random
import re
from zlib import crc32

import numpy as np
import pytest

from markerloom.llm.decontaminate import (
    MASKS,
    MIN_ITEM,
    RUN_SHARE,
    best_run,
    contamination_report,
    decontaminate,
    needed,
    seed_hashes,
    word_codes,
)

VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("r", "st", "nd", "l", "x")]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_benchmark_passages_of_the_whole_table(given):
    docs, bench = given("documents"), given("benchmark")
    plain = lambda t: f" {' '.join(re.sub(r'[!-/:-@\[-`{-~]', ' ', t.lower()).split())} "
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in plain(r.text)}
    found = {(r.doc_id, r.item_id) for r in contamination_report(docs, bench).collect()}
    assert want <= found
    # What else is found must share a long run with the item.
    assert len(found - want) <= 0.02 * docs.count()


@pytest.mark.parametrize("share", [0.0, 0.08, 0.12])
def test_substitutions(spark, share):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 25))) for i in range(40)]
    docs = []
    for i, t in items:
        copy = [w if rng.random() >= share else "zzz" for w in t.split()]
        docs.append((i, " ".join([*words(rng, 100), *copy, *words(rng, 100)])))
    docs += [(1000 + i, " ".join(words(rng, 300))) for i in range(100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in contamination_report(table, bench).collect()}
    assert {d for d, _ in found} <= set(range(40)) and all(d == i for d, i in found)
    assert len(found) >= 38


def slow_best(doc, item, diagonal):
    """Equal words of the best run, at RUN_SHARE or more, over all runs of a diagonal."""
    best = 0
    same = [doc[i + diagonal] == w for i, w in enumerate(item) if 0 <= i + diagonal < len(doc)]
    for a in range(len(same)):
        for b in range(a + 1, len(same) + 1):
            if sum(same[a:b]) >= RUN_SHARE * (b - a):
                best = max(best, sum(same[a:b]))
    return best


def test_best_run_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(300):
        doc, item = rng.integers(0, 2, 30), rng.integers(0, 2, 12)
        if rng.random() < 0.5:
            doc[9:21] = np.where(rng.random(12) < 0.85, item, doc[9:21])
        d = int(rng.integers(-8, 25))
        equal, length = best_run(doc, item, d)
        assert equal >= RUN_SHARE * length or length == 0
        assert equal == slow_best(doc.tolist(), item.tolist(), d)


def test_masks_ignore_their_gaps():
    codes = np.arange(40, dtype=np.uint32)
    for mask in MASKS:
        for i, c in enumerate(mask):
            other = codes.copy()
            other[10 + i] = 999
            assert (seed_hashes(codes, mask)[10] == seed_hashes(other, mask)[10]) == (c == "0")
    assert word_codes("Don't, STOP!").tolist() == [crc32(w) for w in (b"don", b"t", b"stop")]


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "seven little words in a short item"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "so alpha beta gamma delta it is"), (2, "behold Seven little words, in a short item!"), (3, "seven big words in a short item")],
        "doc_id long, text string",
    )
    assert needed(7) == 6 and MIN_ITEM == 5
    assert [(r.doc_id, r.item_id) for r in contamination_report(docs, bench).collect()] == [(2, 2)]


def test_hot_passage(spark):
    passage = " ".join(words(random.Random(1), 30))
    docs = spark.range(2000).selectExpr("id AS doc_id", f"if(id % 3 = 0, 'a {passage} b', concat('clean ', id)) AS text")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert contamination_report(docs, bench).count() == 667
    assert decontaminate(docs, bench).count() == 2000 - 667


def test_odd_rows(spark, odd, clashing, nothing):
    bench = spark.createDataFrame([(1, "the same row twice over and once more"), (None, "unrelated words that nobody has written here")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in contamination_report(odd, bench).collect())
    assert found == [(5, 1), (9, 1)]
    left = decontaminate(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 3
    wide = decontaminate(clashing, bench)
    assert wide.columns == clashing.columns and wide.count() == left.count()
    assert contamination_report(nothing, bench).count() == 0
    assert decontaminate(odd, bench.limit(0)).count() == odd.count()
    # A contaminated text without an id goes, other rows without an id stay.
    extra = odd.limit(0).union(spark.createDataFrame([(None, "so the same row twice over and once more", "en", "s", 1)], odd.schema)).union(odd)
    assert decontaminate(extra, bench).count() == left.count()
