from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.llm.mixing import (
    KEEP,
    OTHER,
    cell_words,
    mix,
    rake,
    rake_to_total,
    share_kept,
    tempered,
    tempered_targets,
    text_kind,
    word_count,
)
from markerloom.llm.queries import mixed


def margins():
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": text_kind(F.col("text"))}


def test_rake_reaches_every_margin():
    rng = np.random.default_rng(1)
    shape = (4, 3, 2)
    codes = np.array([c for c in np.ndindex(shape)]).T
    words = rng.integers(1, 1000, codes.shape[1]).astype(float)
    goals = [rng.dirichlet(np.ones(n)) for n in shape]
    factors = rake(words, codes, goals)
    for code, goal in zip(codes, goals):
        share = np.bincount(code, words * factors) / (words * factors).sum()
        assert share == pytest.approx(goal, abs=1e-8)
    # Odds ratios within the table are those of the words: the factors are a product over the margins.
    logs = np.log(factors).reshape(shape)
    assert np.abs(logs - logs[:1] - logs[:, :1] + logs[:1, :1]).max() < 1e-6


def test_a_target_without_words_is_spread():
    factors = rake(np.array([3.0, 1.0]), np.array([[0, 1]]), [np.array([0.4, 0.4, 0.2])])
    assert (np.array([3.0, 1.0]) * factors)[0] == pytest.approx((np.array([3.0, 1.0]) * factors)[1])
    with pytest.raises(ValueError):
        rake(np.array([1.0]), np.array([[0]]), [np.array([0.0, 1.0])])
    assert rake(np.array([0.0]), np.array([[0]]), [np.array([1.0])]).tolist() == [1.0]


def test_expected_margins_of_the_whole_table(given):
    docs = given("documents")
    _, cells = mixed(docs)
    rows = cells.collect()
    total = sum(r.words * r.probability for r in rows)
    by = {}
    for r in rows:
        by[r.lang] = by.get(r.lang, 0) + r.words * r.probability / total
    assert by == pytest.approx({"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}, abs=1e-6)
    assert max(r.probability for r in rows) == pytest.approx(1.0)
    assert sum(r.words for r in rows) == docs.select(F.sum(word_count(F.col("text")))).first()[0]


def test_draw_is_the_hash_against_the_probability(given):
    docs = given("documents")
    sample, cells = mixed(docs)
    chance = {(r.source, r.lang, r.topic): r.probability for r in cells.collect()}
    rows = docs.select("*", text_kind(F.col("text")).alias("topic"), F.xxhash64(F.lit(42), "doc_id").alias("h")).collect()
    want = {r.doc_id for r in rows if ((r.h % 2**64) >> 11) / 2**53 < chance[r.source, r.lang, r.topic]}
    assert {r.doc_id for r in sample.collect()} == want and sample.columns == docs.columns


def test_others_keep_their_share(spark):
    docs = spark.createDataFrame([(i, "one two", "a" if i < 60 else "b" if i < 80 else f"x{i}") for i in range(100)], "doc_id long, text string, source string")
    _, cells = mix(docs, {"source": F.col("source")}, {"source": {"a": 0.5, "b": 0.5}})
    rows = {r.source: r for r in cells.collect()}
    total = sum(r.words * r.probability for r in rows.values())
    assert rows[OTHER].words * rows[OTHER].probability / total == pytest.approx(0.2)
    assert rows["a"].words * rows["a"].probability == pytest.approx(rows["b"].words * rows["b"].probability)


def test_odd_rows(odd, clashing, nothing):
    targets = {"source": {"src0": 0.5, "src1": 0.5}, "lang": {"en": 0.6, "": 0.4}, "topic": {"prose": 1.0}}
    sample, _ = mix(odd, margins(), targets)
    assert sample.columns == odd.columns and 0 < sample.count() <= odd.count()
    wide, _ = mix(clashing, margins(), targets)
    assert wide.columns == clashing.columns
    assert sorted(str(tuple(r)) for r in wide.select(*odd.columns).collect()) == sorted(str(tuple(r)) for r in sample.collect())
    assert mix(nothing, margins(), targets)[0].count() == 0
    assert mixed(nothing)[0].count() == 0
    # Without any word everything stays.
    blank = odd.where("doc_id IN (1, 2, 3)")
    assert mix(blank, margins(), targets)[0].count() == 3


def test_rate_and_limit(given):
    docs = given("documents")
    targets = {"lang": tempered({"en": 1.0, "de": 1.0}, 1)}
    half, _ = mix(docs, {"lang": F.col("lang")}, targets, rate=0.5)
    full, _ = mix(docs, {"lang": F.col("lang")}, targets)
    assert {r.doc_id for r in half.collect()} < {r.doc_id for r in full.collect()}
    with pytest.raises(ValueError):
        mix(docs, {"lang": F.col("lang")}, {"lang": {str(i): 1.0 for i in range(1_000_001)}})


def test_one_tiny_cell_does_not_set_the_rate(given):
    docs = given("documents")
    tiny = docs.limit(1).selectExpr("-1L doc_id", "'un petit texte de six mots' text", "'fr' lang", "'new' source", "27L n_chars")
    before, after = (share_kept(mixed(d)[1]) for d in (docs, docs.unionByName(tiny.select(docs.columns))))
    assert before == pytest.approx(KEEP, abs=1e-6) and after == pytest.approx(before, abs=1e-6)


def test_cells_above_one_stay_whole_and_the_rest_is_raked_again():
    rng = np.random.default_rng(5)
    codes = np.array([c for c in np.ndindex(6, 4)]).T
    words = rng.integers(1000, 100_000, 24).astype(float)
    words[codes[0] == 5] = 2.0
    goals = [np.full(6, 1 / 6), np.array([0.4, 0.2, 0.2, 0.2])]
    total = 0.4 * words.sum()
    chances = np.minimum(rake_to_total(words, codes, goals, total), 1.0)
    expected = words * chances
    assert expected.sum() == pytest.approx(total) and chances[codes[0] == 5] == pytest.approx(1.0)
    assert np.bincount(codes[1], expected) / total == pytest.approx(goals[1], abs=1e-8)
    assert np.bincount(codes[0], expected)[:5] == pytest.approx((total - 8) / 5)


def test_every_source_has_its_tempered_target(spark):
    """1200 sources of 2 to 39 documents, more than have a name among the targets."""
    rows = [(1200 * i + s, "one two three", f"s{s}") for s in range(1200) for i in range(2 + s * s % 38)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    margins = {"source": F.col("source")}
    cells = cell_words(docs, margins)
    targets, classes = tempered_targets(cells, "source", 0.8)
    sample, table = mix(docs, margins, {"source": targets}, cells=cells, classes={"source": classes})
    of = {r["value"]: r["class"] for r in classes.collect()}
    chance = {r.source: r.probability for r in table.collect()}
    sizes = Counter(r[2] for r in rows)
    want = tempered({s: n / len(rows) for s, n in sizes.items()}, 0.8)
    have = {s: n * chance[of.get(s, s)] / (KEEP * len(rows)) for s, n in sizes.items()}
    assert len(of) == 200 and OTHER not in chance
    assert have == pytest.approx(want, rel=0.02)
    hashes = docs.select("doc_id", "source", F.xxhash64(F.lit(42), "doc_id").alias("h")).collect()
    drawn = {r.doc_id for r in hashes if ((r.h % 2**64) >> 11) / 2**53 < chance[of.get(r.source, r.source)]}
    assert {r.doc_id for r in sample.collect()} == drawn and sample.columns == docs.columns
