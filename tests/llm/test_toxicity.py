from zlib import crc32

import pytest

from markerloom.llm.toxicity import (
    Lexicon,
    fold,
    judge_toxicity,
    learn_lexicon,
    matches,
    score_toxicity,
    training_rows,
)


def test_folding():
    assert fold("M0R0N!") == fold("moron") == " moron "
    assert fold("\u0456d\u0456\u043et tr@sh $cum") == " idiot trash scum "
    assert fold("ｉｄｉｏｔ 1oser LOSER") == " idiot ioser ioser "
    assert fold("don't stop-now") == " dont stop now "
    assert fold("") == "  "


def test_exceptions_and_length():
    lexicon = Lexicon({" trash ": 5.0, " vequ": 4.0}, [" trash can "])
    automaton = lexicon.automaton()
    assert matches(fold("empty the trash can"), automaton) == []
    assert [w for *_, w in matches(fold("you trash, a vequeur! trash trash"), automaton)] == [5.0, 4.0, 5.0, 5.0]
    assert matches(fold("trashy"), automaton) == []


def test_score_falls_with_length(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "you idiot " + "calm words " * 500), (3, "calm words"), (4, None)], "doc_id long, text string")
    lexicon = Lexicon({" idiot ": 6.0}, curve=(-4.0, 1.0, 1.0))
    s = {r.doc_id: r.score for r in score_toxicity(docs, lexicon).collect()}
    assert s[1] > s[2] > s[3] == s[4] and 0 < s[3] < 1


def rows(n):
    """Toxic documents with a learned word, a learned stem, or a disguised word; a phrase that only clean ones have."""
    out = []
    for i in range(n):
        calm = f"some calm words number {i} in a row that say nothing at all"
        if i % 4 == 0:
            out.append((i, f"{calm} you clown {'cl0wn' if i % 8 else 'clown'}", 1))
        elif i % 4 == 1:
            out.append((i, f"{calm} grubba{'abcdefgh'[i % 8]}{i}", 1))
        elif i % 100 == 2:
            out.append((i, f"{calm} the clown fish swims", 0))
        else:
            out.append((i, calm, 0))
    return out


def test_learned_entries_and_phrases(spark):
    data = rows(1200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    found = {r.doc_id: r for r in judge_toxicity(docs, labels).collect()}
    held = [i for i, *_ in data if crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in found.items() if r.held_out} == set(held)
    wrong = [i for i, _, y in data if i in set(held) and found[i].predicted != y]
    assert not wrong
    extra = spark.createDataFrame([(1, "what a CL0WN"), (2, "a clown fish"), (3, "grubbazzz")], "doc_id long, text string")
    lexicon = learn_lexicon(docs, training_rows(labels, "doc_id", "toxic"))
    s = {r.doc_id: r.score for r in score_toxicity(extra, lexicon).collect()}
    assert s[1] > 0.7 > s[2] and s[3] > 0.7


def test_held_out_labels_change_nothing(spark, given):
    docs, labels = given("documents"), given("labels")
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted(map(str, judge_toxicity(docs, labels).collect()))
    assert a == sorted(map(str, judge_toxicity(docs, flipped).collect()))


def test_odd_rows(odd, clashing, nothing, labels):
    found = judge_toxicity(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert sorted(map(str, judge_toxicity(clashing, labels).collect())) == sorted(map(str, found))
    assert judge_toxicity(nothing, labels).count() == 0
    assert judge_toxicity(odd, labels.limit(0)).where("predicted = 1").count() == 0


def test_given_entries_alone(spark):
    docs = spark.createDataFrame([(1, "you m0ron")], "doc_id long, text string")
    none = spark.createDataFrame([], "id long, y int")
    lexicon = learn_lexicon(docs, none, given={"moron": 6.0}, harmless=["moron test"])
    assert lexicon.terms == {" moron ": 6.0} and lexicon.phrases == [" moron test "]
    assert score_toxicity(docs, lexicon).first().score == pytest.approx(0.8, abs=0.2)
