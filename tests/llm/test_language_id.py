from zlib import crc32

import numpy as np
import pytest

from markerloom.llm import language_id
from markerloom.llm.language_id import PIECE, Parser, identify_languages, letters_of, predict_language, training_texts


def slow_phrases(text, train):
    """Greedy parse into the longest pieces that occur in train; an unknown letter is a phrase of its own."""
    n = 0
    for at in range(0, len(text), PIECE):
        piece, i = text[at : at + PIECE], 0
        while i < len(piece):
            j = i
            while j < len(piece) and piece[i : j + 1] in train:
                j += 1
            i = max(j, i + 1)
            n += 1
    return n


def test_phrases_against_brute_force():
    rng = np.random.default_rng(3)
    train = {k: "".join(rng.choice(list(a), 3000)) for k, a in (("aa", "abc de"), ("bb", "abef g"))}
    train = {k: letters_of(v) for k, v in train.items()}
    parser = Parser(train)
    texts = [letters_of("".join(rng.choice(list("abcdefg "), n))) for n in (1, 5, 40, 700, PIECE, 2 * PIECE, 3000)] + [""]
    found = parser.phrases(texts)
    assert found.tolist() == [[slow_phrases(t, train[k]) for k in parser.languages] for t in texts]


@pytest.mark.parametrize("alphabet", [3, 6, 96])
def test_letters_beyond_the_table(monkeypatch, alphabet):
    """Every letter counts as itself, also the rarer ones of large alphabets."""
    monkeypatch.setattr(language_id, "ALPHABET", alphabet)
    rng = np.random.default_rng(4)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    train = {"ja": "".join(rng.choice([*signs[:200], " "], 2000)), "zh": "".join(rng.choice([*signs[100:], " "], 2000))}
    train = {k: letters_of(v) for k, v in train.items()}
    parser = Parser(train)
    texts = [letters_of("".join(rng.choice([*signs, "x", " "], n))) for n in (1, 9, 300, 1200)] + [train["zh"][50:90]]
    assert parser.phrases(texts).tolist() == [[slow_phrases(t, train[k]) for k in parser.languages] for t in texts]


def test_languages_of_long_texts_or_one_id_are_learned(spark):
    long = "los perros comen mucho y los gatos duermen bien " * 575
    rows = [(i, long, "es") for i in range(20)] + [(i, f"the dogs eat a lot and the cats sleep well {i}", "en") for i in range(100, 140)]
    rows += [(7, "die Hunde fressen viel und die Katzen schlafen gut", "de")] * 2000
    texts = training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert texts.keys() == {"de", "en", "es"} and len(texts["es"]) > 10_000


def test_held_out_accuracy(given):
    docs = given("documents")
    rows = {r.doc_id: r for r in identify_languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in rows.items() if r.held_out} == set(held)
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_held_out_rows_teach_nothing(given):
    from pyspark.sql import functions as F

    docs = given("documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    assert training_texts(docs) == training_texts(other)


def test_what_has_a_letter():
    assert letters_of("² ½ 12 _ !") == "" and letters_of("² a_B1c") == "² a b c"


def test_bounds(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LETTERS", 300)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('some words ', id, ' here') AS text", "if(id % 3 = 0, 'a', 'b') AS lang")
    texts = training_texts(docs)
    assert texts.keys() == {"a", "b"} and all(150 < len(t) <= 320 for t in texts.values())
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        training_texts(docs)


def test_odd_rows(odd, clashing, nothing):
    found = identify_languages(odd).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    for i in (1, 2, 3, 6):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[4].lang_pred in ("en", "de", "es", "fr")
    assert sorted(map(str, identify_languages(clashing).collect())) == sorted(map(str, found))
    assert identify_languages(nothing).count() == 0
    assert {r.lang_pred for r in predict_language(odd, {}).collect()} == {"und"}
