"""Importance resampling against a plain computation over all features."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from markerloom.llm import queries, resampling

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [crc32(r.encode()) % 10000 for r in runs]


def by_hand(docs, target, share=(5, 100)):
    corpus, wanted = Counter(), Counter()
    made = [(key, *features(text)) for key, text in docs]
    for _, _, f in made:
        corpus.update(f)
    for text in target:
        wanted.update(features(text)[1])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((corpus[b] + 1) * (t + 10000)))) for b in range(10000)]
    rows = []
    for key, n, f in made:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: share[0] * len(able) // share[1]]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_whole_table(spark, given):
    docs = [(r.doc_id, r.text) for r in given("documents").collect()]
    want = by_hand(docs, [r.text for r in given("benchmark").collect()])
    got = queries.QUERIES["op13_resampling"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[4] is not None for r in want) > 0


def test_odd_rows_and_clashing_columns(odd, clashing):
    target = odd.where("doc_id = 4")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = by_hand(rows, [r.text for r in target.collect()], (1, 1))
    for docs in (odd, clashing):
        got = resampling.importance_resample(docs, target, share=(1, 1))
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_nothing(odd, nothing):
    assert resampling.importance_resample(nothing, odd).count() == 0
    assert resampling.importance_resample(odd, nothing).count() == odd.count()


@pytest.mark.parametrize("share", [(0, 100), (1, 7), (1, 2), (1, 1)])
def test_ties_repeated_rows_and_missing_keys(spark, share):
    words = " ".join(f"w{i}" for i in range(25))
    rows = [(i, words) for i in (5, 3, 9, 3, 3)] + [(None, words)] * 3 + [(i, words + f" x{i}") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resampling.importance_resample(docs, docs, share=share)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows, [t for _, t in rows], share)


def test_cutoff_by_sections(spark):
    values = [7, 7, 7, -3, 0, 12, 12, 500, -40]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for wanted in range(1, len(values) + 1):
        low, above = resampling.cutoff(rows, F.col("v"), wanted)
        assert low == sorted(values, reverse=True)[wanted - 1]
        assert above == sum(v > low for v in values)
    assert resampling.cutoff(rows, F.col("v"), len(values) + 1) is None


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"wörd{i % 17} {'x' * (i % 90)}" for i in range(700)).encode()
    want = sorted(features(text.decode())[1])
    for size in (1, 2, 3, 64, 100_000):
        monkeypatch.setattr(resampling, "WORDS", size)
        got = [b for run in resampling.feature_buckets(resampling.words_of(text)) for b in run.tolist()]
        assert sorted(got) == want


def test_drawn_documents_keep_their_columns(spark, given):
    docs = given("documents").withColumn("score", F.lit("mine"))
    kept = resampling.resampled(docs, given("benchmark"))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
