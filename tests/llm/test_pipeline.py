import pytest

import corpus_pipeline
from markerloom.llm import decontaminate, near_copies, quality
from markerloom.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "mixing", "token output"]


def test_every_stage_does_what_its_operator_says(spark, given):
    docs = given("documents")
    kept = {r.doc_id for r in quality.judge_quality(docs, given("labels")).where("kept").collect()}
    one = stored(corpus_pipeline.quality_rules(spark, docs, FOLDER), "test-one")
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    two = stored(corpus_pipeline.near_duplicates(spark, one, FOLDER), "test-two")
    firsts = {r.doc_id for r in near_copies.drop_near_copies(one).collect()}
    # One row of each text, and the smallest id of it.
    least = {}
    for r in one.collect():
        words = tuple(r.text.encode().lower().split())
        least[words] = min(least.get(words, r.doc_id), r.doc_id)
    assert firsts <= set(least.values()) and len(firsts) >= 0.9 * len(least)
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(firsts)
    three = stored(corpus_pipeline.decontamination(spark, two, FOLDER), "test-three")
    bad = {r.doc_id for r in decontaminate.contamination_report(two, given("benchmark")).collect()}
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == firsts - bad
    four = stored(corpus_pipeline.mixing(spark, three, FOLDER), "test-four")
    assert four.columns == docs.columns and 0 < four.count() <= three.count()
    five = corpus_pipeline.token_output(spark, four, FOLDER).orderBy("start").collect()
    assert [r.doc_id for r in five] == sorted(r.doc_id for r in four.collect())
    assert [r.start for r in five[1:]] == [r.start + r.n_tokens for r in five[:-1]]
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, whole.collect())) == sorted(map(str, five))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, clashing, odd, nothing, name, stage):
    for docs in (odd, clashing):
        out = stored(stage(spark, docs, FOLDER), "test-odd")
        if name != "token output":
            assert out.columns == docs.columns
        assert out.count() <= docs.count()
    assert stage(spark, nothing, FOLDER).count() == 0
