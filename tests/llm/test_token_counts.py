import public_tokenizers
import pytest
from tokenizers import Tokenizer

from markerloom.llm.token_counts import section_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow(text, rule):
    """Token counts per line of a text, by its token spans."""
    text = text or ""
    library = Tokenizer.from_file(PATH)
    cuts = [0]
    for i, c in enumerate(text):
        if c == "\n" and (i + 1 == len(text) or text[i + 1] != "\n") and 0 < i + 1 < len(text):
            cuts.append(i + 1)
    ends = [*cuts[1:], len(text)]
    counts = [0.0] * len(cuts)
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        shares = [max(0, min(b, y) - max(a, x)) for x, y in zip(cuts, ends)]
        touched = [i for i, s in enumerate(shares) if s]
        if rule == "share":
            for i in touched:
                counts[i] += shares[i] / sum(shares)
        else:
            counts[{"first": touched[0], "last": touched[-1], "largest": max(touched, key=lambda i: (shares[i], -i))}[rule]] += 1
    return [(i, x, y, c) for i, (x, y, c) in enumerate(zip(cuts, ends, counts))]


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.section, r.start_char, r.end_char, r.n_tokens))
    return {k: sorted(v) for k, v in out.items()}


def test_whole_table(given):
    docs = given("documents")
    found = rows_of(section_tokens(docs, PATH))
    assert found == {r.doc_id: slow(r.text, "largest") for r in docs.collect()}


@pytest.mark.parametrize("rule", ["largest", "first", "last", "share"])
def test_crossing_tokens(spark, rule):
    """Sections cut inside of words, so that tokens cross."""
    text = "internationalization of straightforwardness and   spaces"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = section_tokens(docs, PATH, rule, pattern="(?=[aeio])").orderBy("section").collect()
    library = Tokenizer.from_file(PATH)
    tokens = library.encode(text, add_special_tokens=False)
    assert sum(r.n_tokens for r in rows) == pytest.approx(len(tokens.ids))
    assert sum(r.n_crossing for r in rows) > 0
    want = [0.0] * len(rows)
    for a, b in tokens.offsets:
        shares = [max(0, min(b, r.end_char) - max(a, r.start_char)) for r in rows]
        touched = [i for i, s in enumerate(shares) if s]
        for i in touched:
            if rule == "share":
                want[i] += shares[i] / (b - a)
        if rule != "share":
            want[{"first": touched[0], "last": touched[-1], "largest": max(touched, key=lambda i: (shares[i], -i))}[rule]] += 1
    assert [r.n_tokens for r in rows] == pytest.approx(want)


def test_odd_rows(odd, clashing, nothing):
    found = section_tokens(odd, PATH)
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    rows = rows_of(found.where("doc_id IS NOT NULL"))
    assert rows.pop(5) == sorted(slow(texts[5], "largest") * 2)
    assert rows == {k: slow(t, "largest") for k, t in texts.items() if k != 5}
    assert sorted(map(str, section_tokens(clashing, PATH).collect())) == sorted(map(str, found.collect()))
    assert section_tokens(nothing, PATH).count() == 0
    with pytest.raises(ValueError):
        section_tokens(odd, PATH, "middle")
