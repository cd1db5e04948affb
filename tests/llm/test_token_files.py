import tracemalloc
from time import process_time
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from markerloom.llm import token_files as tf
from markerloom.llm.range_coder import BLOCK, MAX_ID, checksum, cut, decode_blocks, encode_blocks
from markerloom.llm.token_files import token_files
from markerloom.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(open(PATH, encoding="utf-8").read())


def expected(rows, library):
    """(doc_id, start, n_tokens, crc) of the rows, which are in order."""
    out, start = [], 0
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, given, library):
    docs = given("documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    found = sorted(tuple(r) for r in token_files(docs, PATH).collect())
    assert found == expected(rows, library)


def test_odd_rows(spark, odd, clashing, nothing, library):
    found = token_files(odd, PATH).collect()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    whole = sorted((tuple(r) for r in found if r.doc_id is not None), key=lambda r: r[1])
    shift = sum(r.n_tokens for r in found if r.doc_id is None)
    keys = [r[0] for r in whole]
    assert keys == sorted([*texts, 5])
    assert whole == [(k, s + shift, n, c) for k, s, n, c in expected([(k, texts[k]) for k in keys], library)]
    # Rows without an id come first.
    assert sorted(r.start for r in found if r.doc_id is None)[0] == 0 and shift == whole[0][1]
    assert sorted(map(str, token_files(clashing, PATH).collect())) == sorted(map(str, found))
    assert token_files(nothing, PATH).count() == 0


def test_segments_and_damage(spark, given, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SEGMENT", 5000)
    path = str(tmp_path / "files")
    tf.write_token_files(given("documents").coalesce(1), path, tf.TokenizerFile(PATH))
    segments = spark.read.parquet(path).collect()
    row = segments[0].asDict()
    assert all(sum(s.lengths) == sum(s.sizes) for s in segments) and len(row["payloads"]) >= 2
    assert len(tf.decoded(row)) == sum(row["lengths"])
    broken = bytearray(row["payloads"][1])
    broken[9] ^= 4
    row["payloads"] = [row["payloads"][0], bytes(broken), *row["payloads"][2:]]
    with pytest.raises(ValueError, match="checksum"):
        tf.decoded(row)


@pytest.mark.parametrize(
    "ids",
    [
        np.array([0]),
        np.arange(MAX_ID - 5, MAX_ID),
        np.tile([5, 6, 7, 5, 6, 8], 2000),
        np.random.default_rng(1).integers(0, MAX_ID, 3 * BLOCK + 17),
        np.random.default_rng(2).zipf(1.4, 20000) % 50257,
        np.zeros(2 * BLOCK, int),
    ],
)
def test_coder_round_trip(ids):
    blocks = cut(ids.astype(np.int64))
    payloads = encode_blocks(blocks)
    found = decode_blocks(payloads, [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, found))
    # Blocks are independent of each other.
    last = decode_blocks(payloads[-1:], [len(blocks[-1])])[0]
    assert checksum(last) == checksum(blocks[-1])


@settings(max_examples=60, deadline=None)
@cases(st.lists(st.integers(0, 60), min_size=1, max_size=300), st.integers(1, 100))
def test_coder_any_blocks(values, block):
    blocks = cut(np.array(values), block)
    found = decode_blocks(encode_blocks(blocks), [len(b) for b in blocks])
    assert np.concatenate(found).tolist() == values


def test_coder_learns_and_refuses():
    assert sum(map(len, encode_blocks(cut(np.tile([9, 8, 7, 6], 4096))))) * 8 < 0.5 * 4 * 4096
    assert encode_blocks([]) == [] and decode_blocks([], []) == []
    with pytest.raises(ValueError):
        encode_blocks([np.array([MAX_ID])])


texts = st.lists(st.sampled_from(list("ab'stv!? \n\t\r\x0b\x1c\x85  éß漢🙂1٣<|>") + ["<|endoftext|>", "  ", " \n"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@cases(st.lists(texts, max_size=4))
def test_chunks_equal_whole_texts(encoder, library, values):
    whole = library.encode_batch(values, add_special_tokens=False)
    assert [i.tolist() for i in encoder.ids(values)] == [e.ids for e in whole]
    assert [list(map(tuple, s.tolist())) for s in encoder.spans(values)] == [e.offsets for e in whole]


def test_memory_of_chunks_is_bounded(encoder, library, monkeypatch):
    import markerloom.llm.tokens as tokens

    monkeypatch.setattr(tokens, "MEMO", 10)
    for i in range(5):
        values = [f"some {i} words {i * 7} that differ {i}", f"and {i + 1} more words"]
        assert [x.tolist() for x in encoder.ids(values)] == [e.ids for e in library.encode_batch(values, add_special_tokens=False)]


def test_other_tokenizers_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Encoder(open(path, encoding="utf-8").read())
    library = Tokenizer.from_file(path)
    assert not other.chunked
    assert other.ids(["Some words, and\nmore"])[0].tolist() == library.encode("Some words, and\nmore", add_special_tokens=False).ids


def test_strings_of_added_tokens(spark, library, encoder):
    """As the library has it: the string of an added token is that token."""
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>\u00fcb <|endoftext|><|endoftext|> c", "<|endoftext |>", "plain\ntext"]
    want = [library.encode(t, add_special_tokens=False) for t in texts]
    assert [x.tolist() for x in encoder.ids(texts)] == [e.ids for e in want]
    assert [[tuple(x) for x in s.tolist()] for s in encoder.spans(texts)] == [e.offsets for e in want]
    rows = list(enumerate(texts))
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect())
    assert got == expected(rows, library)


def test_a_worker_keeps_no_chunks_after_its_task(encoder):
    encoder.ids(["some words that are encoded", "and some more"])
    assert encoder._known
    encoder.forget()
    assert not encoder._known and [len(i) for i in encoder.ids(["", "words again"])][0] == 0


def test_memory_of_the_coder():
    blocks = [np.arange(i, i + BLOCK, dtype=np.uint32) % 40_000 for i in range(512)]
    tracemalloc.start()
    payloads = encode_blocks(blocks)
    _, encoding = tracemalloc.get_traced_memory()
    tracemalloc.reset_peak()
    found = decode_blocks(payloads, [BLOCK] * 512)
    _, decoding = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(blocks, found))
    # Bytes for each id of a segment.
    assert max(encoding, decoding) < 20 * 512 * BLOCK


def test_chunks_of_all_lengths(encoder, library, monkeypatch):
    """Around the length that is two numbers, with null bytes, while the table grows and after its longer half is forgotten."""
    import markerloom.llm.tokens as tokens

    monkeypatch.setattr(tokens, "MEMO", 4000)
    encoder.forget()
    rng = np.random.default_rng(3)
    for _ in range(4):
        words = ["".join(rng.choice(list("abc\x00\u00e9."), n)) for n in rng.integers(1, 22, 6000)]
        values = [" ".join(words[i : i + 40]) for i in range(0, 6000, 40)] + ["a", "a\x00", "a\x00\x00", " " * 14, " " * 15, " " * 16, ""]
        want = [e.ids for e in library.encode_batch(values, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.ids(values)] == want
        assert [x.tolist() for x in encoder.ids(values[::-1])] == want[::-1]
    encoder.forget()


def test_known_chunks_cost_little(encoder, library):
    """Less than a tenth of what the library takes for the whole texts."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aeinorst"), n)) for n in rng.integers(2, 11, 3000)]
    values = [" ".join(rng.choice(words, 500)) for _ in range(400)]
    want = [e.ids for e in library.encode_batch(values, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.ids(values)] == want

    def seconds(fn):
        taken = []
        for _ in range(3):
            start = process_time()
            fn()
            taken.append(process_time() - start)
        return min(taken)

    assert seconds(lambda: encoder.ids(values)) < seconds(lambda: library.encode_batch(values, add_special_tokens=False)) / 10


def test_a_word_is_learned_once_whatever_sign_follows(encoder, library):
    encoder.forget()
    words = [" hewhand", " thorest", " 4711", " Blee"]
    values = ["".join(w + sign for w in words) for sign in ("", ",", ".", "!?", ")\n", "'s", "'re-")]
    want = [e.ids for e in library.encode_batch(values, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.ids(values)] == want
    # The words, and the signs with what follows up to a blank.
    assert len(encoder._known) <= len(words) + 12
    encoder.forget()
