import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import tokens as T


def whole(text):
    return T.encoding(T.RANK_FILE).encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n\r\x0b\x1c\x1f\x85\xa0  ,.:'-sdtrvel019½²é語abcLl​"), max_size=60))
def test_parts_give_the_ids_of_the_whole(text):
    assert T.encode(text).tolist() == whole(text)
    assert "".join(T.parts(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_and_round_trip(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    ids = T.encode(text)
    assert ids.tolist() == whole(text) and T.decode_bytes(ids) == text.encode()


def test_contractions_numbers_and_time_lines():
    for text in ("it's we'll I'd 'stop' x's9't", "1\n00:01:02,345 --> 00:01:05,678\nHi,9 a1b2,3", "<|endoftext|> x", "a" * 3000 + "1" * 3000, " " * 5000 + "x" + "\n" * 5000):
        assert T.encode(text).tolist() == whole(text)


def test_other_library_agrees():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(T.RANK_FILE.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for text in ("Hello, wörld!\r\n 12", "été  ٣٤ 語", "it's 5 o'clock\n\n\n"):
        assert T.encode(text).tolist() == other.encode(text, add_special_tokens=False).ids


def test_every_document_has_a_row(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["word", "9,5", "naïve", "語"]) for _ in range(60_000))
    rows = [(1, "Hello there", "a"), (2, None, "b"), (3, "", "c"), (4, "Hello there", "d"), (5, long, "e"), (5, "x", "again")]
    got = T.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"))
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    kept = sorted((r.doc_id, len(r.ids)) for r in got.collect())
    assert kept == sorted((d, len(whole(t)) if t else 0) for d, t, _ in rows)
    raw = {(r.doc_id, bytes(r.raw)) for r in T.decoded(got).collect()}
    assert raw == {(d, (t or "").encode()) for d, t, _ in rows}
    assert T.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
