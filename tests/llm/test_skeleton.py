import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from frameloom.llm import skeleton as K


@pytest.fixture(scope="module", autouse=True)
def alike(spark):
    """The table, also for the tests that draw texts."""
    global LIKE
    LIKE = K.look_alikes(spark)
    return LIKE


SAME = [
    ("Hello fish", "Ｈｅｌｌｏ　ﬁsh"), ("café", "café"), ("pea", "реа"), ("No", "Νο"), ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"), ("ab", "﻿ab"), ("ab", "a­b"),
    ("K", "K"), ("a\nb", "a\r\nb"), ("q̣̇", "q̣̇"), ("it's", "it＇s"), ("SIJ", "ЅІЈ"), ("x-y", "x‐y"), ("2", "２"), ("a", "α"), ("y", "γ"), ("u", "υ"), ("g", "ɡ"), ("a", "ɑ"), ("o", "ᴏ"), ("s", "ꜱ"), ("D", "Ꭰ"), ("T", "Ꭲ"), ("O", "Ⲟ"), ("a:b", "a∶b"), ("1/2", "1⁄2"), ("1/2", "1∕2"), ("C", "Ϲ"), ("l", "ӏ"), ("I", "Ι"), ('"a"', "“a”"), ("⠀a", " a"),
]
DIFFERENT = [("Hello", "hello"), ("cafe", "café"), ("l", "I"), ("l", "1"), ("O", "0"), ("rn", "m"), ("a b", "ab"), ("a b", "a\nb"), ("ш", "w"), ("й", "и"), ("'", '"'), ("`", "'"), ("a", "aa")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert LIKE.skeleton(a) == LIKE.skeleton(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert LIKE.skeleton(a) != LIKE.skeleton(b)


def test_printable_ascii_stays_and_is_never_merged():
    plain = [chr(c) for c in range(0x20, 0x7F)]
    assert [LIKE.skeleton(c) for c in plain] == plain


@given(st.text(max_size=40))
def test_equals_the_definition_and_is_stable(text):
    """Character by character until nothing changes, marks in canonical order at the end."""
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    while (after := "".join(map(LIKE._step, plain))) != plain:
        plain = after
    once = unicodedata.normalize("NFKD", plain)
    assert LIKE.skeleton(text) == once and LIKE.skeleton(once) == once


def test_the_table_is_the_public_data_and_every_entry_reaches_its_prototype():
    assert len(LIKE.table) > 4000
    assert [c for c, p in LIKE.table.items() if LIKE.skeleton(c) != LIKE.skeleton(p)] == []
    assert {c for c in LIKE.table if c.isascii()} == set() and len({LIKE.skeleton(c) for c in map(chr, range(0x20, 0x7F))}) == 95


def test_workers_get_the_same_table():
    import pickle

    again = pickle.loads(pickle.dumps(LIKE))
    assert again.table == LIKE.table and again.skeleton("реа") == "pea"


def test_pairs_equal_brute_force(spark):
    texts = ["", None, " ", "​", "​​", "\n"] + [t for pair in SAME + DIFFERENT for t in pair] + ["Hello fish", "café", "café", "Hello fish"]
    docs = [(i, t, "x") for i, t in enumerate(texts)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, form string")
    want = {(a, b) for a, s, _ in docs for b, t, _ in docs if a < b and s and t and s != t and LIKE.skeleton(s).strip() and LIKE.skeleton(s) == LIKE.skeleton(t)}
    assert {tuple(r) for r in K.look_alike_pairs(table).collect()} == want
    members = {r.doc_id for r in K.look_alike_classes(table).collect()}
    assert members == {d for pair in want for d in pair}


def test_hot_copies_cost_no_pairs(spark):
    rows = [(i, "same text", None) for i in range(2000)] + [(5000, "same text", None)]
    assert K.look_alike_pairs(spark.createDataFrame(rows, "doc_id bigint, text string, own string")).count() == 2000


def test_empty_and_long(spark):
    assert K.look_alike_pairs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    long = "long text é " * 100_000
    assert LIKE.skeleton(long) == unicodedata.normalize("NFKD", long)
