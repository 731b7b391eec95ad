"""Token counts against the library on whole texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seamline.llm import tokens as T

SF = "/root/testdata/sf0.001"
FILES = {"blanks": "word_bpe_49k.json", "spaces": "byte_bpe_50k.json"}
#: Text whose tokens could reach across a careless cut.
TRICKY = ["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "'s", "'", "re", " ", "  ", "\n", "\t", "\x0b", "\x85", "\xa0", " ", "e", "́", "̸", "=", "가", "ᆨ", "Σ", "ς", "ß", "İ", "ǅ", "7", "x9", "٣", "²", "-", "...", "!?", "漢", "👩‍👩‍👧", "\x00", "don't", "WE'LL", "lower", "Upper"]


@pytest.fixture(scope="module")
def library():
    made = {cut: Tokenizer.from_file(T.vocabulary_path(name)) for cut, name in FILES.items()}
    return lambda cut, text: len(made[cut].encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counters():
    return {cut: T.Counter(T.vocabulary_path(name), cut) for cut, name in FILES.items()}


@pytest.mark.parametrize("cut", FILES)
@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(TRICKY), st.text(max_size=6)), max_size=25), slice_=st.integers(1, 9))
def test_cut_texts_count_as_whole_ones(library, counters, cut, parts, slice_):
    text = "".join(parts)
    before = T.SLICE, T.LONG_PIECE
    T.SLICE, T.LONG_PIECE = slice_, slice_
    try:
        counters[cut].known.clear()
        assert counters[cut]([text.encode(), None, b"", text.encode()]) == [library(cut, text), 0, 0, library(cut, text)]
    finally:
        T.SLICE, T.LONG_PIECE = before


def test_query_equals_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in T.op12_token_counts(spark, SF).collect()}
    want = {k: (len(t.encode()), n, n > 2048) for k, t in texts.items() for n in [library("blanks", t)]}
    assert got == want


def test_long_texts(library):
    r = random.Random(1)
    prose = " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(1, 9))) for _ in range(300_000))
    digits = "".join(r.choices("0123456789abc", k=300_000))
    count = T.Counter(T.vocabulary_path(), "blanks")
    for text in (prose, digits, "ab" * 100_000, " " * 2_500_000, "<|endoftext|>" * 9_000):
        assert count([text.encode()]) == [library("blanks", text)]
    assert max(map(len, T.cut_long(digits.encode()))) < 2 * T.LONG_PIECE


def test_a_few_remembered_pieces_are_enough(library, monkeypatch):
    monkeypatch.setattr(T, "KNOWN_PIECES", 3)
    texts = [f"word{i} and more{i % 7} of it" for i in range(50)]
    assert T.Counter(T.vocabulary_path(), "blanks")([t.encode() for t in texts]) == [library("blanks", t) for t in texts]


def test_batches_are_balanced():
    r = random.Random(2)
    sizes = [sum(map(len, b)) for b in T.balanced([b"x" * r.randint(1, 2_000) for _ in range(5_000)])]
    assert max(sizes) <= T.BATCH and min(sizes[:-1]) > T.BATCH - 2_000


def test_columns_nulls_and_empty_tables(spark, library):
    rows = [(1, "a b", 5, None), (1, "a b", 5, "x"), (2, None, 6, "y"), (3, "", 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, over_limit string")
    got = sorted(map(tuple, T.count_tokens(df, "text", T.vocabulary_path(), limit=1).collect()))
    assert got == [(1, "a b", 3, 2, True), (1, "a b", 3, 2, True), (2, None, 0, 0, False), (3, "", 0, 0, False)]
    assert T.count_tokens(df.limit(0), "text", T.vocabulary_path()).collect() == []
    with pytest.raises(ValueError):
        T.count_tokens(df, "text", T.vocabulary_path(), cut="words")
