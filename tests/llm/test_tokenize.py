"""Encoding against another library's encoder of the same vocabulary, and exact round trips."""

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tamarack.llm.tokenize import PATTERN, VOCABULARY, Encoder, byte_letters, decode_corpus, encode_corpus, sentencepiece_model

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def own():
    return Encoder(sentencepiece_model())


@pytest.fixture(scope="module")
def other():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["Hello  world\n\n  x", "<|endoftext|> <unk> </s>", "数控刀具 ½ kg — naïve café", "👩‍🔧​﻿\xa0", "a" * 3000, " " * 500 + "x", "it's we'll I'd 123456", "\r\n\t \x00\x07"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_round_trip(own, other, text):
    (ids,) = own.encode([text])
    assert ids == other.encode_ordinary(text) and own.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text(own, other, text):
    (ids,) = own.encode([text])
    assert ids == other.encode_ordinary(text) and own.decode(ids) == text


def test_letters_are_one_to_one():
    assert len(set(byte_letters().values())) == 256


def test_corpus(spark, other):
    rows = [(1, None, [9]), (2, "", [9]), (3, "two words", [9]), (3, "two words", [9]), (None, "x", None), (4, "long text " * 20_000, [9])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = [(r["doc_id"], r["ids"]) for r in encode_corpus(df, doc_id="doc_id", text="text").collect()]
    assert got == [(i, other.encode_ordinary(t) if t else []) for i, t, _ in rows]
    assert encode_corpus(df.limit(0), doc_id="doc_id", text="text").count() == 0


def test_decoding_is_the_inverse(spark):
    rows = [(1, "Grüße, 漢字 \U0001f600 <|endoftext|>\r\n\t x"), (2, ""), (3, None), (4, "a" * 50_000), (4, "a" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = decode_corpus(encode_corpus(df, doc_id="doc_id", text="text"), doc_id="doc_id", ids="ids").collect()
    assert sorted(map(tuple, got)) == sorted((i, t or "") for i, t in rows)
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in decode_corpus(none, doc_id="doc_id", ids="ids").collect()] == [(1, "")]
    assert decode_corpus(none.limit(0), doc_id="doc_id", ids="ids").count() == 0
