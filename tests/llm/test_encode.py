"""Token encoding: equal to the library's own, whatever the cuts, and an exact round trip."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydroframe.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.RANKS_FILE), reason="no vocabulary file")
TEXT = "The probe's reading wasn't 12.5 mg/l; $x_{10}$ we'll see…\n\n  \t 雨季期间溶解氧, <|endoftext|> naïve 'll 's "


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(encode, "LEAF", 7)
    monkeypatch.setattr(encode, "WINDOW", 2)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(TEXT)), st.characters(codec="utf-8")), max_size=120))
def test_tree_equals_whole(text):
    m = encode.monoid()
    leaf, window = encode.LEAF, encode.WINDOW
    encode.LEAF, encode.WINDOW = 7, 2
    try:
        ids = m.encode(text).tolist()
    finally:
        encode.LEAF, encode.WINDOW = leaf, window
    assert ids == m.encoding.encode_ordinary(text)
    assert m.decode(ids) == text


def test_joins_in_any_order(small):
    m = encode.monoid()
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(TEXT) for _ in range(40))
        a, b = sorted(rng.sample(range(41), 2))
        x, y, z = text[:a], text[a:b], text[b:]
        left = m.join(x + y, m.join(x, m.leaf(x), y, m.leaf(y)), z, m.leaf(z)).tolist()
        right = m.join(x, m.leaf(x), y + z, m.join(y, m.leaf(y), z, m.leaf(z))).tolist()
        assert left == right == m.leaf(text).tolist()


def test_corpus(spark):
    long = "word " * 40_000 + "x" * 20_000 + "雨季" * 5_000
    rows = [(1, None), (2, ""), (3, " \n "), (4, TEXT), (5, long), (5, long), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("ids"), F.lit(1).alias("TEXT"))
    got = [(r.doc_id, r.ids) for r in encode.encode_corpus(df).collect()]
    by = dict(got)
    m = encode.monoid()
    assert len(got) == 7 and by[1] == [] and by[2] == [] and by[3] == m.encoding.encode_ordinary(" \n ") and by[4] == m.encoding.encode_ordinary(TEXT) and by[5] == m.encoding.encode_ordinary(long)
    assert encode.encode_corpus(df.where("false")).collect() == []
