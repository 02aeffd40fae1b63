import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazeloom.llm import tokens

pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def counter():
    return tokens.TokenCounter(tokens.VOCABULARY)


@given(st.lists(st.text(alphabet="ab'strevldm \n\t\x0b\x1c0.1-\"éß A", max_size=30), max_size=6))
@settings(max_examples=300, deadline=None)
def test_counts_are_the_tokenizers(texts):
    counter = tokens._counter(tokens.VOCABULARY)
    assert counter(texts).tolist() == [len(counter.encoding.encode_ordinary(t)) for t in texts]


def test_stretches_and_long_texts(counter, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choice("it's we'll  go\n 12") for _ in range(rng.choice((0, 3, 40, 200)))) for _ in range(60)] + ["=" * 3000, " " * 999, "word " * 40_000]
    assert counter(texts).tolist() == [len(counter.encoding.encode_ordinary(t)) for t in texts]


def test_column(spark):
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "id int, text string")
    assert {r.id: r.n for r in df.select("id", tokens.token_counts(F.col("text")).alias("n")).collect()} == {1: 2, 2: None, 3: 0}
