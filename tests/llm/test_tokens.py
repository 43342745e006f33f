"""Counts by pieces against the tokenizer on whole texts."""

import random

from pyspark.sql import functions as F

from tidewheel.llm.tokens import Counter, default_vocabulary, encoding, token_count


def test_pieces_add_up():
    path = default_vocabulary()
    whole, c, rnd = encoding(path).encode_ordinary, Counter(path), random.Random(0)
    for _ in range(300):
        t = "".join(rnd.choice(["a", "word ", "\n", "\n\n", " \n ", "\t", "12", "…", "日本", "é", "'s", "  ", "\r\n", "{{x}}", "<|endoftext|>"]) for _ in range(rnd.randrange(0, 40)))
        assert c.count(t) == len(whole(t)), repr(t)
    assert c.count(None) == 0 and c.count("") == 0
    long = "lorem ipsum\n" * 50_000
    assert c.count(long) == len(whole(long))


def test_column(spark):
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "id int, text string")
    assert {r.id: r.n for r in df.select("id", token_count(F.col("text")).alias("n")).collect()} == {1: 2, 2: 0, 3: 0}
