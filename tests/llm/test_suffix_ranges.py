"""Ranges of the suffix merge keep their size, whatever the number of contexts and of the texts they are from."""

from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import suffix_dedup


@pytest.mark.parametrize("ranked", [100_000, 60])
def test_no_range_is_over_twice_its_size(spark, monkeypatch, ranked):
    monkeypatch.setattr(suffix_dedup, "RANGE", 200)
    monkeypatch.setattr(suffix_dedup, "PER_RANGE", 20)
    monkeypatch.setattr(suffix_dedup, "RANKED", ranked)
    rng = np.random.default_rng(1)
    # One text holds most contexts: a sample of texts would say nothing of the others.
    sizes = [60_000, *([900] * 40)]
    rows = [(k, "".join(rng.choice(list("abcd"), n))) for k, n in enumerate(sizes)]
    body = spark.createDataFrame(rows, "row_key long, text string")
    contexts = body.select("row_key", "text").mapInArrow(suffix_dedup._anchor_rows("text"), suffix_dedup._ANCHOR)
    contexts = contexts.dropDuplicates(["gram", "context"]).withColumn("many", F.lit(0)).cache()
    n = contexts.count()
    splitters = suffix_dedup.range_splitters(body, contexts, "text", suffix_dedup.GRAM, n)
    assert n > 1000 and splitters == sorted(set(splitters))
    _, whole = suffix_dedup._with_wanted(body, contexts, "text")
    keys = [bytes(r["key"]) for r in whole.select("text", "wanted").mapInArrow(suffix_dedup._keys_of("text", suffix_dedup.GRAM), "key binary").collect()]
    held = Counter(bisect_right(splitters, k) for k in keys)
    assert sum(held.values()) == n and max(held.values()) <= 400, held
    assert len(splitters) + 1 <= 2 * n / 200


def test_few_contexts_are_one_range(spark):
    body = spark.createDataFrame([(1, "x" * 500)], "row_key long, text string")
    none = spark.createDataFrame([], suffix_dedup._ANCHOR + ", many int")
    assert suffix_dedup.range_splitters(body, none, "text", suffix_dedup.GRAM, 0) == []
    assert suffix_dedup.range_splitters(body, none, "text", suffix_dedup.GRAM, suffix_dedup.RANGE) == []
