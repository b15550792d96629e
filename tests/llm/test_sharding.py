"""Rows equal in all columns are spread over the shards as others are."""

from collections import Counter

from wayledger.llm import sharding


def test_repeated_rows_are_spread(spark):
    rows = [(-1, "the same text")] * 800 + [(i, f"text {i}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    out = sharding.shuffle_to_shards(docs, 24).collect()
    assert Counter(r.shard for r in out) == dict.fromkeys(range(24), 100)
    same = Counter(r.shard for r in out if r.doc_id == -1)
    assert len(same) == 24 and max(same.values()) < 60
