"""Exact search against all products, over several shards and blocks, with repeated ids and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayledger.llm import maxscore


def found(spark, rows, is_query, k):
    table = spark.createDataFrame([(i, [int(x) for x in w], 1) for i, w in rows], "id long, w array<long>, shard int").drop("shard")
    got = maxscore.top_k(table, is_query, k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def plain(rows, is_query, k):
    out = []
    for at, (i, w) in enumerate(rows):
        if is_query(i):
            scores = [(-int(np.dot(w[: len(v)], v[: len(w)])), j) for place, (j, v) in enumerate(rows) if place != at]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["dense", "sparse", "large", "negative"])
def test_equals_all_products(spark, monkeypatch, kind):
    """Six shards and several blocks of queries; scores of either sign, sparse lists, products beyond exact doubles, many ties."""
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 200)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(len(kind))
    w = rng.integers(-4, 5, (1200, 24))
    if kind == "sparse":
        w *= rng.random(w.shape) < 0.1
    if kind == "large":
        w = w * (1 << 26)
    if kind == "negative":
        w = np.abs(w) * np.where(np.arange(1200) % 10 == 0, 1, -1)[:, None]
    ids = rng.integers(0, 900, 1200).tolist()  # repeated ids, some with equal vectors
    w[5], ids[5] = w[6], ids[6]
    rows = [(i, v[: 24 - i % 3]) for i, v in zip(ids, w, strict=True)]
    assert found(spark, rows, F.col("id") % 10 == 0, 5) == plain(rows, lambda i: i % 10 == 0, 5)


def test_rows_that_share_an_id(spark):
    rows = [(0, [1, 0]), (1, [-1, 0]), (1, [1, 0]), (2, [5, 0])]
    assert found(spark, rows, F.col("id") == 0, 5) == [(0, 1, 2, 5), (0, 2, 1, 1), (0, 3, 1, -1)]
    assert found(spark, rows[:1], F.col("id") == 0, 5) == []
    assert [r[:3] for r in found(spark, [(7, [1]), (7, [1])], F.col("id") == 7, 5)] == [(7, 1, 7), (7, 1, 7)]
