"""Recall of the pivot index on planted pairs and groups."""

import numpy as np
import pytest

from wayledger.llm import pivots

WIDTH = 64


def planted(rng, n, group, cosine):
    """n vectors of which the first ``group`` have about this cosine with each other, the others none."""
    x = rng.standard_normal((n, WIDTH))
    centre = rng.standard_normal(WIDTH)
    centre *= WIDTH**0.5 / np.linalg.norm(centre)
    x[:group] = centre * cosine**0.5 + x[:group] * (1 - cosine) ** 0.5
    return x


def links_of(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(table).collect()}


def expected(x):
    u = pivots.unit(x)
    return (u @ u.T >= pivots.THRESHOLD).sum(1) - 1


@pytest.mark.parametrize("n", [2000, 6000])
def test_group_of_a_third_of_the_rows(spark, monkeypatch, n):
    monkeypatch.setattr(pivots, "ALL_PAIRS", 0)
    x = planted(np.random.default_rng(n), n, n // 3, 0.92)
    got, want = links_of(spark, x), expected(x)
    found = np.array([got[i][0] for i in range(n)])
    assert want.sum() > n * n // 20 and (found <= want).all()
    assert found.sum() >= 0.95 * want.sum()


def linked_pairs(rng, n, cosine):
    """Two matrices whose rows have this cosine pair by pair."""
    a, b = pivots.unit(rng.standard_normal((n, WIDTH))), rng.standard_normal((n, WIDTH))
    b = pivots.unit(b - (a * b).sum(1, keepdims=True) * a)
    return a, cosine * a + (1 - cosine**2) ** 0.5 * b


def test_table_without_index_is_exact(spark):
    rng = np.random.default_rng(3)
    sides = [linked_pairs(rng, 2000, c) for c in (0.9005, 0.91, 0.93, 0.95)]
    x = np.concatenate([side for pair in sides for side in pair])
    got, want = links_of(spark, x), expected(x)
    assert want.sum() >= 16000
    assert [got[i][0] for i in range(len(x))] == want.tolist()


def recall(rng, rows, cosine):
    """Share of pairs with this cosine that the index compares in a table of so many isotropic vectors; pivots depend on the count alone."""
    want = pivots.pivot_count(rows)
    reference = pivots.unit(pivots.spread_apart(rng.standard_normal((pivots.CANDIDATES * want, WIDTH)), want))
    prefix = pivots.prefix_length(len(reference))
    a, b = (np.argpartition(-(x @ reference.T), prefix - 1, axis=1)[:, :prefix] for x in linked_pairs(rng, 4000, cosine))
    return ((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= pivots.SHARED).mean()


@pytest.mark.parametrize("rows", [20_000, 200_000, 1_000_000, 4_200_000])
def test_recall_holds_as_the_table_grows(monkeypatch, rows):
    monkeypatch.setattr(pivots, "ALL_PAIRS", 0)
    assert recall(np.random.default_rng(rows), rows, 0.9) > 0.97


def test_index_finds_planted_pairs(spark, monkeypatch):
    monkeypatch.setattr(pivots, "ALL_PAIRS", 0)
    rng = np.random.default_rng(4)
    x = np.concatenate([*linked_pairs(rng, 1500, 0.905), *linked_pairs(rng, 1500, 0.95)])
    got, want = links_of(spark, x), expected(x)
    found = np.array([got[i][0] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()


@pytest.mark.parametrize("rows", [2, 500, 51_282, 131_072, 131_073, 4_200_000])
def test_no_size_goes_without_the_index(rows):
    assert pivots.pivot_count(rows) >= pivots.LEAST_PIVOTS


@pytest.mark.parametrize("rows", [16_000, 1_000_000])
def test_few_pairs_at_the_threshold_are_missed(rows):
    assert recall(np.random.default_rng(rows), rows, 0.9) > 0.998
