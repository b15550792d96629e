"""Held-out stupid backoff against a brute-force version."""

import re
from collections import Counter

import numpy as np
import pytest

from wayledger.llm import lm

WORDS = r"[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+"
FLUENT = ["the cat sat on the mat", "the cat sat on the hat", "the dog sat on the mat", "A dog ran; the cat sat", "the cat sat on the mat"]
TEXTS = [*FLUENT, "zq xv kj wp yy qq", "hat", "the the the the", "", None, " .,! "]


def brute_force(texts, order):
    """Score of each text: n-grams as tuples, counted over all other texts."""
    split = [re.findall(WORDS, (t or "").lower()) for t in texts]

    def grams(words):
        padded = ["<s>"] * order + words
        first = order - 1 if words else len(padded)
        return Counter(tuple(padded[i - size + 1 : i + 1]) for i in range(first, len(padded)) for size in range(1, order + 1))

    out = []
    for own, words in enumerate(split):
        c = sum((grams(w) for i, w in enumerate(split) if i != own), Counter())
        n = max(1, sum(len(w) for i, w in enumerate(split) if i != own))
        padded, score = ["<s>"] * order + words, 0.0
        for i in range(order, len(padded)):
            for size in range(order, 0, -1):
                gram = tuple(padded[i - size + 1 : i + 1])
                if size == 1:
                    score += np.log(max(c[gram], 1) / n)
                elif c[gram]:
                    score += np.log(c[gram] / c[gram[:-1]])
                    break
                else:
                    score += np.log(lm.BACKOFF)
        out.append((len(words), score))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("heavy", [1, 20, 50_000])
def test_held_out_scores(table, monkeypatch, order, heavy):
    monkeypatch.setattr(lm, "HEAVY", heavy)
    got = {r.doc_id: (r.n_tokens, r.score) for r in lm.held_out_backoff(table, order).collect()}
    assert len(got) == len(TEXTS)
    for i, (n, score) in enumerate(brute_force(TEXTS, order)):
        assert got[i][0] == n and got[i][1] == pytest.approx(score, abs=1e-9)


def test_junk_scores_below_fluent_text(table):
    got = {r.doc_id: r.score / r.n_tokens for r in lm.held_out_backoff(table).collect() if r.n_tokens}
    assert all(got[i] > got[5] + 1 for i in range(5))


def test_held_out_edges(table):
    assert lm.held_out_backoff(table.where("false")).count() == 0
    alone = lm.held_out_backoff(table.where("doc_id = 0"), 3).first()
    assert alone.score == pytest.approx(6 * 2 * np.log(lm.BACKOFF))


@pytest.mark.parametrize("heavy", [1, 20, 50_000])
@pytest.mark.parametrize("other", [False, True])
def test_scores_do_not_depend_on_the_passes(table, monkeypatch, heavy, other):
    """Each pass has a share of the keys; together they give what one pass gives, also for another corpus."""
    monkeypatch.setattr(lm, "HEAVY", heavy)
    corpus = table.where("doc_id % 2 = 0").select("text") if other else None
    got = []
    for passes in (1, 2, 5):
        monkeypatch.setattr(lm, "PASSES", passes)
        got.append([(r.doc_id, r.n_tokens, r.score) for r in lm.stupid_backoff(table, corpus).orderBy("doc_id").collect()])
    assert any(score < 0 for _, _, score in got[0])
    for one in got[1:]:
        assert [r[:2] for r in one] == [r[:2] for r in got[0]]
        assert [r[2] for r in one] == pytest.approx([r[2] for r in got[0]], abs=1e-9)


def test_two_passes_shuffle_about_half_of_the_keys_each():
    keys = np.arange(1, 20_001, dtype=np.uint64)
    share = lm.share_of(lm.mix64(keys), lm.PASSES)
    assert lm.PASSES >= 2 and abs(np.bincount(share.astype(int), minlength=lm.PASSES) / len(keys) - 1 / lm.PASSES).max() < 0.02
