"""Spelling variants against brute force, with small tiles, and on edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wayledger.llm import spelling


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], form[w], root, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def found(df):
    return {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("tile", [2048, 3])
def test_equals_brute_force(spark, monkeypatch, tile):
    """Short words over a small alphabet share both halves and lie in groups of many blocks."""
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = np.random.default_rng(tile)
    letters = ["a", "b", "é", "\U0001f600"]
    counts = {"".join(rng.choice(letters, rng.integers(1, 8))): int(rng.integers(1, 60)) for _ in range(400)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(words)) == plain(counts)


def test_long_chain_of_forms(spark):
    counts = {"x" * k: 3 * 2 ** (20 - k) for k in range(5, 20)}
    rows = found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert rows == plain(counts) and rows["x" * 19][2] == "x" * 5


@pytest.mark.parametrize("spoil", [0, 3])
def test_word_counts(spark, spoil):
    texts = [
        (1, "Hello hello HELLO élan Élan ÉLAN naïveté x×y÷z"), (1, "Hello hello HELLO"), (None, "hello日本hello Āhello"), (2, None), (3, ""),
        (4, "longer words, many_words " * 20), (5, "Straße " * 7 + "hellohello"),
    ]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    want = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    got = spelling.word_counts(docs, min_length=4, min_count=2, spoil=spoil, slice_bytes=10, distinct=5)
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 4 and n >= 2}
    assert spelling.variants(spelling.word_counts(docs.where("false"))).count() == 0
