"""Phrase mining against a plain count, with small chunks, and on edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayledger.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, code int, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3, "doc_id")


def plain(rows, max_words, min_count, covered=50):
    """{(lang, phrase): (a, l, r, n, score)} by counting."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        small = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", small):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        for p, a in often.items():
            inside = (q for q in often if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * often[q] >= covered * a for q in inside):
                continue
            cuts = [(1000000 * a * a // (counts[p[:c]] * counts[p[c:]]), c) for c in range(1, len(p))]
            score, c = min(cuts)
            out[lang, " ".join(p)] = (a, counts[p[:c]], counts[p[c:]], n[lang], score)
    return out


def found(df):
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize(("chunk", "max_words"), [(1 << 22, 3), (40, 3), (40, 5)])
def test_equals_a_plain_count(spark, chunk, max_words):
    """Also with chunks of 40 places, so that languages and documents change within and between chunks."""
    rng = np.random.default_rng(chunk)
    words = ["a", "B", "c", "Éa", "d\x1c", "ß", "of the", "x\ty", "1"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "?!"]
    rows = []
    for _ in range(60):
        text = "".join(w + e for w, e in zip(rng.choice(words, 30), rng.choice(ends, 30), strict=True))
        rows.append((text, [None, "und", "en", "fr"][rng.integers(4)]))
    rows += [("the same words here " * 50, "en"), (None, "en"), ("", None), (" .\t.", "fr"), rows[0], rows[0]]
    got = phrases.collocations(table(spark, rows), max_words, 5, chunk_words=chunk)
    assert found(got) == plain(rows, max_words, 5)


def test_empty_table_and_scores_beyond_64_bits(spark):
    assert phrases.collocations(table(spark, [("x", "en")]).where("false")).count() == 0
    rows = [("alpha beta. " * 30, "en")]
    assert found(phrases.collocations(table(spark, rows))) == {("en", "alpha beta"): (30, 30, 30, 60, 1000000)}


def test_top_phrases_ties(spark):
    rows = [(" ".join(["q z. a b. a c."] * 10), "en")]
    top = phrases.top_phrases(phrases.collocations(table(spark, rows)), 2).orderBy("rank").collect()
    assert [(r.rank, r.phrase) for r in top] == [(1, "q z"), (2, "a b")]
