"""Context trees against dictionaries, with many languages."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayledger.llm import langid
from wayledger.llm.arrays import text_bytes, plain_strings

import pyarrow as pa


def padded(text):
    return bytes(langid.ORDER) + text.encode()


def train(texts):
    """{order: {context: Counter of bytes}}"""
    tree = {o: {} for o in range(langid.ORDER + 1)}
    for text in texts:
        data = padded(text)
        for i in range(langid.ORDER, len(data)):
            for o in tree:
                tree[o].setdefault(data[i - o : i], Counter())[data[i]] += 1
    return tree


def bits(tree, symbols, text):
    data, total = padded(text), 0.0
    for i in range(langid.ORDER, len(data)):
        for o in range(langid.ORDER, -1, -1):
            seen = tree[o].get(data[i - o : i])
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= np.log2(seen[data[i]] / (n + kinds))
                break
            total -= np.log2(kinds / (n + kinds))
        else:
            total += np.log2(symbols)
    return total


@pytest.mark.parametrize("many", [1, 20])
def test_code_lengths(spark, many):
    """Twenty languages of many different characters: every context of the sample is kept."""
    rng = np.random.default_rng(many)
    alphabet = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100), *range(0x400, 0x480), 0x4E2D, 0x1F600, 32)]
    def text(k):
        letters = [alphabet[i] for i in np.random.default_rng(k).choice(len(alphabet), 40, replace=False)]
        return "".join(rng.choice(letters, rng.integers(0, 200)))
    rows = [(i, text(i % many), f"l{i % many:02}") for i in range(12 * many)]
    trees = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert trees.langs == sorted({lang for _, _, lang in rows})
    plain = {lang: train([t for _, t, own in rows if own == lang]) for lang in trees.langs}
    symbols = len({b for _, t, _ in rows for b in t.encode()} | {0})
    for number, lang in enumerate(trees.langs):
        for order, level in enumerate(trees.levels[number]):
            assert len(level.contexts) == len(plain[lang][order])
            assert len(level.pairs) == sum(map(len, plain[lang][order].values()))
    probes = [t for _, t, _ in rows[:30]] + ["", "zz\0\x01", "中文 😀", "never seen Ω", text(3) + text(5)]
    raw, starts = text_bytes(plain_strings(pa.array(probes)))
    got = trees.code_lengths(raw, starts)
    want = [[bits(plain[lang], symbols, t) for lang in trees.langs] for t in probes]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-9)


def test_ties_and_repeats(spark):
    rows = [(1, "abc abc", "b"), (2, "abc abc", "a"), (2, "abc abc", "a"), (3, "abc abc", "b"), (None, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(docs, langid.fit(docs.where("doc_id < 3").dropDuplicates()))
    assert {(r.lang_pred, round(r.lang_score, 6)) for r in found.collect()} == {("a", 0.5)}
    assert found.select(F.count("*")).first()[0] == 5
