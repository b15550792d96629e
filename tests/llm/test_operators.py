"""The ten operators and the pipeline on edge cases, against SQL and against brute force."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayledger.llm import chat, jaccard, langid, lm, maxscore, mixing, packing, pivots, quality, sharding
from wayledger.llm.queries import ORACLE, QUERIES, tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, size long"
LONG = "one two three four five six seven eight nine ten " * 3000
EDGES = [
    (1, "the quick brown fox jumps over the lazy dog today", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog today", "en", "a"),
    (2, None, None, None),
    (3, "", "de", "a"),
    (None, "a text without an id", "en", None),
    (4, LONG, "en", "b"),
    (5, " .,! ", "fr", "b"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, lang, s, 7, "x", 1) for i, t, lang, s in EDGES], DOCS)


@pytest.fixture(scope="module")
def none(edges):
    return edges.where("false")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, small, name):
    got = QUERIES[name](spark, small)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    names, columns = [c[0] for c in want.description], sorted(got.columns)
    assert sorted(names) == columns
    found = sorted(str([r[c] for c in columns]) for r in got.collect())
    assert found == sorted(str([dict(zip(names, r, strict=True))[c] for c in columns]) for r in want.fetchall())


def test_packing_whole_and_gapless(spark, edges, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    rows = packing.pack(edges, tokenizer_file(), window=64).collect()
    assert packing.pack(none, tokenizer_file()).count() == 0
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in EDGES)
    assert sum(r.length for r in rows) == want
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.start)])
    assert ids.tolist() == [*library.encode(LONG, add_special_tokens=False).ids, 2]


def test_packing_is_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        places = [0, *np.cumsum(rng.integers(1, 5, 12)).tolist()]
        costs = rng.integers(0, 4, 13).astype(float).tolist()
        best = [0.0] + [float("inf")] * 12
        for j in range(1, 13):
            best[j] = min(best[i] + 8 - (places[j] - places[i]) + costs[j] for i in range(j) if places[j] - places[i] <= 8)
        cuts = [0, *packing.best_cuts(places, costs, 8)]
        assert sum(8 - (places[j] - places[i]) + costs[j] for i, j in zip(cuts, cuts[1:], strict=False)) == best[-1]


def test_sharding(spark, edges, none):
    out = sharding.shuffle_to_shards(edges, 3).collect()
    assert len(out) == len(EDGES) and sharding.shuffle_to_shards(none, 3).count() == 0
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert sorted(len(s) for s in slots.values()) == [2, 2, 3]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_hypergeometric_draws(spark):
    x = np.array([r.x for r in sharding.draw_test(spark, 1000, 300, 200, 20000, 1).collect()])
    assert abs(x.mean() - 60) < 0.3 and abs(x.var() - 200 * 0.3 * 0.7 * 800 / 999) < 2


def test_jaccard_edges(edges, none):
    rows = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in jaccard.jaccard_join(edges).collect())
    assert [r[2] for r in rows if r[0] == 1] == [1, 1] and [r[2] for r in rows if r[0] != 1] == [0] * 5
    assert jaccard.jaccard_join(none).count() == 0


def test_vectors(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 0.0]), (4, None), (5, [1.0, nan]), (6, [1.0, None]), (7, [1.0, 0.0]), (None, [0.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, size string")
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(table).collect()}
    assert rows[1] == (2, 1, True) and rows[2] == (2, 1, False) and rows[7] == (2, 1, False) and rows[5] == (0, 5, True) and rows[3][0] == 0
    found = maxscore.top_k(maxscore.scaled(table, "vec_id", "embedding"), F.col("id") == 1, 2).collect()
    assert [(r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(1, 2), (2, 7)]
    empty = table.where("false")
    assert pivots.near_duplicates(empty).count() == 0
    assert maxscore.top_k(maxscore.scaled(empty, "vec_id", "embedding"), F.col("id") == 1).count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo <|im_end|>"), (3, 0, None, None), (None, 0, "user", "x")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long")
    out = {r.conv_id: r.text for r in chat.render(table).collect()}
    assert set(out) == {2, 3} and "< |im_end|>" in out[2]
    assert chat.render(table.where("false")).count() == 0


def test_classifiers_edges(spark, edges, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1)], "doc_id long, label int")
    model = quality.fit(edges, labels)
    assert quality.score(edges, model).count() == len(EDGES) and quality.score(none, model).count() == 0
    assert {r.quality_score for r in quality.score(edges, quality.fit(none, labels)).collect()} == {0.5}
    found = {r.doc_id: r.lang_pred for r in langid.predict(edges, langid.fit(edges)).collect()}
    assert found[2] == found[3] == found[5] == "und" and found[4] == "en"
    assert {r.lang_pred for r in langid.predict(edges, langid.fit(none)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    seen = QUERIES["op8_langid"](spark, sf).join(docs, "doc_id").where("held_out and n > 20").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert seen > 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    right = QUERIES["op5_quality"](spark, sf).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.9


def test_mixing_and_scores_edges(edges, none):
    weights = mixing.tempered_weights(mixing.source_sizes(edges), 0.5)
    copies = mixing.mix(edges, weights).collect()
    counts = defaultdict(set)
    for r in copies:
        counts[(r.doc_id, zlib.crc32((r.text or "").encode()))].add(r.n_copies)
    assert all(len(c) == 1 for c in counts.values()) and mixing.mix(none, weights).count() == 0
    scored = lm.stupid_backoff(edges).collect()
    assert len(scored) == len(EDGES) and {r.score for r in scored if r.n_tokens == 0} == {0.0}
    assert lm.stupid_backoff(none).count() == 0
    lost = lm.stupid_backoff(edges, none.select("text")).where("doc_id = 5 or doc_id = 1").collect()
    assert all(abs(r.score - r.n_tokens * np.log(0.4)) < 1e-6 for r in lost)


def test_pipeline(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
