"""Stupid-backoff scores of documents under word n-gram models, computed relationally.

``held_out_backoff`` scores each document by all others: counts are those of the table without the document's own, so that rare n-grams
back off.  ``stupid_backoff`` scores by bigrams of a corpus; where that is the documents themselves, each bigram is in the counts and
nothing backs off.  What follows is about ``stupid_backoff``; the other function has its own notes.

S(w | v) = c(v w) / c(v) if the corpus has the bigram, else 0.4 * c(w) / N (or 0.4 / N for a word the corpus lacks), c counting every
occurrence, also at a text's end; a document's score
is the sum of log S over its words, the first following a start marker that counts as a word v once for each document with words.

Counts of words come from one pass with partial sums.  Words and bigrams that make up more than one in ``HEAVY`` of all positions, of
which there are at most ``HEAVY``, are counted first and broadcast; their share of a score is taken where the text is read.  All other
positions become one row for each document and bigram, and are shuffled once, hashed by the first word or, where that is heavy, by the
bigram: then c(v w) and c(v), to which last words of texts add rows of their own, are sums over windows of the same partition, and no key has more than one in ``HEAVY`` of all rows.  A
last sum by document adds up its logarithms.  The keys are dealt into ``PASSES`` shares, worked on one after another: a share's sums are
written and its shuffle files removed before the next share is shuffled, so disk holds one share of the rows at a time.

Where the corpus is another table than the documents, both go through the same shuffle, the corpus with its counts and the documents
with none, and bigrams that the corpus lacks are joined to the word counts.

Defined results: words as in ``arrays``; null texts and texts without words have no tokens and score 0; every row is a document, also if
its id is null or repeated; an empty corpus gives log(0.4) for each word; an empty table gives an empty result; further columns are
ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayledger.llm.arrays import mix64, plain_strings, text_slices, word_hashes
from wayledger.llm.tables import mapped, settled, stored

BACKOFF = 0.4
#: Words and bigrams with more than one in so many positions are broadcast: at most so many of either.
HEAVY = 50_000
#: Shares of the keys, shuffled one after another; the texts are read once for each.
PASSES = 2
START = np.uint64(0x51A27B0C3D4E5F61)
#: Second key of a text's last word, which starts no bigram; other second keys are 0 or odd.
LAST = np.int64(2)
_ODD_TEXT = 0x9E3779B97F4A7C15


def bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second word of each position, and where each text starts (with the end as the last entry)."""
    w, starts = word_hashes(column)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[starts[:-1][np.diff(starts) > 0]] = START
    return v, w, starts


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v * np.uint64(0x9DDFEA08EB382D69) + w)


def share_of(keys: np.ndarray, passes: int) -> np.ndarray:
    """The share of each key, by its high bits."""
    return (keys >> np.uint64(40)) % np.uint64(passes)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def key_counts(corpus: DataFrame, pick) -> DataFrame:
    """(key, n): how often each key that ``pick`` makes of (v, w) occurs in ``corpus`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            text = plain_strings(batch.column(0))
            for lo, hi in text_slices(text):
                held.append(np.unique(pick(*bigrams(text.slice(lo, hi - lo))[:2]), return_counts=True))
                size += len(held[-1][0])
                if size > 1_000_000:
                    yield _merged(held)
                    held, size = [], 0
        if held:
            yield _merged(held)

    return mapped(corpus.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, place, np.concatenate([n for _, n in held]))
    return pa.RecordBatch.from_arrays([_signed(keys), pa.array(counts)], ["key", "n"])


def heavy_table(counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the keys above one in HEAVY positions; there are at most HEAVY of them."""
    got = counts.where(F.col("n") * HEAVY > total).toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column("n").to_numpy()[order]


def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The count of each key, 0 where the table lacks it."""
    if not len(table[0]):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], 0)


def stupid_backoff(docs: DataFrame, corpus: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of each row of ``docs``; ``corpus`` (text) is ``docs`` itself by default."""
    own, passes = corpus is None, PASSES
    source = docs.select(docs[id_column].cast("long").alias("did"), docs[text_column].cast("string").alias("text"))
    source = source.withColumn("rid", F.monotonically_increasing_id())
    corpus = source if own else corpus.select(F.col("text"))

    words = settled(key_counts(corpus, lambda v, w: np.concatenate([w, v[v == START]])), "words")
    start = np.array([START]).view(np.int64)[0].item()
    total = words.where(F.col("key") != start).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy_words = heavy_table(words, total)
    heavy_set = spark_broadcast(docs, heavy_words)

    def both_heavy(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        both = (find(heavy_set.value, v) > 0) & (find(heavy_set.value, w) > 0)
        return bigram_key(v[both], w[both])

    heavy_pairs = heavy_table(settled(key_counts(corpus, both_heavy), "pairs"), total)
    tables = spark_broadcast(docs, (heavy_words, heavy_pairs))

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the heavy words and bigrams give each document."""
        for batch in batches:
            text = plain_strings(batch.column(2))
            for lo, hi in text_slices(text):
                v, w, starts = bigrams(text.slice(lo, hi - lo))
                cv, cp = find(tables.value[0], v), find(tables.value[1], bigram_key(v, w))
                part = np.log(np.maximum(cp, 1)) - np.log(np.where(own | (cp > 0), np.maximum(cv, 1), 1))
                sums = np.concatenate([[0.0], np.cumsum(part)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(starts)), pa.array(sums[starts[1:]] - sums[starts[:-1]])],
                    ["rid", "did", "n_tokens", "part"],
                )

    def postings(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
        """A row for each document and bigram of this share that isn't heavy: pkey decides the partition, skey is 0 where pkey is the bigram."""
        for batch in batches:
            text = plain_strings(batch.column(1))
            rid = batch.column(0).to_numpy()
            for lo, hi in text_slices(text):
                v, w, starts = bigrams(text.slice(lo, hi - lo))
                doc = np.repeat(np.arange(lo, hi), np.diff(starts))
                pair, final = bigram_key(v, w), w
                mine = share_of(np.where(find(tables.value[0], v) > 0, pair, v), passes) == share
                v, w, pair, doc = v[mine], w[mine], pair[mine], doc[mine]
                light = find(tables.value[1], pair) == 0
                v, w, pair, doc = v[light], w[light], pair[light], doc[light]
                order = np.lexsort((pair, doc))
                v, w, pair, doc = v[order], w[order], pair[order], doc[order]
                first = np.ones(len(pair), bool)
                first[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(first)
                times = np.diff(np.append(at, len(pair)))
                heavy = find(tables.value[0], v[at]) > 0
                columns = [_signed(np.where(heavy, pair[at], v[at])), _signed(np.where(heavy, np.uint64(0), w[at] | np.uint64(1)))]
                columns += [pa.array(rid[doc[at]]), pa.array(times.astype(np.int32))]
                names = ["pkey", "skey", "rid", "tf"]
                if own:
                    # the last word of a text starts no bigram but counts towards c(v)
                    ends = np.flatnonzero(np.diff(starts) > 0)
                    last = final[starts[ends + 1] - 1]
                    plain = (find(tables.value[0], last) == 0) & (share_of(last, passes) == share)
                    ends, last = ends[plain], last[plain]
                    extra = [_signed(last), pa.array(np.full(len(last), LAST)), pa.array(rid[lo + ends]), pa.array(np.ones(len(last), np.int32))]
                    columns = [pa.concat_arrays([c, x]) for c, x in zip(columns, extra, strict=True)]
                else:
                    columns += [_signed(v[at]), _signed(w[at])]
                    names += ["v", "w"]
                yield pa.RecordBatch.from_arrays(columns, names)

    shape = "pkey long, skey long, rid long, tf int" + ("" if own else ", v long, w long")
    bases = mapped(source.select("rid", "did", "text"), base, "rid long, did long, n_tokens long, part double")

    def gains(share: int) -> DataFrame:
        """(rid, light): what the bigrams of this share give each document."""
        of_share = partial(postings, share=share)
        rows, count = mapped(source.select("rid", "text"), of_share, shape), F.col("tf")
        if not own:
            given = mapped(corpus.select(F.lit(-1).cast("long").alias("rid"), "text"), of_share, shape)
            rows, count = rows.unionByName(given), F.when(F.col("rid") == -1, F.col("tf")).otherwise(0)
        first = F.sum(count).over(Window.partitionBy("pkey"))
        pair = F.sum(count).over(Window.partitionBy("pkey", "skey"))
        counted = rows.withColumns({"cv": first, "cp": pair})
        log_v = F.when(F.col("skey") == 0, 0.0).otherwise(F.log("cv"))
        if own:
            gain = F.when(F.col("skey") == int(LAST), 0.0).otherwise(F.col("tf") * (F.log("cp") - log_v))
            return counted.groupBy("rid").agg(F.sum(gain).alias("light"))
        # the heavy first word's count is looked up again, as it counts only where the bigram is in the corpus
        hits = counted.where("rid <> -1 and cp > 0").join(words.select(F.col("key").alias("v"), F.col("n").alias("nv")), "v")
        hits = hits.select("rid", (F.col("tf") * (F.log("cp") - F.log("nv"))).alias("gain"))
        lost = counted.where("rid <> -1 and cp = 0").select("rid", "tf", F.col("w").alias("key")).join(words, "key", "left")
        lost = lost.select("rid", (F.col("tf") * F.log(BACKOFF * F.coalesce("n", F.lit(1)) / F.lit(max(total, 1)))).alias("gain"))
        return hits.unionByName(lost).groupBy("rid").agg(F.sum("gain").alias("light"))

    shares = [settled(gains(share), "gains") for share in range(passes)]
    sums = reduce(DataFrame.unionByName, shares).groupBy("rid").agg(F.sum("light").alias("light"))
    return bases.join(sums, "rid", "left").select(
        F.col("did").alias("doc_id"), "n_tokens", (F.col("part") + F.coalesce("light", F.lit(0.0))).alias("score")
    )


def padded_grams(column: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For each text with words a place for its start marker, then one for each word: the text's number, the keys of the n-grams of
    length 1 to ``order`` that end there, with start markers before the first word, and whether the place is the start marker's."""
    words, starts = word_hashes(column)
    counts = np.diff(starts)
    texts = np.flatnonzero(counts)
    room = counts[texts] + order
    ends = np.cumsum(room)
    doc = np.repeat(texts, room)
    at = np.arange(len(doc)) - np.repeat(ends - room, room)
    token = np.full(len(doc), START)
    token[at >= order] = words
    keep = at >= order - 1
    grams = [mix64(token)]
    for size in range(2, order + 1):
        # of places before the markers' last, which are not kept, the first ones wrap around
        grams.append(mix64(np.roll(token, size - 1) * np.uint64(0x9DDFEA08EB382D69) + grams[-1] + np.uint64(size)))
    return doc[keep], [g[keep] for g in grams], at[keep] == order - 1


def within_text(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each place's key occurs in its own text."""
    _, place, times = np.unique(mix64(keys + doc.astype(np.uint64) * np.uint64(_ODD_TEXT)), return_inverse=True, return_counts=True)
    return times[place]


def held_out_backoff(docs: DataFrame, order: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of each row of ``docs`` under the n-grams up to ``order`` of all other rows.

    S(w | context) = c(context w) / c(context) if another row has the n-gram, else 0.4 * S(w | context without its first word); of a
    single word c(w) / N, and 1 / N for a word that no other row has.  N counts the words of all other rows, at least 1.  Before the
    first word stand ``order`` - 1 start markers, which as a context count once for each row with words.  Contexts count every
    occurrence, also at a text's end.  Copies of a row are other rows.

    N-grams that make up more than one in ``HEAVY`` of all positions are counted first, by rising length, and broadcast.  Of the others
    a row for each document and n-gram is shuffled by n-gram; a window sums them, and those that another document has go back to their
    documents, which are read again and scored in place.  No key has more than one in ``HEAVY`` of all rows."""
    source = docs.select(docs[id_column].cast("long").alias("did"), docs[text_column].cast("string").alias("text"))
    source = stored(source.withColumn("rid", F.monotonically_increasing_id()), "texts")

    def slices(column: pa.Array | pa.ChunkedArray):
        text = plain_strings(column)
        for lo, hi in text_slices(text):
            yield lo, hi, *padded_grams(text.slice(lo, hi - lo), order)

    def counts(heavy, size: int) -> DataFrame:
        """(key, n) of the n-grams of this length whose two shorter parts are both heavy."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, many = [], 0
            for batch in batches:
                for _, _, _, grams, marker in slices(batch.column(0)):
                    keys = grams[size - 1]
                    if size > 1:
                        known = find(heavy.value[size - 2], grams[size - 2]) > 0
                        keys = keys[known & (marker | np.roll(known, 1))]
                    held.append(np.unique(keys, return_counts=True))
                    many += len(held[-1][0])
                    if many > 1_000_000:
                        yield _merged(held)
                        held, many = [], 0
            if held:
                yield _merged(held)

        return mapped(source.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))

    words = settled(counts(None, 1), "words")
    start = mix64(np.array([START])).view(np.int64)[0].item()
    total = words.where(F.col("key") != start).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tables = [heavy_table(words, total)]
    for size in range(2, order + 1):
        tables.append(heavy_table(counts(spark_broadcast(docs, tables), size), total))
    heavy = spark_broadcast(docs, tables)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document and n-gram that isn't heavy."""
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for lo, _, doc, grams, _ in slices(batch.column(1)):
                for keys, table in zip(grams, heavy.value, strict=True):
                    light = find(table, keys) == 0
                    key, text = keys[light], doc[light]
                    by = np.lexsort((key, text))
                    key, text = key[by], text[by]
                    first = np.ones(len(key), bool)
                    first[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                    at = np.flatnonzero(first)
                    times = np.diff(np.append(at, len(key))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([_signed(key[at]), pa.array(rid[lo + text[at]]), pa.array(times)], ["key", "rid", "tf"])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, doc, grams, marker in slices(batch.column(1)):
                found = batch.column(2).slice(lo, hi - lo).flatten()
                keys, first = np.unique(found.field(0).to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
                light = keys, found.field(1).to_numpy(zero_copy_only=False)[first]
                n_tokens = np.bincount(doc[~marker], minlength=hi - lo)
                rest = [np.maximum(find(light, g), find(h, g)) - within_text(doc, g) for g, h in zip(grams, heavy.value, strict=True)]
                gain = np.log(np.maximum(rest[0], 1)) - np.log(np.maximum(total - n_tokens[doc], 1)) + (order - 1) * np.log(BACKOFF)
                for size in range(2, order + 1):
                    count, context = rest[size - 1], np.roll(rest[size - 2], 1)
                    longer = np.log(np.maximum(count, 1)) - np.log(np.maximum(context, 1)) + (order - size) * np.log(BACKOFF)
                    gain = np.where(count > 0, longer, gain)
                sums = np.bincount(doc[~marker], weights=gain[~marker], minlength=hi - lo)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n_tokens.astype(np.int64)), pa.array(sums.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "score"])

    rows = mapped(source.select("rid", "text"), postings, "key long, rid long, tf int")
    others = rows.withColumn("n", F.sum("tf").over(Window.partitionBy("key"))).where("n > tf")
    known = others.groupBy("rid").agg(F.collect_list(F.struct("key", "n")).alias("known"))
    whole = source.join(known, "rid", "left").select("did", "text", "known")
    return mapped(whole, scores, "doc_id long, n_tokens long, score double")


def spark_broadcast(df: DataFrame, value: object):
    return df.sparkSession.sparkContext.broadcast(value)
