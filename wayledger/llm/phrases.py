"""Phrase collocation mining by relational occurrence joins, length by length.

The occurrence relation R1 lists every word with its piece and place.  It is kept in chunks of about ``CHUNK_WORDS`` words: a chunk is a
sorted stretch of R1, one code for each place, with a gap (-1) at every piece end, and a dictionary of its codes.  Then, for each length:

1. group-count: the dictionaries' counts are summed over all chunks; phrases with ``min_count`` occurrences are frequent.  A chunk sends
   a phrase once, with its count, so a common phrase costs a row a chunk.
2. semi-join: the entries of frequent phrases go back to the chunks that hold them; all other occurrences become gaps.  Count and
   semi-join are one window over the entries of a phrase, so they are shuffled once for both.
3. merge-join: neighbours of the filtered relation, in the same piece and at adjacent places, join to the occurrences of phrases one
   word longer.  As a chunk is sorted and never splits a piece, this is one pass over two neighbouring columns.  The longer relation is
   persisted in the shared folder and taken as the next one; the one before is removed then.

A word's dictionary entry is (language, word), that of a longer phrase the ids of its words.  A word id is one language's, so texts are
shuffled for words only and each language's phrases are separate.

``score`` of a phrase is the least floor(1000000 a a / (l r)) over its cuts into two parts, a, l and r being the occurrences of the
phrase and of the parts, in exact decimals.  A phrase that lies inside a longer frequent one with at least half of its occurrences is
left out.

Defined results: null text is empty, a null language is ``und``; ids are not used, so repeated rows count each for itself; an empty table
gives no phrases; further columns are ignored; a text may be of any length (a piece is never cut, so a chunk is as long as its longest
piece at least)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayledger.llm.tables import mapped, removed, settled, ship

#: Places of a chunk of the occurrence relation.
CHUNK_WORDS = 1 << 22
MAX_WORDS, MIN_COUNT = 3, 10
#: A shorter phrase goes if a longer one has this share of its occurrences, in hundredths.
COVERED_PCT = 50
SCALE = 1_000_000
#: Parts of a language that are ranked by themselves first.
PARTS = 8

#: A chunk is one row with its codes and a row for each dictionary entry.
_CHUNK, _ENTRY = "chunk long, codes binary, code int, ", ", n long"
_WORDS = f"{_CHUNK}lang string, word string{_ENTRY}"


def _ids(k: int) -> list[str]:
    """The columns with the word ids of a phrase of k words."""
    return [f"w{i}" for i in range(1, k + 1)]


def _phrases(k: int) -> str:
    return _CHUNK + ", ".join(f"{w} long" for w in _ids(k)) + _ENTRY


_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
#: Dictionary rows in one Arrow batch.
_BATCH = 1 << 16


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _rows(schema: pa.Schema, chunk: int, codes: np.ndarray | None, n: np.ndarray, **entries: pa.Array) -> Iterator[pa.RecordBatch]:
    """A chunk as rows of its schema; without ``codes`` the dictionary alone."""

    def batch(many: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(many, f.type)) for f in schema], schema=schema)

    if codes is not None:
        yield batch(1, chunk=pa.array([chunk], pa.int64()), codes=pa.array([codes.astype("<i4").tobytes()], pa.binary()))
    whole = {"code": pa.array(np.arange(len(n), dtype=np.int32)), "n": pa.array(n.astype(np.int64))} | entries
    for start in range(0, len(n), _BATCH):
        many = min(_BATCH, len(n) - start)
        yield batch(many, chunk=pa.array(np.full(many, chunk, np.int64)), **{k: v.slice(start, many) for k, v in whole.items()})


def _text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


class _Codes(dict):
    """Code of each word of one language, given out in order of first sight; a piece end has none."""

    def __init__(self, entries: list[bytes]):
        super().__init__({b".": -1})
        self.entries = entries

    def __missing__(self, word: bytes) -> int:
        self.entries.append(word)
        self[word] = code = len(self.entries) - 1
        return code


def occurrences(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """R1 in chunks: words are runs of anything but space and tab within pieces, A to Z made small."""

    schema = _arrow(_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[bytes] = []
        langs: dict[str, _Codes] = {}
        spans: list[tuple[int, str]] = []  # from which code on entries are of a language
        parts: list[np.ndarray] = []
        size = number = 0
        first = TaskContext.get().partitionId() << 33

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal entries, langs, spans, parts, size, number
            codes = np.concatenate(parts)
            starts = [s for s, _ in spans]
            lang = np.repeat(np.array([name for _, name in spans], object), np.diff([*starts, len(entries)]))
            n = np.bincount(codes[codes >= 0], minlength=len(entries))
            yield from _rows(schema, first + number, codes, n, lang=pa.array(lang, pa.string()), word=_text(entries))
            entries, langs, spans, parts, size, number = [], {}, [], [], 0, number + 1

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                lang = "und" if lang is None else lang
                known = langs.get(lang)
                if known is None:
                    known = langs[lang] = _Codes(entries)
                if not spans or spans[-1][1] != lang:
                    spans.append((len(entries), lang))
                for words in _pieces(text.as_py() or "", 4 * chunk_words):
                    codes = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                    parts.append(codes)
                    size += len(codes)
                    if size >= chunk_words:
                        yield from send()
                        known = langs[lang] = _Codes(entries)
                        spans.append((0, lang))
        if parts:
            yield from send()

    text, lang = docs[text_column].cast("string"), docs[lang_column].cast("string")
    return mapped(docs.select(text.alias("text"), lang.alias("lang")), run, _WORDS)


def _pieces(text: str, most: int) -> Iterator[list[bytes]]:
    """The words of a text with a full stop after every piece, in slices of about ``most`` bytes that end with a piece."""
    data = text.encode().lower().translate(_ENDS) + b"."
    start = 0
    while start < len(data):
        stop = data.find(b".", start + most) + 1 or len(data)
        yield data[start:stop].replace(b".", b" . ").split()
        start = stop


def longer(codes: np.ndarray, place: np.ndarray, ids: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Occurrences one word longer, from the codes of a chunk and the codes and word ids of its frequent entries: codes, ids, counts."""
    order = np.argsort(place)
    place, ids = place[order], [w[order] for w in ids]
    most = max(int(place.max(initial=-1)), int(codes.max(initial=-1))) + 1
    new = np.full(most + 1, -1, np.int64)  # the last one is for gaps
    new[place] = np.arange(len(place))
    codes = new[codes]
    left, right = codes[:-1], codes[1:]
    both = np.flatnonzero((left >= 0) & (right >= 0))
    pairs, inverse, n = np.unique(left[both] * len(place) + right[both], return_inverse=True, return_counts=True)
    head, tail = np.divmod(pairs, max(len(place), 1))
    joined = np.full(max(len(codes) - 1, 0), -1, np.int32)
    joined[both] = inverse
    return joined, [*(w[head] for w in ids), ids[-1][tail]], n


def extended(relation: DataFrame, frequent: DataFrame, k: int, last: bool) -> DataFrame:
    """The relation of phrases of k words, from the one before and its frequent entries (chunk, code, word ids); ``last`` leaves out codes."""
    schema, before, after = _arrow(_phrases(k)), _ids(k - 1), _ids(k)

    def run(of: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return schema.empty_table()
        codes = np.frombuffer(left.column("codes")[0].as_buffer(), "<i4")
        codes, ids, n = longer(codes, right.column("code").to_numpy(), [right.column(w).to_numpy() for w in before])
        words = {w: pa.array(x) for w, x in zip(after, ids, strict=True)}
        return pa.Table.from_batches(_rows(schema, of[0].as_py(), None if last else codes, n, **words), schema=schema)

    ship(relation.sparkSession)
    places = relation.where("codes is not null").select(F.col("chunk").alias("part"), "codes")
    return places.groupBy("part").cogroup(frequent.select("chunk", "code", *before).groupBy("chunk")).applyInArrow(run, _phrases(k))


def frequent_phrases(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, **reading
) -> tuple[DataFrame, dict[int, DataFrame], DataFrame]:
    """Of all phrases of up to ``max_words`` words with ``min_count`` occurrences: the words (w1, lang, word, f), the longer ones by their
    number of words (w1, w2, ..., f), ``w1`` and so on being word ids; and (lang, n) of all words."""
    relation = settled(occurrences(docs, **reading), "occurrences")
    entries = relation.where("code is not null")
    sizes = settled(entries.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    words = entries.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    # common words first: small ids, which the shuffles of longer phrases compress well
    words = settled(words.sort(F.desc("f"), "lang", "word").withColumn("w1", F.monotonically_increasing_id()), "words")
    frequent = entries.select("chunk", "code", "lang", "word").join(words.select("lang", "word", "w1"), ["lang", "word"])
    levels = {}
    for k in range(2, max_words + 1):
        before, last, key = relation, k == max_words, _ids(k)
        relation = settled(extended(before, frequent, k, last), "occurrences")
        removed(before)
        entries = relation.where("code is not null")
        if last:  # nothing is made from these occurrences, so their entries are counted alone
            counts = entries.groupBy(*key).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        else:
            f = F.sum("n").over(Window.partitionBy(*key))
            frequent = settled(entries.select("chunk", "code", *key, f.alias("f")).where(F.col("f") >= min_count), "frequent")
            counts = frequent.groupBy(*key).agg(F.max("f").alias("f"))
        levels[k] = settled(counts, "counts")
    removed(relation)
    return words, levels, sizes


def _counts(level: DataFrame, names: list[str], f: str) -> DataFrame:
    """A level's phrases under other names of their words and count."""
    return level.select(*[F.col(w).alias(name) for w, name in zip(_ids(len(names)), names, strict=True)], F.col("f").alias(f))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, covered_pct: int = COVERED_PCT, **reading) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of all phrases of 2 words or more that no longer one covers; ``reading`` goes to ``occurrences``."""
    words, levels, sizes = frequent_phrases(docs, max_words, min_count, **reading)
    whole = None
    for k, level in levels.items():
        key, found = _ids(k), level
        # the most occurrences of a longer phrase around each phrase that some longer one holds
        around = [_counts_within(levels[size], at, k) for size in levels if size > k for at in range(size - k + 1)]
        if around:
            outer = around[0]
            for more in around[1:]:
                outer = outer.unionByName(more)
            outer = outer.groupBy(*key).agg(F.max("outer").alias("outer"))
            covers = 100 * F.col("outer") >= covered_pct * F.col("f")
            found = found.join(outer, key, "left").where(~F.coalesce(covers, F.lit(False))).drop("outer")
        for at, w in enumerate(key):
            own = [F.col("lang")] if at == 0 else []
            own += [F.col("f").alias("left1")] if at == 0 else [F.col("f").alias("right1")] if at == k - 1 else []
            found = found.join(words.select(F.col("w1").alias(w), *own, F.col("word").alias(f"_{w}")), w)
        # parts of a frequent phrase are frequent, so these joins keep every phrase
        for size in range(2, k):
            found = found.join(_counts(levels[size], key[:size], f"left{size}"), key[:size])
            found = found.join(_counts(levels[size], key[k - size :], f"right{size}"), key[k - size :])
        cuts = [
            F.struct(_score(F.col("f"), left, right).alias("score"), F.lit(cut).alias("cut"), left.alias("l"), right.alias("r"))
            for cut in range(1, k)
            for left, right in [(F.col(f"left{cut}"), F.col(f"right{k - cut}"))]
        ]
        least = F.least(*cuts) if k > 2 else cuts[0]
        text = F.concat_ws(" ", *[f"_{w}" for w in key])
        rows = found.select("lang", text.alias("phrase"), F.lit(k).alias("k"), F.col("f").alias("a"), least.alias("least"))
        rows = rows.select("lang", "phrase", "k", "a", "least.l", "least.r", "least.score")
        whole = rows if whole is None else whole.unionByName(rows)
    return whole.join(sizes, "lang").select("lang", "phrase", "k", "a", "l", "r", "n", "score")


def _counts_within(level: DataFrame, at: int, k: int) -> DataFrame:
    """The k words from place ``at`` of each phrase, with the phrase's occurrences."""
    return level.select(*[F.col(f"w{at + i}").alias(f"w{i}") for i in range(1, k + 1)], F.col("f").alias("outer"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE a a / (l r)) in decimals of 38 digits, which hold it for counts below 10**16."""
    whole = "decimal(38,0)"
    over = ((a.cast(whole) * a.cast(whole)).cast(whole) * F.lit(SCALE).cast(whole)).cast(whole)
    under = (left.cast(whole) * right.cast(whole)).cast(whole)
    return F.call_function("div", over, under)


def top_phrases(found: DataFrame, many: int) -> DataFrame:
    """The first ``many`` phrases of each language by score, count and phrase, with ``rank`` from 1.

    A language is cut in ``PARTS`` first, each to its own first ``many``, so what meets in one task does not grow with the language."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = Window.partitionBy("lang", "_part").orderBy(*order)
    first = found.withColumn("_part", part).withColumn("_rank", F.row_number().over(some)).where(F.col("_rank") <= many).drop("_part", "_rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= many)
