"""Language identification by prediction by partial matching.

Each language has a context tree of bytes up to order 3.  The code length of a byte in a context is -log2(n(byte) / (N + T)) if the
context was followed by that byte, else the escape -log2(T / (N + T)) plus the code length in the context shortened by its first byte
(N: bytes seen after the context, T: different ones); the root escapes to equal shares of all symbols.  A context that a language has
not seen costs nothing and is shortened.  Statistics are frozen after training, so the code length of a text is a sum over its bytes.

The trees are kept sparse: for each language and order the sorted contexts with their escapes, and the sorted pairs of context and byte
with their code lengths.  They are fitted on at most about ``SAMPLE`` documents of each language (those whose hash lies under a
threshold) and keep every context of these, so the model's size follows the sample.  Scoring is one pass over whole texts without a
shuffle; each different four-byte string of a slice of texts is looked up once.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no training rows every text is ``und``; ties go to
the first language by name; the score is the share of the language in 2**-code length over all languages; repeated rows score alike; an
empty table gives an empty result; further columns pass through."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.llm.arrays import plain_strings, text_bytes, text_slices
from wayledger.llm.tables import mapped

SAMPLE = 2000
ORDER = 3


@dataclass
class Level:
    """Contexts of one length of one language: sorted contexts and pairs (context, byte) as numbers, and their code lengths."""

    contexts: np.ndarray
    escapes: np.ndarray
    pairs: np.ndarray
    hits: np.ndarray


@dataclass
class Trees:
    """Languages, number of symbols, and for each language its levels from the root on."""

    langs: list[str]
    symbols: int
    levels: list[list[Level]]

    def gram_lengths(self, lang: int, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four-byte string after the bytes before it, under one language."""
        bits = np.full(len(grams), np.log2(max(self.symbols, 1)))
        for order, level in enumerate(self.levels[lang]):
            pair = grams & ((1 << (8 * order + 8)) - 1)
            context, known = _found(level.contexts, pair >> 8)
            hit, seen = _found(level.pairs, pair)
            bits[known] += level.escapes[context[known]]
            bits[seen] = level.hits[hit[seen]]
        return bits

    def code_lengths(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(starts) - 1, len(self.langs)))
        if not len(raw):
            return out
        grams, place = np.unique(four_grams(raw, starts), return_inverse=True)
        full = np.diff(starts) > 0
        for lang in range(len(self.langs)):
            out[full, lang] = np.add.reduceat(self.gram_lengths(lang, grams)[place], starts[:-1][full])
        return out


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and which keys are there."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def four_grams(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte with the three before it as one number; bytes before a text are 0."""
    wide = raw.astype(np.int64)
    position = np.arange(len(raw)) - np.repeat(starts[:-1], np.diff(starts))
    gram = wide.copy()
    for back in range(1, ORDER + 1):
        before = np.zeros(len(raw), np.int64)
        before[back:] = wide[:-back]
        before[position < back] = 0
        gram |= before << (8 * back)
    return gram


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Trees:
    """Trees from the counts of four-byte strings of each language (``lang`` is an index into ``langs``)."""
    symbols = len(np.unique(np.concatenate([gram & 255, np.zeros(1, np.int64)])))
    levels = []
    for number in range(len(langs)):
        own, times = gram[lang == number], count[lang == number]
        levels.append([_level(own & ((1 << (8 * order + 8)) - 1), times) for order in range(ORDER + 1)])
    return Trees(langs, symbols, levels)


def _level(pair: np.ndarray, count: np.ndarray) -> Level:
    """Code lengths from pairs (context, byte) and how often each occurred."""
    pairs, place = np.unique(pair, return_inverse=True)
    n = np.bincount(place, weights=count, minlength=len(pairs))
    contexts, first, kinds = np.unique(pairs >> 8, return_index=True, return_counts=True)
    total = (np.add.reduceat(n, first) if len(first) else np.zeros(0)) + kinds
    hits = -np.log2(n / np.repeat(total, kinds))
    return Level(contexts, -np.log2(kinds / total), pairs, hits)


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 3) -> Trees:
    """Trees from the texts of ``docs`` (doc_id, text, lang); rows without text or lang are left out."""
    docs = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    totals = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Trees([], 1, [])
    parts = 1 << 20
    limit = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(parts, sample * parts // totals[lang] + 1))]), F.col("lang"))
    number = F.element_at(F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)]), F.col("lang"))
    some = docs.where(F.pmod("h", F.lit(parts)) < limit).select(number.alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang = plain_strings(batch.column(1)), batch.column(0).to_numpy().astype(np.int64)
            for lo, hi in text_slices(text):
                raw, starts = text_bytes(text.slice(lo, hi - lo))
                key = four_grams(raw, starts) | np.repeat(lang[lo:hi], np.diff(starts)) << 32
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    got = mapped(some, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    return build(langs, key >> 32, key & 0xFFFFFFFF, n)


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """All columns of ``docs`` with lang_pred and lang_score (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        names = np.array([*fitted.langs, "und"], object)
        for batch in batches:
            text = plain_strings(batch.column(batch.schema.get_field_index("text")))
            best, share = np.full(len(text), len(fitted.langs)), np.zeros(len(text))
            if fitted.langs:
                bits = [fitted.code_lengths(*text_bytes(text.slice(lo, hi - lo))) for lo, hi in text_slices(text)]
                bits = np.concatenate(bits) if bits else np.zeros((0, len(fitted.langs)))
                odds = np.exp2(bits.min(1, keepdims=True) - bits) if len(bits) else bits
                letters = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False)
                best = np.where(letters, bits.argmin(1), best)
                share = np.where(letters, 1 / odds.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(share, pa.float64())],
                [*batch.schema.names, "lang_pred", "lang_score"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(docs, run, f"{kinds}, lang_pred string, lang_score double")
