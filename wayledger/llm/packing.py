"""Packing documents into fixed windows of tokens by order-preserving dynamic programming.

The token stream of a partition is its documents in stored order, each followed by an end token.  Windows are consecutive stretches of
at most ``window`` tokens.  Ending a window costs nothing at a document end, ``sentence_cost`` at a sentence end and ``cut_cost``
inside a sentence; every unused place costs 1.  The cheapest set of cuts is found by dynamic programming: for a window from cut i to
cut j the padding is window - (p[j] - p[i]), so the best predecessor of j is the one with the least cost[i] + p[i] among the cuts at
most ``window`` tokens back, which a monotone queue yields in amortised constant time.  Inside a sentence longer than ``grid`` tokens
a cut is allowed every ``grid`` tokens, so that a solution always exists and a window is never left almost empty.

No row leaves its partition: packing is one pass without a shuffle.  The stream is solved in stretches of ``STRETCH`` tokens; the last
windows of a stretch are left open and solved again with the next one, so only the last window of a partition is filled poorly.

Defined results: null text is empty, a document is at least its end token; rows with null or repeated ids are packed like others;
an empty table gives no pieces; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wayledger.llm.tables import mapped

WINDOW = 4096
END_ID = 2
#: Tokens solved at once: bounds the memory of a task.
STRETCH = 1 << 20
#: Windows at the end of a stretch that are solved again with the next.
OPEN = 8
#: Distinct words whose ids a task keeps.
WORD_CACHE = 400_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: Characters for which splitting into words is known to equal the tokenizer's: printable characters of Latin scripts. Their
#: canonical composition is themselves; U+0130 is left out, its lower case is two characters.
_SAFE = {c for c in map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)]) if c != "İ"}


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in sorted(_SAFE) if unicodedata.category(c)[0] == kind)


class WordTokenizer:
    """Ids of texts under a word-end BPE file of the ``tokenizers`` library, equal to its own ``encode``.

    Such a tokenizer lower-cases, splits into words and encodes each word by itself, so each distinct word is encoded once by the
    library and looked up afterwards.  Texts with characters beyond Latin scripts, or that hold a special token, go whole through
    the library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        letter, number = _class("L"), _class("N")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+").findall
        self.other = re.compile("[^" + "".join(re.escape(c) for c in sorted(_SAFE)) + "]").search
        vocabulary = self.library.get_vocab()
        self.word_end = np.zeros(self.library.get_vocab_size(), bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        ends = {i for t, i in vocabulary.items() if re.fullmatch(r"[^\w\s]*[.!?][^\w\s]*", t.removesuffix("</w>"))}
        self.sentence_end = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.sentence_end[list(ends)] = True

    def encode(self, text: str) -> bytes:
        """Ids as unsigned little-endian 32-bit numbers."""
        if self.other(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > WORD_CACHE:
                self.known.clear()
            # the words of a text in one call, with spaces between them; the last id of each is a word end
            new = list(set(words).difference(self.known))
            ids = np.array(self.library.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            data, start = ids.tobytes(), 0
            for word, stop in zip(new, (4 * np.flatnonzero(self.word_end[ids]) + 4).tolist(), strict=True):
                self.known[word], start = data[start:stop], stop
            return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def best_cuts(places: list[int], costs: list[float], window: int) -> list[int]:
    """Cheapest indexes of ``places`` to cut at, the last included; places[0] is the start.

    ``places`` rise, neighbours are at most ``window`` apart; ``costs`` is what a cut at each place costs."""
    total, came = [0.0] * len(places), [0] * len(places)
    queue: deque[tuple[float, int]] = deque([(float(places[0]), 0)])
    for j in range(1, len(places)):
        at = places[j]
        while places[queue[0][1]] < at - window:
            queue.popleft()
        key, i = queue[0]
        total[j] = cost = key + window - at + costs[j]
        came[j] = i
        key = cost + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, window: int, sentence_cost: float, cut_cost: float):
    """Where windows may end in a stretch of ids, and the cost of each: (places, costs), places[0] being 0."""
    grid = max(1, window // 64)
    sentences = np.flatnonzero(sentence_end[ids]) + 1
    natural = np.unique(np.concatenate([[0], doc_ends, sentences]))
    gaps = np.diff(natural)
    more = np.maximum(0, -(-gaps // grid) - 1)  # places inside each long sentence
    inner = np.repeat(natural[:-1], more) + grid * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    places = np.concatenate([natural, inner])
    costs = np.concatenate([np.where(np.isin(natural, doc_ends), 0.0, sentence_cost), np.full(len(inner), cut_cost)])
    order = np.argsort(places, kind="stable")
    return places[order], costs[order]


def pack_stream(docs: Iterator[tuple[object, bytes]], sentence_end: np.ndarray, window: int, sentence_cost: float, cut_cost: float):
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence, offset) of documents given as (doc_id, ids with the end token)."""
    held: list[tuple[object, bytes, int]] = []  # documents of the open stretch and how many of their ids are already packed
    size, sequence, stretch = 0, 0, max(STRETCH, 8 * OPEN * window)

    def solve(last: bool):
        nonlocal held, size, sequence
        ids = np.frombuffer(b"".join(d[4 * done :] for _, d, done in held), "<u4")
        left = np.array([len(d) // 4 - done for _, d, done in held], np.int64)
        places, costs = cut_places(ids, np.cumsum(left), sentence_end, window, sentence_cost, cut_cost)
        cuts = places[best_cuts(places.tolist(), costs.tolist(), window)]
        if not last:
            cuts = cuts[:-OPEN]
        row, start = 0, 0
        for end in cuts.tolist():
            offset = 0
            while start < end:
                doc, data, done = held[row]
                take = min(end - start, len(data) // 4 - done)
                yield doc, done, take, data[4 * done : 4 * (done + take)], len(data) // 4, sequence, offset
                start, offset = start + take, offset + take
                held[row] = (doc, data, done + take)
                row += done + take == len(data) // 4
            sequence += 1
        held, size = held[row:], size - start

    for doc, data in docs:
        held.append((doc, data, 0))
        size += len(data) // 4
        if size >= stretch:
            yield from solve(False)
    if held:
        yield from solve(True)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    sentence_cost: float = 2.0,
    cut_cost: float = 24.0,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens, each with its ids (unsigned little-endian 32-bit numbers).

    ``sequence_id`` is unique over all partitions: the partition's number times 2**33 plus a count."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(tokenizer_path)

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield doc.as_py(), tool.encode(text.as_py() or "") + end

        first = TaskContext.get().partitionId() << 33
        out, held = [], 0
        for piece in pack_stream(rows(), tool.sentence_end, window, sentence_cost, cut_cost):
            out.append(piece)
            held += piece[2]
            if held >= STRETCH:
                yield _batch(out, first)
                out, held = [], 0
        if out:
            yield _batch(out, first)
        tool.known.clear()  # the worker stays for other tasks

    source = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return mapped(source, run, PIECES)


def _batch(pieces: list[tuple], first: int) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    columns = [list(c) for c in zip(*pieces, strict=True)]
    columns[5] = [first + s for s in columns[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)
