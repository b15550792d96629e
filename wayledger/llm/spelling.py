"""Grouping of spelling variants: words one edit apart, found by dense tiles of common prefix and suffix lengths.

1. ``word_counts`` takes the words of all texts with their numbers of occurrences, counted per batch before the shuffle.
2. Two different words are near if one inserted, deleted or replaced code point makes them equal.  With p the common prefix, s the
   common suffix and M the longer length that is p + s >= M - 1, so p or s is at least M // 2.  Words are therefore dealt into groups
   of equal (M, first or last M // 2 code points), each word as the longer or equal one (M its length) and as the shorter one (M one
   more).  A group's words become a padded matrix of code points, left and right aligned, and every pair of its blocks of ``TILE``
   words is one tile: the lengths of all common prefixes and suffixes come from a few comparisons of whole columns.  A pair that meets
   in both groups counts in the prefix group only, so each near pair is seen exactly once.
3. Each tile sends, for a word with near words, their number and the best of them; rows grow with the words, not with the pairs.
4. ``form`` is the near word of largest count (ties: smallest in code-point order) if that count is ``ratio`` times the word's; since
   counts rise along forms, they make trees, whose roots are found by pointer doubling in rounds that are written to the shared folder.

Groups of more than ``TILE`` words are cut into blocks by a hash, and each pair of blocks is a row group of its own, so no task holds
more than two blocks of a group.

Defined results: null text has no words; a null id is the empty text in the hash of ``spoil``; repeated rows count each for itself;
an empty table gives an empty result; further columns are ignored; a text of any length is read in slices."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.llm.tables import mapped, stored

#: Words of one block of a group.
TILE = 2048
#: Bytes of a text read at once, and distinct words a task counts before it sends them on.
SLICE, DISTINCT = 1 << 22, 1 << 20
RATIO = 2

# Word bytes in UTF-8: letters of ASCII, made small, and U+00C0 to U+00FF, which are C3 80 to C3 BF.
_SMALL = bytearray(b" " * 256)
_SMALL[0x61:0x7B] = _SMALL[0x41:0x5B] = bytes(range(0x61, 0x7B))
_SMALL[0x80:0xC0] = bytes(range(0x80, 0xC0))
_SMALL[0xC3] = 0xC3
_SMALL = bytes(_SMALL)
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")


def word_slices(text: str, most: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, slices of about ``most`` bytes."""
    data = text.encode()
    if not data.isascii():
        data = _OTHER.sub(b" ", data)
    data = data.translate(_SMALL)
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + most)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def spoiled(word: bytes, place: int) -> bytes:
    """The word without the code point at ``place``."""
    text = word.decode()
    return (text[:place] + text[place + 1 :]).encode()


def word_counts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_length: int = 5,
    min_count: int = 3,
    spoil: int = 0,
    slice_bytes: int = SLICE,
    distinct: int = DISTINCT,
) -> DataFrame:
    """(word, n) of all words with ``min_length`` code points and ``min_count`` occurrences.

    With ``spoil`` a share of the occurrences is misspelt, to measure what grouping finds: h is the crc32 of ``<id>:<word>``, and where
    ``spoil`` divides it the word loses its code point h modulo its length."""

    def send(counts: Counter) -> pa.RecordBatch:
        live = [(w, n) for w, n in counts.items() if n]
        words = pa.array([w for w, _ in live], pa.binary()).cast(pa.string())
        batch = pa.RecordBatch.from_arrays([words, pa.array([n for _, n in live], pa.int64())], ["word", "n"])
        return batch.filter(pc.greater_equal(pc.utf8_length(words), min_length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                head = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for words in word_slices(text.as_py() or "", slice_bytes):
                    counts.update(words)
                    if spoil:
                        for word in set(words):
                            h = zlib.crc32(word, head)
                            if h % spoil == 0:
                                n = words.count(word)
                                counts[word] -= n
                                counts[spoiled(word, h % len(word.decode()))] += n
                    if len(counts) > distinct:
                        yield send(counts)
                        counts = Counter()
        if counts:
            yield send(counts)

    source = docs.select(docs[id_column].cast("string").alias("name"), docs[text_column].cast("string").alias("text"))
    found = mapped(source, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= min_count)


def dealt(words: DataFrame) -> DataFrame:
    """(key, word, n, longer, block) of every group and tile that a word belongs to; ``key`` names both."""
    length = F.length("word")

    def member(longest: Column, longer: bool, suffix: bool) -> Column:
        half = f"(length(word) + {0 if longer else 1}) div 2"
        affix = F.expr(f"right(word, {half})" if suffix else f"left(word, {half})")
        return F.struct(longest.alias("longest"), F.lit(suffix).alias("suffix"), affix.alias("affix"), F.lit(longer).alias("longer"))

    members = F.array(*[member(length + (0 if longer else 1), longer, suffix) for longer in (True, False) for suffix in (False, True)])
    rows = words.select("word", "n", F.inline(members))
    group = ["longest", "suffix", "affix"]
    # blocks of each group; nearly all groups have one and need no row here
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > TILE)
    blocks = sizes.select(*group, F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    rows = rows.join(blocks, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.concat_ws(" ", "longest", "suffix", F.least("block", "other"), F.greatest("block", "other"), "affix")
    return tiles.select(key.alias("key"), "word", "n", "longer", "block")


def shared(left: np.ndarray, right: np.ndarray, start: int) -> np.ndarray:
    """How many leading columns each row of ``left`` shares with each row of ``right``, the first ``start`` being known to agree."""
    alive = np.ones((len(left), len(right)), bool)
    total = np.full(alive.shape, start, np.int32)
    for c in range(start, left.shape[1]):
        alive &= left[:, c][:, None] == right[:, c][None, :]
        if not alive.any():
            break
        total += alive
    return total


def near_pairs(
    words: np.ndarray, longer: np.ndarray, block: np.ndarray, longest: int, suffix: bool, first: int, last: int
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near words in the tile of blocks ``first`` and ``last`` of a group; each pair once."""
    codes = np.ascontiguousarray(words.astype(f"U{longest}")).view(np.uint32).reshape(len(words), longest)
    codes = codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes
    flush = codes.copy()  # right aligned
    flush[~longer, 1:], flush[~longer, 0] = codes[~longer, :-1], 0
    flush, half = flush[:, ::-1], longest // 2
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def compare(a: np.ndarray, b: np.ndarray, triangle: bool) -> None:
        if not len(a) or not len(b):
            return
        tail = shared(flush[a], flush[b], half if suffix else 0)
        head = shared(codes[a], codes[b], 0 if suffix else half)
        near = head + tail >= longest - 1
        if suffix:
            near &= head < half
        x, y = np.nonzero(np.triu(near, 1) if triangle else near)
        found.append((a[x], b[y]))

    if first == last:
        long = np.flatnonzero(longer)
        compare(long, long, True)
        compare(long, np.flatnonzero(~longer), False)
    else:
        for one, two in ((first, last), (last, first)):
            compare(np.flatnonzero(longer & (block == one)), np.flatnonzero(~longer & (block == two)), False)
        compare(np.flatnonzero(longer & (block == first)), np.flatnonzero(longer & (block == last)), False)
    x, y = (np.concatenate(side) for side in zip(*found, strict=True))
    return x, y


def _best(words: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word with near words: its index, their number and the index of the best one."""
    at, near = np.concatenate([x, y]), np.concatenate([y, x])
    place = np.argsort(np.argsort(words, kind="stable"))
    order = np.lexsort((place[near], -n[near], at))
    at, near = at[order], near[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[starts], np.diff(np.concatenate([starts, [len(at)]])), near[starts]


_FOUND = "word string, n_near long, best_n long, best string"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted rows of ``dealt``: runs of equal keys are tiles."""
    out: list[tuple] = []
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def send() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        out.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c.tolist(), k) for c, k in zip(columns, kinds, strict=True)], names)

    def tile(rows: pa.Table) -> None:
        longest, suffix, first, last, _ = rows.column("key")[0].as_py().split(" ", 4)
        words = np.array(rows.column("word").to_pylist())
        n, longer, block = (rows.column(c).to_numpy() for c in ("n", "longer", "block"))
        x, y = near_pairs(words, longer, block, int(longest), suffix == "true", int(first), int(last))
        if len(x):
            at, many, best = _best(words, n, x, y)
            out.append((words[at].astype(object), many, n[best], words[best].astype(object)))

    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        key = rows.column("key").combine_chunks()
        cuts = (np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist() if len(rows) > 1 else []
        for start, stop in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            part = rows.slice(start, stop - start)
            if not len(part):
                continue
            if held and held[-1].column("key")[0] != part.column("key")[0]:
                whole = pa.concat_tables(held)
                if len(whole) > 1:
                    tile(whole)
                held = []
            held.append(part)
        if len(out) > 2000:
            yield send()
    if held and sum(map(len, held)) > 1:
        tile(pa.concat_tables(held))
    if out:
        yield send()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word of (word, n) that has a near one."""
    rows = dealt(words).repartition("key").sortWithinPartitions("key")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = mapped(rows, _search, _FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each word's last form, by pointer doubling."""
    now = stored(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = F.col("next").isNotNull()
        now = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), moved.alias("moved")), "roots")
    return now.select("word", "root")


def variants(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of distinct words (word, n); see the module's text."""
    words = stored(words, "words")
    named = F.col("best_n") >= ratio * F.col("n")
    tree = words.join(near_words(words), "word", "left").select(
        "word",
        "n",
        F.when(named, F.col("best")).alias("form"),
        F.when(named, F.col("best_n")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    tree = stored(tree, "forms")
    ends = roots(tree.where("form is not null"))
    return tree.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
