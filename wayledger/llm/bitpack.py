"""Token ids in binary files: fixed-width bit packing with block offsets.

A file holds the ids of consecutive documents.  Every id takes ``bits`` bits, the least that the vocabulary needs.  Ids are packed in
blocks of ``block`` ids, each starting at a byte offset of its own, so a reader unpacks only the blocks it needs:

    magic (8 bytes), blocks, doc ids (int64), doc id known (uint8), doc starts (uint64, one more than documents),
    block offsets (uint64, one more than blocks), footer: bits, block, documents, ids, blocks (5 x uint64), magic

All numbers are little-endian; within a block the ids' bits follow each other from the lowest bit of the first byte on.  64 ids fill
``bits`` whole 64-bit words, so packing and unpacking are 64 numpy operations over all such groups at once.

``write_ids`` ranges documents by id over files of their own and encodes them where they are written: one shuffle of the texts.  A task
writes under a name of its own; the manifest, a Parquet table in the same folder that Spark commits as a whole, names the files that
count, so attempts that were lost or repeated leave nothing that is read.  Files are written and read through ``pyarrow.fs``, from any
store that it knows by URI.

Defined results: null text is empty and leaves the end id; null ids come first, repeated ids in order of their texts' hash; rows equal in
both are written each for itself; an empty table gives an empty manifest; further columns are ignored; texts are encoded in slices."""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayledger.llm.tables import mapped

# Fixed values of the file format.
MAGIC = b"BITPACK1"
BLOCK_IDS = 1 << 16
#: Characters encoded at once.
SLICE = 1 << 20
#: Distinct pieces whose ids a worker keeps, some 200 bytes each; it takes them along from task to task.
CACHE = 1_500_000
MANIFEST = "part long, file string, n_docs long, n_ids long"
DOCUMENTS = "doc_id long, place long, start long, ids binary"


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, ``bits`` bits each, padded to whole bytes."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, bits), np.uint64)
    for k in range(64):
        at, shift = divmod(k * bits, 64)
        words[:, at] |= lanes[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, at + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of a block."""
    groups = -(-count // 64)
    raw = np.zeros(groups * bits * 8, np.uint8)
    need = -(-count * bits // 8)
    raw[:need] = np.frombuffer(data, np.uint8, need)
    words = raw.view("<u8").reshape(groups, bits)
    lanes, mask = np.empty((groups, 64), np.uint32), np.uint64((1 << bits) - 1)
    for k in range(64):
        at, shift = divmod(k * bits, 64)
        value = words[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, at + 1] << np.uint64(64 - shift))
        lanes[:, k] = value & mask
    return lanes.reshape(-1)[:count]


class Writer:
    """One file, written front to back; ids are held until a block is full."""

    def __init__(self, stream, bits: int, block: int = BLOCK_IDS):
        self.stream, self.bits, self.block = stream, bits, block
        self.names: list[int | None] = []
        self.starts, self.offsets = [0], [len(MAGIC)]
        self.open: list[np.ndarray] = []
        self.held = 0
        stream.write(MAGIC)

    def add(self, name: int | None, ids: np.ndarray) -> None:
        """One document's ids, in one or several calls of ``extend``."""
        self.extend(ids)
        self.end(name)

    def extend(self, ids: np.ndarray) -> None:
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= 16 * self.block:
            self.flush(False)

    def end(self, name: int | None) -> None:
        self.names.append(name)
        self.starts.append((len(self.offsets) - 1) * self.block + self.held)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // self.block * self.block
        for start in range(0, stop, self.block):
            data = pack_bits(ids[start : min(start + self.block, stop)], self.bits)
            self.stream.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.open, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self.flush(True)
        self.stream.write(np.array([n or 0 for n in self.names], "<i8").tobytes())
        self.stream.write(np.array([n is not None for n in self.names], np.uint8).tobytes())
        self.stream.write(np.array(self.starts, "<u8").tobytes())
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        self.stream.write(np.array([self.bits, self.block, len(self.names), self.starts[-1], len(self.offsets) - 1], "<u8").tobytes())
        self.stream.write(MAGIC)


class Reader:
    """Random access to one file given as a seekable stream: documents or any range of ids, unpacking only their blocks."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        stream.seek(size - 48)
        tail = stream.read(48)
        stream.seek(0)
        if stream.read(8) != MAGIC or tail[40:] != MAGIC:
            raise ValueError("not a complete file of packed ids")
        self.bits, self.block, docs, self.n_ids, blocks = np.frombuffer(tail, "<u8", 5).tolist()
        length = docs * 17 + 8 + 8 * (blocks + 1)
        stream.seek(size - 48 - length)
        table = stream.read(length)
        self.names = np.frombuffer(table, "<i8", docs)
        self.known = np.frombuffer(table, np.uint8, docs, 8 * docs).astype(bool)
        self.starts = np.frombuffer(table[9 * docs :], "<u8", docs + 1).astype(np.int64)
        self.offsets = np.frombuffer(table[17 * docs + 8 :], "<u8", blocks + 1).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` - 1 of the file."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.stream.seek(int(self.offsets[first]))
        data = self.stream.read(int(self.offsets[last + 1] - self.offsets[first]))
        base, parts = int(self.offsets[first]), []
        for b in range(first, last + 1):
            count = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack_bits(data[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], self.bits, count))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, place: int) -> np.ndarray:
        """Ids of the document at a place in the file."""
        return self.ids(int(self.starts[place]), int(self.starts[place + 1]))

    def find(self, name: int) -> list[int]:
        """Places of the documents with this id; known ids rise after the unknown ones."""
        known = int(np.count_nonzero(~self.known))
        low, high = (known + int(np.searchsorted(self.names[known:], name, side)) for side in ("left", "right"))
        return list(range(low, high))


# Printable characters of Latin scripts: for these the classes of letters, numbers and spaces are those of the tokenizer.
_SAFE = [c for c in map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)])]


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _SAFE if unicodedata.category(c)[0] == kind)


class ByteTokenizer:
    """Ids of texts under a byte-level BPE file of the ``tokenizers`` library, equal to its own ``encode``.

    Such a tokenizer cuts a text into pieces and encodes each by itself, so each distinct piece is encoded once by the library and
    looked up afterwards.  A text is read in slices that end before white space after other characters, where a piece always begins.
    Slices with characters beyond Latin scripts, and texts that hold a special token, go through the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        self.opens = np.zeros(self.vocabulary, bool)
        self.opens[[i for token, i in self.library.get_vocab().items() if token.startswith("Ġ")]] = True  # how the file writes a space
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        letter, number = _class("L"), _class("N")
        self.pieces = re.compile(
            rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"
        ).findall
        self.other = re.compile("[^" + "".join(map(re.escape, _SAFE)) + "]").search
        self.cut = re.compile(r"(?<=[^\s])(?=[ \t\n\r])")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def plain(self, text: str) -> bool:
        """Whether the text's pieces can be looked up: no special token, no character beyond Latin scripts."""
        return not (self.other(text) or any(s in text for s in self.special))

    def slices(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, slice by slice."""
        if any(s in text for s in self.special):
            yield self.whole(text)
            return
        start = 0
        while start < len(text):
            found = self.cut.search(text, start + SLICE) if len(text) - start > SLICE else None
            stop = found.start() if found else len(text)
            part = text[start:stop]
            yield self.whole(part) if self.other(part) else self.looked_up([part])[0]
            start = stop

    def looked_up(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of plain texts; pieces not seen before are encoded in one call."""
        cut = [self.pieces(text) for text in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        self.learn(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<u4") for pieces in cut]

    def learn(self, new: list[str]) -> None:
        """Encode pieces; those of a space and other characters in one text, where each begins with the only id that opens with a space."""
        spaced = [p for p in new if len(p) > 1 and p[0] == " " and not p[1].isspace()]
        ids = np.array(self.library.encode_batch_fast(["".join(spaced)], add_special_tokens=False)[0].ids, "<u4")
        data, ends = ids.tobytes(), (4 * np.flatnonzero(self.opens[ids])).tolist()[1:] + [4 * len(ids)]
        start = 0
        for piece, end in zip(spaced, ends if spaced else [], strict=True):
            self.known[piece], start = data[start:end], end
        rest = [p for p in new if p not in self.known]
        for piece, found in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[piece] = array("I", found.ids).tobytes()

    def documents(self, rows: Iterator[tuple[object, str]]) -> Iterator[tuple[object, Iterable[np.ndarray]]]:
        """(name, slices of ids) of (name, text) in order; short plain texts are looked up together."""
        held: list[tuple[object, str]] = []
        size = 0
        for name, text in rows:
            short = len(text) <= SLICE and self.plain(text)
            if short:
                held.append((name, text))
                size += len(text)
            if not short or size >= SLICE:
                yield from self._held(held)
                held, size = [], 0
            if not short:
                yield name, self.slices(text)
        yield from self._held(held)

    def _held(self, held: list[tuple[object, str]]) -> Iterator[tuple[object, list[np.ndarray]]]:
        for (name, _), ids in zip(held, self.looked_up([text for _, text in held]), strict=True):
            yield name, [ids]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else "file://" + os.path.abspath(folder))


def write_ids(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    files: int | None = None,
    block: int = BLOCK_IDS,
) -> DataFrame:
    """Write all documents' ids, each with ``end_id`` after it, in ascending order of document ids; returns the manifest as written.

    ``files`` is by default one for each shuffle partition."""
    spark = docs.sparkSession
    text = docs[text_column].cast("string")
    source = docs.select(docs[id_column].cast("long").alias("doc_id"), text.alias("text"))
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal ids in order of their texts; the place cuts a run of equal rows over several files
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("place")]
    ranged = source.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, out, stream = tokenizer(tokenizer_path), None, None
        store, base = _store(folder)
        part = TaskContext.get().partitionId()
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.bits"
        end = np.array([end_id], np.uint32)
        rows = ((doc.as_py(), text.as_py() or "") for batch in batches for doc, text in zip(batch.column(0), batch.column(1), strict=True))
        for doc, slices in tool.documents(rows):
            if out is None:
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(f"{base}/{name}")
                out = Writer(stream, width(max(tool.vocabulary, end_id + 1)), block)
            for ids in slices:
                out.extend(ids)
            out.add(doc, end)
        if out is not None:
            out.close()
            stream.close()
            row = [[part], [name], [len(out.names)], [out.starts[-1]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], [c.split()[0] for c in MANIFEST.split(", ")])

    mapped(ranged.select("doc_id", "text"), run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files that count, with the number of documents and ids before each; one row a file."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n_docs", "n_ids")})


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, place, start, ids) of every document: its place and the number of ids before it in the whole, and its ids as unsigned
    little-endian 32-bit numbers.  Files are read by tasks of their own, a group of blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        names = [c.split()[0] for c in DOCUMENTS.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as stream:
                    reader = Reader(stream)
                    first = 0
                    while first < row["n_docs"]:
                        # as many documents as fill some blocks, at least one
                        goal = reader.starts[first] + 16 * reader.block
                        last = max(first + 1, int(np.searchsorted(reader.starts, goal, "right")) - 1)
                        ids = reader.ids(int(reader.starts[first]), int(reader.starts[last])).astype("<u4")
                        cuts = reader.starts[first : last + 1] - reader.starts[first]
                        data = [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                        columns = [
                            pa.array(reader.names[first:last], mask=~reader.known[first:last]),
                            pa.array(np.arange(first, last) + row["n_docs_before"]),
                            pa.array(reader.starts[first:last] + row["n_ids_before"]),
                            pa.array(data, pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names)
                        first = last

    manifest = read_manifest(spark, folder)
    files = manifest.count()
    return mapped(manifest.repartition(max(files, 1)), run, DOCUMENTS)


def document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents with one id, read by random access: only the blocks that hold them.

    Every file's table of documents is searched by a task; what comes back is the documents asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as stream:
                    reader = Reader(stream)
                    for at in reader.find(doc_id):
                        data = reader.document(at).astype("<u4").tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([row["n_docs_before"] + at]), pa.array([data], pa.binary())], ["place", "ids"])

    manifest = read_manifest(spark, folder)
    rows = mapped(manifest.repartition(max(manifest.count(), 1)), run, "place long, ids binary").orderBy("place").collect()
    return [np.frombuffer(r["ids"], "<u4") for r in rows]

