"""Packed id files: round trips, random access, order, and ids equal to the library's."""

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wayledger.llm import bitpack
from wayledger.llm.queries import op12_bitpack, tokenizer_file
from wayledger.llm.tables import shared_folder

PATH = tokenizer_file("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  \n\n x", "it's we'll  they'RE 'sa ''s", "a\tb \r\n c\n\n\nd   ", "Ünïcödé naïve façade 12ab 3.14%", "日本語 text   x y", "<|endoftext|> x<|endoftext|>",
    "­̀ é \U0001f600 \x1c\x85 z", "x" * 3000, " " * 3000, "one two, three! " * 400,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(PATH)
    return lambda text: tool.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 2, 7, 8, 13, 16, 17, 31, 32])
@pytest.mark.parametrize("count", [0, 1, 63, 64, 65, 1000])
def test_bits_round_trip(bits, count):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, count, dtype=np.uint64).astype(np.uint32)
    data = bitpack.pack_bits(ids, bits)
    assert len(data) == -(-count * bits // 8)
    assert bitpack.unpack_bits(data, bits, count).tolist() == ids.tolist()
    value = int.from_bytes(data, "little")  # bits follow each other from the lowest on
    assert [value >> (i * bits) & ((1 << bits) - 1) for i in range(count)] == ids.tolist()


def test_width():
    assert [bitpack.width(n) for n in (1, 2, 3, 256, 257, 50257, 65537)] == [1, 1, 2, 8, 9, 16, 17]


def test_file_with_random_access():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 5000, n, dtype=np.uint32) for n in (0, 5, 300, 1, 2000, 0, 64)]
    names = [None, None, 3, 7, 7, 7, 90]
    sink = io.BytesIO()
    out = bitpack.Writer(sink, 13, block=64)
    for name, ids in zip(names, docs, strict=True):
        out.add(name, ids)
    out.close()
    reader = bitpack.Reader(pa.PythonFile(io.BytesIO(sink.getvalue()), "r"))
    whole = np.concatenate(docs)
    for at, ids in enumerate(docs):
        assert reader.document(at).tolist() == ids.tolist()
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(whole) + 1, 2).tolist())
        assert reader.ids(a, b).tolist() == whole[a:b].tolist()
    assert [reader.find(n) for n in (3, 7, 8, 90)] == [[2], [3, 4, 5], [], [6]]
    with pytest.raises(ValueError, match="complete"):
        bitpack.Reader(pa.PythonFile(io.BytesIO(sink.getvalue()[:-9]), "r"))


def test_ids_are_the_librarys(library, monkeypatch):
    for size in (1 << 20, 7):
        monkeypatch.setattr(bitpack, "SLICE", size)
        tool = bitpack.ByteTokenizer(PATH)
        for text in TEXTS:
            parts = list(tool.slices(text))
            got = np.concatenate(parts).tolist() if parts else []
            assert got == library(text), text[:50]


def test_write_and_read(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (5, "again"), (5, "again"), (-3, "first")]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, file string, part int").repartition(4)
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    manifest = bitpack.write_ids(docs, PATH, folder, files=5, block=64)
    assert manifest.groupBy().sum("n_docs").first()[0] == len(rows)
    got = bitpack.read_ids(spark, folder).orderBy("place").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for place, r in enumerate(got):
        assert (r.place, r.start) == (place, start)
        start += len(r.ids) // 4
    want = sorted((str(i), [*library(t), 0]) for i, t in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert [x.tolist() for x in bitpack.document(spark, folder, 11)] == [[*library(TEXTS[11]), 0]]
    assert len(bitpack.document(spark, folder, 5)) == 3 and bitpack.document(spark, folder, 999) == []


def test_lost_attempts_do_not_count(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    bitpack.write_ids(docs, PATH, folder, files=1)
    with open(folder.removeprefix("file://") + "/ids-000000-lost.bits", "wb") as half:
        half.write(b"BITPACK1 half")
    assert bitpack.read_ids(spark, folder).count() == 2
    bitpack.write_ids(docs.where("false"), PATH, folder, files=1)
    assert bitpack.read_ids(spark, folder).count() == 0


def test_query_against_the_library(spark, small, library):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op12_bitpack(spark, small).collect()}
    start = 0
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*library(r.text), 0], "<u4")
        assert got.pop(r.doc_id) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got
