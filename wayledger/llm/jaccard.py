"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. One pass over the texts gives each row the hash of its n-gram set and its MinHash bands; rows with equal sets become one node.
2. Band hashes are shuffled; nodes that share a band belong to one candidate group (connected components of node - smallest node of
   the band).  Every pair with a common band lies within one group, so each full set is shuffled once, not once for each band.
3. A group is dealt into blocks of about ``BLOCK`` nodes and verified block against block in numpy, on the full sets.  What leaves a
   block pair are counts of links and a star for each linked component, so rows grow with the nodes, not with the pairs.
4. Links are added up, and components of the stars give each node its class.

Band and row counts follow from the threshold and the recall wanted (``choose_bands``).  At 0.8 and 0.999: 23 bands of 6 rows.

Defined results: words as in ``arrays``; a text of fewer than n words has all its words as its one n-gram; null texts and texts without
words link with nothing, not even with each other; null ids form nodes like others but never name a class; rows that repeat an id count
each as a document; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.llm.arrays import mix64, plain_strings, shingle_sets, text_slices
from wayledger.llm.tables import connected_components, mapped, stored

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
ROWS_PER_BAND = 6
#: Nodes of a block in verification: bounds the memory of a group.
BLOCK = 256
#: Columns of the incidence matrix multiplied at once.
WIDTH = 8192


def choose_bands(threshold: float, recall: float, rows: int = ROWS_PER_BAND) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` rows that catch a pair at the threshold with the probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def minhash_bands(grams: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """Band hashes (texts x bands, signed 64-bit) of sets given one after another; none of them may be empty."""
    rng = np.random.default_rng(seed)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    y = grams.astype(np.uint32)
    out = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        h = np.full(len(starts), band + 1, np.uint64)
        for _ in range(rows):
            a, b, c = rng.integers(1, 1 << 32, 3, dtype=np.uint32)
            values = x * (a | np.uint32(1)) + c
            values ^= values >> np.uint32(15)
            values *= b | np.uint32(1)
            values += y
            h = mix64(h ^ np.minimum.reduceat(values, starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[:, band] = h
    return out.view(np.int64)


def set_hash(grams: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash for each set."""
    return mix64(np.add.reduceat(mix64(grams ^ np.uint64(0xA5A5A5A5DEADBEEF)), starts) + counts.astype(np.uint64)).view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(did, node, bands array<long>) of every row; node and bands are null where the text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = plain_strings(batch.column(1))
            for lo, hi in text_slices(text):
                grams, starts = shingle_sets(text.slice(lo, hi - lo), n)
                counts = np.diff(starts)
                full = counts > 0
                at = starts[:-1][full]
                if len(at):
                    node, keys = set_hash(grams, at, counts[full]), minhash_bands(grams, at, bands, rows, seed)
                else:
                    node, keys = np.zeros(0, np.int64), np.zeros((0, bands), np.int64)
                place = np.where(full, np.cumsum(full) - 1, -1)
                take = pa.array(place, mask=~full)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(node).take(take), lists.take(take)], ["did", "node", "bands"]
                )

    return mapped(docs, run, "did long, node long, bands array<long>")


def node_texts(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, size, comp, blocks, grams) of every node of ``nodes`` (did, node, ...), from the text of one of its rows."""
    rows = docs.select(F.col("did"), F.coalesce("did", F.lit(-(1 << 63))).alias("key"), "text")
    found = rows.join(nodes.select(F.coalesce("did", F.lit(-(1 << 63))).alias("key"), "node", "size", "comp", "blocks"), "key")
    found = found.select("node", "size", "comp", "blocks", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = plain_strings(batch.column(4))
            for lo, hi in text_slices(text):
                grams, starts = shingle_sets(text.slice(lo, hi - lo), n)
                counts = np.diff(starts)
                own = np.zeros(hi - lo, np.int64)
                full = counts > 0
                if full.any():
                    own[full] = set_hash(grams, starts[:-1][full], counts[full])
                # rows that share an id with the node's row but have another text drop out
                keep = full & (own == batch.column(0).slice(lo, hi - lo).to_numpy())
                blobs = [grams[s:e].tobytes() for s, e in zip(starts[:-1][keep], starts[1:][keep], strict=True)]
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo).filter(mask) for i in range(4)] + [pa.array(blobs, pa.binary())],
                    ["node", "size", "comp", "blocks", "grams"],
                )

    return mapped(found, run, "node long, size long, comp long, blocks int, grams binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets of distinct numbers."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    grams, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # a gram of one set is in no intersection
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        lo, hi = np.searchsorted(column, [first, first + WIDTH])
        incidence = np.zeros((m, WIDTH), np.float32)
        incidence[owner[lo:hi], column[lo:hi] - first] = 1
        out += incidence @ incidence.T
    return out.astype(np.int64)


def local_roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..m-1 by links (a, b)."""
    root = np.arange(m)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(threshold_parts: tuple[int, int]):
    """The function for a block pair: (node, links, root) of each node that has links there."""
    over, under = threshold_parts

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        size, block = (table.column(c).to_numpy()[first] for c in ("size", "block"))
        blobs = table.column("grams")
        sets = [np.frombuffer(blobs[int(i)].as_py(), np.uint64) for i in first]
        shared = overlaps(sets)
        count = np.array([len(s) for s in sets])
        linked = shared * under >= over * (count[:, None] + count[None, :] - shared)
        np.fill_diagonal(linked, False)
        if lo != hi:
            linked &= block[:, None] != block[None, :]
        links = linked @ size
        a, b = np.nonzero(np.triu(linked))
        root = node[local_roots(len(node), a, b)]
        has = links > 0
        return pa.table({"node": node[has], "links": links[has].astype(np.int64), "root": root[has]})

    return run


def jaccard_join(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    seed: int = 11,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, copy_id, n_links.

    copy_id is the smallest id with the same n-gram set, class_id the smallest id reachable by links of a Jaccard similarity of
    ``threshold`` or more, n_links the number of other documents linked directly (copies included)."""
    bands, rows = choose_bands(threshold, recall)
    parts = (round(threshold * 1000), 1000)
    source = docs.select(docs[id_column].cast("long").alias("did"), docs[text_column].cast("string").alias("text"))
    signed = stored(signatures(source, n, bands, rows, seed), "signatures")
    nodes = stored(
        signed.where("node is not null")
        .groupBy("node")
        .agg(F.min("did").alias("did"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands")),
        "nodes",
    )
    postings = nodes.select("node", F.explode("bands").alias("band"))
    heads = postings.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = connected_components(postings.join(heads, "band").select(F.col("node").alias("src"), F.col("head").alias("dst")))
    groups = stored(groups.withColumnRenamed("component", "comp"), "groups")
    sizes = groups.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = nodes.select("node", "did", "size").join(groups, "node").join(sizes, "comp")
    sets = node_texts(source, members, n)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "size", "block", "grams"
    )
    found = stored(
        dealt.groupBy("comp", "lo", "hi").applyInArrow(verify(parts), "node long, links long, root long"), "links"
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    whole = nodes.select("node", F.col("did").alias("copy_id"), "size").join(links, "node", "left").join(classes, "node", "left")
    whole = whole.withColumn("component", F.coalesce("component", "node"))
    names = whole.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    answer = whole.join(names, "component").select(
        "node", "copy_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    out = signed.select("did", "node").join(answer, "node", "left")
    return out.select(
        F.col("did").alias("doc_id"),
        F.coalesce("class_id", "did").alias("class_id"),
        F.coalesce("copy_id", "did").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
