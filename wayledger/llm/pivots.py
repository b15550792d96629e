"""Near-duplicate embeddings by an index of pivot permutations.

Tables of every size go through the index, whose recall is below 1 (README, by size).  Its reference points (pivots) are spread apart: a
bounded sample of the vectors is thinned, each time to the one farthest from those chosen, and never to one closer to another than
``TOO_CLOSE``, so that a dense group of any size holds few of them.  Each vector is described by its nearest pivots, ``prefix_length``
of them, which rises with their count so that recall holds, and stands in the inverted list of each; two vectors are compared if they
share at least ``SHARED`` (one) of these.

A list longer than ``BLOCK`` is dealt into blocks and verified in full, block against block in tiles, with cosines in double precision.
A pair that shares more pivots stands in several lists and counts only in that of its smallest common pivot.  What leaves a block pair
are counts of links and a star for each linked component, so rows grow with the vectors, not with the pairs.

Every vector is in a list; only the pivots come from a sample: up to ``pivot_count`` of the ``CANDIDATES`` times as many with the smallest
hashes, rising with the square root of the table so that lists keep their length.  Recall on planted pairs and groups is measured in the
tests and, by size, in the README.

Defined results: vectors that are null, empty, of length zero, or hold null or non-finite components link with nothing and stand alone;
vectors of different lengths don't link; equal vectors are compared once and count as links of each other; rows with a null id never
name a component; rows that repeat an id keep one row each; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.llm.jaccard import local_roots
from wayledger.llm.tables import connected_components, mapped, stored

THRESHOLD = 0.9
#: No size goes without the index; tests of the index still set this.
ALL_PAIRS = 0
LEAST_PREFIX = 6
SHARED = 1
LEAST_PIVOTS, MOST_PIVOTS = 32, 4096
#: Candidates for each pivot, and the cosine from which one is too close to a chosen pivot.
CANDIDATES, TOO_CLOSE = 4, 0.8
#: Rows of a block and of a tile: bound the memory of a task; a block is sent once for each block of its list.
BLOCK, TILE = 8192, 1024


def pivot_count(rows: int) -> int:
    """Of a table with so many vectors."""
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * rows**0.5)))


def prefix_length(pivots: int) -> int:
    """How many nearest pivots describe a vector: one more each time their count doubles."""
    return min(pivots, max(LEAST_PREFIX, (pivots - 1).bit_length() + 1))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spread_apart(candidates: np.ndarray, want: int) -> np.ndarray:
    """Up to ``want`` of the candidates, from the first on always the one farthest from all chosen, while none is too close."""
    x = unit(candidates).astype(np.float32)
    chosen, nearest = [], np.full(len(x), -2, np.float32)
    while len(chosen) < min(want, len(x)):
        at = int(nearest.argmin())
        if nearest[at] >= TOO_CLOSE:
            break
        chosen.append(at)
        np.maximum(nearest, x @ x[at], out=nearest)
    return candidates[chosen]


def describe(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(node, size, near, v): the nodes (node, size, v) with the numbers of their nearest pivots in ascending order."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)
    prefix = prefix_length(len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unit(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                x = unit(_matrix(batch.column(2), p.shape[1]))
                near = np.argpartition(-(x @ p.T), prefix - 1, axis=1)[:, :prefix]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(np.sort(near, axis=1).astype(np.int32).ravel()), prefix)
                columns = [batch.column(0), batch.column(1), lists.cast(pa.list_(pa.int32())), batch.column(2)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "size", "near", "v"])

    kind = nodes.schema["v"].dataType.simpleString()
    return mapped(nodes, run, f"node long, size long, near array<int>, v {kind}")


def verify(threshold: float, width: int, prefix: int):
    """The function for a block pair of a list: (node, links, root) of each node that has links to count there."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pivot, lo, hi = (k.as_py() for k in key)
        node, size, block = (table.column(c).to_numpy() for c in ("node", "size", "block"))
        x = unit(_matrix(table.column("v"), width))
        near = _matrix(table.column("near"), prefix)
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        place, links = np.arange(len(node)), np.zeros(len(node), np.int64)
        for i in range(0, len(left), TILE):
            for j in range(i if lo == hi else 0, len(right), TILE):
                u, w = left[i : i + TILE], right[j : j + TILE]
                linked = x[u] @ x[w].T >= threshold
                a, b = np.nonzero(np.triu(linked, 1) if lo == hi and i == j else linked)
                if not len(a):
                    continue
                a, b = u[a], w[b]
                apart = place[a] != place[b]
                if apart.any():
                    place = local_roots(len(node), place[a[apart]], place[b[apart]])[place]
                # a common pivot below that of this list means that another list counts the pair
                mine = np.ones(len(a), bool)
                for at in range(0, len(a), 1 << 16):
                    na, nb = near[a[at : at + (1 << 16)]], near[b[at : at + (1 << 16)]]
                    common = (na[:, :, None] == nb[:, None, :]).any(2)
                    mine[at : at + (1 << 16)] = ~(common & (na < pivot)).any(1)
                a, b = a[mine], b[mine]
                np.add.at(links, a, size[b])
                np.add.at(links, b, size[a])
        root = node[place]
        has = (links > 0) | (root != node)
        return pa.table({"node": node[has], "links": links[has], "root": root[has]})

    return run


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, seed: int = 23
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors``."""
    v = F.col("v")
    source = vectors.select(vectors[id_column].cast("long").alias("did"), vectors[vector_column].alias("v"))
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    sound = v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    keyed = stored(source.withColumn("node", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(F.lit(seed), v))), "vectors")
    nodes = stored(
        keyed.where("node is not null").groupBy("node").agg(F.min("did").alias("did"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v")),
        "nodes",
    )
    lengths = [r[0] for r in nodes.select(F.size("v")).distinct().collect()]  # of embeddings: one as a rule
    found = None
    for width in lengths:
        own = nodes.where(F.size("v") == width)
        want = pivot_count(own.count())
        sample = own.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(CANDIDATES * want).select("v").toArrow()
        pivots = spread_apart(_matrix(sample.column("v"), width), want)
        links = verified(describe(own.select("node", "size", "v"), pivots), threshold, width, prefix_length(len(pivots)))
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = nodes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root"))
    found = stored(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    whole = nodes.select("node", "did", "size").join(links, "node", "left").join(classes, "node", "left")
    whole = whole.withColumn("component", F.coalesce("component", "node"))
    names = whole.groupBy("component").agg(F.min("did").alias("component_id"))
    answer = whole.join(names, "component").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    out = keyed.select("did", "node").join(answer, "node", "left")
    component = F.coalesce("component_id", "did")
    return out.select(
        F.col("did").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("did") == component).alias("kept"),
    )


def verified(described: DataFrame, threshold: float, width: int, prefix: int) -> DataFrame:
    """(node, links, root) from the inverted lists; lists of one vector have nothing to verify."""
    described = stored(described, "described")
    sizes = described.select(F.explode("near").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    postings = described.select(F.explode("near").alias("list"), "node", "size", "near", "v")
    dealt = postings.join(F.broadcast(sizes), "list")  # at most MOST_PIVOTS rows
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("list", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "size", "near", "block", "v")
    # a stated count, as few bytes are much work here and small partitions would be put together
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "list", "lo", "hi").groupBy("list", "lo", "hi").applyInArrow(verify(threshold, width, prefix), "node long, links long, root long")
