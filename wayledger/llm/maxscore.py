"""Exact top-k search over inverted lists by MaxScore, shard by shard.

Rows are dealt into shards; within a shard each term has a positive and a negative list of (row, weight), kept side by side as one line of
a matrix in which zero means absent.  For a query, a list's upper bound is the largest contribution that it can add, zero for lists that
only subtract.  A block of queries is searched together:

1. The score to beat of each query is the k-th best of a first few rows scored in full.
2. Terms are taken in order of falling bounds, summed over the block.  A query's essential terms are the first ones up to where the bounds
   of the rest add up to less than its score to beat; rows in no essential list of any query are no candidates.  Where a score of zero
   could do, every row is one, so the search is exact for scores of either sign.
3. The essential lists are traversed, then the others are probed for candidates that are still competitive: a row is dropped once its score
   plus the bounds still to come can't reach the score to beat of any query of the block.

The shards' best k are merged by a window.  The stated queries are dealt in blocks against the shards (not a cross join: queries x shards
rows of queries, blocks of bounded size).

Defined results: rows whose vector is null, or holds null or non-finite components, take no part; ties go to the smaller id; rows with a
null id take no part; rows that share an id are rows of their own, as queries and as candidates, and a query leaves out itself alone; a
query has fewer than k results if there are fewer other rows; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayledger.llm.tables import ship, stored

#: Rows of a shard, queries of a block and of one search: bound the memory of a task.
SHARD_ROWS, QUERY_BLOCK, SEARCHED = 8192, 4096, 128
FIRST_ROWS = 256
#: Terms traversed between two looks at what is still competitive.
STEP = 8


class Shard:
    """Inverted lists of rows (row number, id, weights)."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        order = np.lexsort((rows, ids))
        self.rows, self.ids = rows[order], ids[order]
        # sums of products below 2**53 are exact as doubles, which multiply much faster
        self.lists = np.ascontiguousarray(weights[order].T)
        self.most, self.least = (f(self.lists, 1, initial=0) for f in (np.max, np.min))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the k best rows of each query but for row number ``own``, ties to the smaller id."""
        reach = int(np.abs(queries).max(initial=0)) * int(np.abs(self.lists).max(initial=0)) * len(self.lists)
        kind, none = (np.float64, -np.inf) if reach < 1 << 53 else (np.int64, np.iinfo(np.int64).min)
        queries, lists = queries.astype(kind), self.lists.astype(kind)
        bounds = np.maximum(np.maximum(queries * self.most.astype(kind), queries * self.least.astype(kind)), 0)
        terms = np.argsort(-bounds.sum(0), kind="stable")
        queries, lists, bounds = queries[:, terms], lists[terms], bounds[:, terms]
        rest = np.concatenate([np.cumsum(bounds[:, ::-1], 1)[:, ::-1], np.zeros((len(queries), 1), kind)], 1)  # of terms from each on

        n = len(self.ids)
        first = np.unique(np.linspace(0, n - 1, min(n, FIRST_ROWS)).astype(int))
        seen = np.where(self.rows[first] == own[:, None], none, queries @ lists[:, first])
        beat = np.sort(seen, 1)[:, -k] if len(first) >= k else np.full(len(queries), none)

        essential = int((rest >= beat[:, None]).sum(1).max(initial=0))  # the rest of the terms is below every query's score to beat
        kept = np.arange(n)
        if essential < len(lists) and (beat > 0).all():
            adds = (queries[:, :essential, None] > 0).any(0) & (lists[:essential] > 0) | (queries[:, :essential, None] < 0).any(0) & (lists[:essential] < 0)
            kept = np.flatnonzero(adds.any(0))
        score = np.zeros((len(queries), len(kept)), kind)
        for start in range(0, len(lists), STEP):
            stop = min(start + STEP, len(lists))
            score += queries[:, start:stop] @ lists[start:stop, kept]
            alive = (score + rest[:, stop, None] >= beat[:, None]).any(0)
            if stop < len(lists) and alive.sum() < 0.8 * len(kept):
                kept, score = kept[alive], score[:, alive]
        score = np.where(self.rows[kept] == own[:, None], none, score)
        out = [(np.zeros(0, np.int64),) * 3]
        for q, line in enumerate(score):
            least = np.partition(line, -k)[-k] if len(line) > k else none
            best = np.flatnonzero((line >= least) & (line > none))
            best = best[np.argsort(-line[best], kind="stable")[:k]]  # places rise with the ids
            out.append((np.full(len(best), q), kept[best], line[best].astype(np.int64)))
        query, place, found = (np.concatenate(x) for x in zip(*out, strict=True))
        return query, place, found


FOUND = "query_row long, query_id long, vec_id long, score long"


def search_shards(k: int):
    """The function for a shard and a block of queries."""

    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({c.split()[0]: pa.array([], pa.int64()) for c in FOUND.split(", ")})
        if not rows.num_rows or not queries.num_rows:
            return none
        weights, asked = _matrix(rows.column("w")), _matrix(queries.column("w"))
        width = max(weights.shape[1], asked.shape[1])
        weights, asked = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (weights, asked))
        shard = Shard(rows.column("row").to_numpy(), rows.column("id").to_numpy(), weights)
        own, ids, parts = queries.column("row").to_numpy(), queries.column("id").to_numpy(), [none]
        for start in range(0, len(own), SEARCHED):
            here = slice(start, start + SEARCHED)
            query, place, score = shard.search(asked[here], own[here], k)
            parts.append(pa.table({"query_row": own[here][query], "query_id": ids[here][query], "vec_id": shard.ids[place], "score": score}))
        return pa.concat_tables(parts)

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of the column, shorter ones filled with zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = (
        column.flatten().to_numpy()
    )
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query row with every other row.

    ``vectors`` has id long and w array<long>; ``is_query`` is a condition on id."""
    ship(vectors.sparkSession)
    sound = vectors.where("id is not null and w is not null")
    rows = stored(sound.withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.where(is_query)
    n, asked = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // QUERY_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).withColumn("block", every(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks))).withColumn("shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search_shards(k), FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def scaled(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """(id, w): floor(scale * component) of vectors without null or non-finite components."""
    v = F.col(vector_column)
    sound = v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(sound).select(
        F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("w")
    )
