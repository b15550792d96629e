"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. The rows of each partition are ordered by a hash and numbered (local permutation); the numbered rows are written to the shared
   folder, so that everything below sees the same partitions whatever is computed again.
2. The number of rows that each partition sends to each shard is drawn exactly as in a uniform shuffle of all rows: row sums are the
   partitions' sizes, column sums the shards' sizes.  The partitions are halved again and again; the share of each shard that goes to
   the left half is a chain of hypergeometric draws.  All halves of a level are drawn side by side, by inversion of a uniform number
   that a hash gives, with the distribution function summed outwards over a range beyond which a double sees no probability.
3. Rows go to shards by their number within the partition, and are permuted again within the shard.  A shard is cut into cells of
   about ``CELL_ROWS`` rows by a second hash, so no task sorts a whole shard; the cells' sizes, counted from the numbers alone, give
   each cell its first slot.

Only DataFrame and SQL functions are used.  Law: shard sizes differ by one row at most (the first ``rows mod shards`` shards have the
extra row).  Defined results: null text and null ids are rows like others; repeated rows are dealt each for itself; an empty table gives
an empty result; further columns pass through, but names that begin with ``_sh_`` are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wayledger.llm.tables import stored

#: Rows that one cell of a shard holds on average: the unit of the last sort.
CELL_ROWS = 1024
#: The matrix is broadcast up to this size, else joined by partition.
BROADCAST_BYTES = 64 << 20
#: Standard deviations around the mode outside which a double sees no probability.
REACH = 10


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return ((F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1))) + F.lit(0.5)) / F.lit(float(1 << 52))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked rows among ``drawn`` of ``total``, by inversion of ``u``.

    Values are visited from the mean upwards and then downwards; weights start as 1 at the mean and follow the ratio of neighbours, so
    nothing overflows.  A first pass sums them, a second stops where the sum reaches ``u`` times that total."""
    n, m, k = (F.lit(1.0) * c for c in (total, marked, drawn))
    low = F.greatest(F.lit(0), drawn - (total - marked))
    high = F.least(marked, drawn)
    mean = F.when(n > 0, m * k / n).otherwise(0.0)
    spread = F.when(n > 1, F.sqrt(mean * (n - m) / n * (n - k) / (n - 1))).otherwise(0.0)
    centre = F.greatest(low, F.least(high, F.floor(mean)))
    reach = F.ceil(spread * REACH) + 30
    start, stop = F.greatest(low, centre - reach), F.least(high, centre + reach)
    none = F.array().cast("array<bigint>")
    values = F.concat(
        F.when(stop > centre, F.sequence(centre + 1, stop)).otherwise(none),
        F.when(start < centre, F.sequence(centre - 1, start, F.lit(-1))).otherwise(none),
    )

    def weight(a: Column, i: Column) -> Column:
        """Of value i, from that of the value before it in the order of visits; the first below the mean starts from 1 again."""
        upward = (a["m"] - i + 1.0) * (a["k"] - i + 1.0) / (i * (a["n"] - a["m"] - a["k"] + i))
        downward = (i + 1.0) * (a["n"] - a["m"] - a["k"] + i + 1.0) / ((a["m"] - i) * (a["k"] - i))
        return F.when(i > a["c"], a["w"] * upward).when(i == a["c"] - 1, downward).otherwise(a["w"] * downward)

    fixed = [n.alias("n"), m.alias("m"), k.alias("k"), (centre * F.lit(1.0)).alias("c")]
    same = lambda a: [a[x].alias(x) for x in "nmkc"]

    def add(a: Column, v: Column) -> Column:
        w = weight(a, v * 1.0)
        return F.struct(*same(a), w.alias("w"), (a["sum"] + w).alias("sum"))

    def seek(a: Column, v: Column) -> Column:
        w = weight(a, v * 1.0)
        return F.struct(
            *same(a), w.alias("w"), (a["sum"] + w).alias("sum"), a["goal"].alias("goal"),
            F.when(a["sum"] < a["goal"], v).otherwise(a["x"]).alias("x"),
        )

    whole = F.aggregate(values, F.struct(*fixed, F.lit(1.0).alias("w"), F.lit(1.0).alias("sum")), add, lambda a: a["sum"])
    first = F.struct(*fixed, F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), (u * whole).alias("goal"), centre.cast("long").alias("x"))
    return F.aggregate(values, first, seek, lambda a: a["x"])


def matrix(sizes: DataFrame, shard_sizes: list[int], seed: int) -> DataFrame:
    """(part, counts array<long>): how many rows each partition sends to each shard; ``sizes`` has (part, n)."""
    spark = sizes.sparkSession
    order = Window.orderBy("part")  # one row for each partition: file splits, not documents
    leaves = stored(sizes.select((F.row_number().over(order) - 1).alias("leaf"), "part", "n"), "leaves")
    many = leaves.count()
    depth = max(many - 1, 0).bit_length()
    want = F.array(*[F.lit(s).cast("long") for s in shard_sizes])
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"), want.alias("counts"))
    for level in range(depth):
        half = 1 << (depth - level - 1)
        left = leaves.where(F.expr(f"(leaf div {half}) % 2 = 0")).groupBy(F.expr(f"leaf div {2 * half}").alias("node"))
        joined = nodes.join(left.agg(F.sum("n").alias("left")), "node", "left").withColumn("left", F.coalesce("left", F.lit(0)))
        nodes = joined.select(F.col("node"), F.col("counts"), split(seed, level, len(shard_sizes)).alias("chain"))
        nodes = nodes.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("chain").alias("counts")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("counts", "chain", lambda c, x: c - x).alias("counts")),
                )
            ).alias("x")
        ).select("x.*")
        nodes = stored(nodes, "nodes")
    return leaves.join(nodes, leaves["leaf"] == nodes["node"]).select("part", "counts")


def split(seed: int, level: int, shards: int) -> Column:
    """The shards' counts of the left half of a node: a chain of draws, each from what the ones before leave."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    first = F.struct(F.array().cast("array<bigint>").alias("taken"), total.alias("rows"), F.col("left").cast("long").alias("left"))

    def step(acc: Column, i: Column) -> Column:
        c = F.element_at("counts", i)
        x = hypergeometric(acc["rows"], c, acc["left"], uniform(F.lit(seed), F.lit(level), F.col("node"), i))
        return F.struct(
            F.array_append(acc["taken"], x).alias("taken"), (acc["rows"] - c).alias("rows"), (acc["left"] - x).alias("left")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), first, step, lambda a: a["taken"])


def shuffle_to_shards(docs: DataFrame, shards: int, seed: int = 17, key: list[str] | None = None) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard).

    ``key`` names the columns whose hash orders rows (default: all that can be hashed), together with the row's place in its
    stored partition, so that equal rows are spread too."""
    spark = docs.sparkSession
    key = key or [f.name for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    # the stored place keeps rows equal in all columns from standing side by side
    hashed = F.xxhash64(F.lit(seed), *[F.col(c) for c in key], F.monotonically_increasing_id())
    local = docs.select("*", F.spark_partition_id().alias("_sh_part"), hashed.alias("_sh_hash")).sortWithinPartitions("_sh_hash")
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(local.select("*", number.alias("_sh_at")), "permuted")
    sizes = stored(rows.groupBy(F.col("_sh_part").alias("part")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    total, parts = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    want = [total // shards + (s < total % shards) for s in range(shards)]
    counts = stored(matrix(sizes, want, seed).withColumnRenamed("part", "_sh_part"), "matrix")
    if parts * (shards * 8 + 64) <= BROADCAST_BYTES:
        counts = F.broadcast(counts)

    # the shard is the number of shards whose rows of this partition all come before
    ends = F.aggregate(
        "counts",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("shard")),
        lambda a, c: F.struct(
            (a["sum"] + c).alias("sum"), (a["shard"] + F.when(F.col("_sh_at") >= a["sum"] + c, 1).otherwise(0)).alias("shard")
        ),
        lambda a: a["shard"],
    )
    cells = max(1, -(-total // (shards * CELL_ROWS)))
    again = F.xxhash64(F.lit(seed + 1), "_sh_part", "_sh_at")
    placed = rows.join(counts, "_sh_part").withColumns({"shard": ends.cast("int"), "_sh_order": again})
    placed = placed.withColumn("_sh_cell", F.pmod(F.shiftrightunsigned("_sh_order", 20), F.lit(cells)))
    filled = placed.groupBy("shard", "_sh_cell").agg(F.count(F.lit(1)).alias("_sh_n"))
    before = Window.partitionBy("shard").orderBy("_sh_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = filled.select(
        F.col("shard").alias("_sh_shard"), F.col("_sh_cell").alias("_sh_c"), F.coalesce(F.sum("_sh_n").over(before), F.lit(0)).alias("_sh_first")
    )
    within = Window.partitionBy("shard", "_sh_cell").orderBy("_sh_order", "_sh_part", "_sh_at")
    numbered = placed.drop("counts").withColumn("_sh_rank", F.row_number().over(within) - 1)
    out = numbered.join(firsts, (F.col("shard") == F.col("_sh_shard")) & (F.col("_sh_cell") == F.col("_sh_c")))
    return out.select(*docs.columns, "shard", (F.col("_sh_first") + F.col("_sh_rank")).cast("long").alias("slot"))


def draw_test(spark: SparkSession, total: int, marked: int, drawn: int, times: int, seed: int) -> DataFrame:
    """Many hypergeometric draws, for checks of their distribution."""
    t, m, k = (F.lit(v).cast("long") for v in (total, marked, drawn))
    return spark.range(times).select(hypergeometric(t, m, k, uniform(F.lit(seed), "id")).alias("x"))
