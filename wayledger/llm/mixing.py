"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is the size it should have over the size it has.  Each document draws its number of copies from the
Poisson distribution of its source's rate, by inversion of a number between 0 and 1 that a hash of seed and document gives, so the draw
is the same wherever and however often it is computed.  The copies are exploded and shuffled globally: partitioned by a hash of seed,
document and copy, and ordered by it within the partition.

A source's distribution function is an array made once for each source.  Sizes are summed before the shuffle; the table of sources is
broadcast up to ``BROADCAST_CELLS`` array cells and else joined, with documents salted so that a hot source is shared by ``SALT`` tasks.
Only DataFrame functions are used.

Defined results: a null source is a source of its own; a document without an id draws by its text; null text is empty; the size of a
document is its characters plus 1; rows equal in id (and, without an id, in text) draw the same number; sources without a weight, or with
one that is null or not positive, get no copies; an empty table gives an empty result; further columns pass through, but names that
begin with ``_mx_`` are taken and ``replica``, ``n_copies`` and ``shuffle_key`` are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_CELLS = 1 << 20
SALT = 64
#: Standard deviations around the rate outside which a double sees no probability.
REACH = 10
ADDED = ("replica", "n_copies", "shuffle_key")


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size): characters plus 1 for each document."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit(""))) + 1).alias("size"))


def tempered_weights(sizes: DataFrame, exponent: float) -> DataFrame:
    """(source, weight): sizes to a power below 1 lift small sources."""
    return sizes.select("source", F.pow(F.col("size").cast("double"), F.lit(exponent)).alias("weight"))


def distributions(sizes: DataFrame, weights: DataFrame, epochs: float) -> DataFrame:
    """(source, cdf, low): P(copies <= low + i) for i = 0, 1, ... of each source with a positive weight.

    The shares of the weights, among sources that have documents, are shares of ``epochs`` times the size of all sources."""
    sound = weights.where("weight > 0").select("source", "weight")
    joined = sizes.join(sound, sizes["source"].eqNullSafe(sound["source"])).select(sizes["source"], "size", "weight")
    weight_sum, size_sum = joined.agg(F.sum("weight")).first()[0], sizes.agg(F.sum("size")).first()[0]
    share = F.col("weight") / F.lit(float(weight_sum or 1))
    rates = joined.select("source", (F.lit(epochs * float(size_sum or 0)) * share / F.col("size")).alias("rate"))
    reach = F.lit(REACH) * F.sqrt("rate") + 30
    values = F.sequence(F.greatest(F.lit(0), F.floor(F.col("rate") - reach)).cast("long"), F.ceil(F.col("rate") + reach).cast("long"))
    cells = rates.select("source", "rate", F.explode(values).alias("k"))
    # weights relative to the least value follow from sums of logarithms of neighbours' ratios
    by = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    least = F.min("k").over(Window.partitionBy("source"))
    step = F.when(F.col("k") == least, F.lit(0.0)).otherwise(F.log(F.col("rate") / F.col("k")))
    cells = cells.withColumn("step", step).withColumn("log", F.sum("step").over(by))
    most = F.max("log").over(Window.partitionBy("source"))
    cells = cells.withColumn("p", F.exp(F.col("log") - most))
    cells = cells.withColumn("sum", F.sum("p").over(by)).withColumn("whole", F.sum("p").over(Window.partitionBy("source")))
    grouped = cells.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("k", (F.col("sum") / F.col("whole")).alias("c")))).alias("cdf"), F.min("k").alias("low")
    )
    return grouped.select("source", F.col("cdf.c").alias("cdf"), "low")


def mix(
    docs: DataFrame,
    weights: DataFrame,
    epochs: float = 1.0,
    seed: int = 29,
    id_column: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The copies of ``docs`` in shuffled order, with replica (from 0), n_copies and shuffle_key."""
    docs = docs.drop(*ADDED)
    table = distributions(source_sizes(docs, source, text), weights, epochs)
    table = table.select(F.col("source").alias("_mx_source"), F.col("cdf").alias("_mx_cdf"), F.col("low").alias("_mx_low"))
    name = F.coalesce(F.col(id_column).cast("string"), F.col(text), F.lit(""))
    rows = docs.withColumn("_mx_name", name)
    if _few(table):
        joined = rows.join(F.broadcast(table), rows[source].eqNullSafe(F.col("_mx_source")))
    else:
        salted = table.withColumn("_mx_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("_mx_own", F.pmod(F.xxhash64("_mx_name"), F.lit(SALT)).cast("int"))
        joined = rows.join(salted, rows[source].eqNullSafe(F.col("_mx_source")) & (F.col("_mx_own") == F.col("_mx_salt")))
    drawn = unit(F.lit(str(seed)), F.col("_mx_name"))
    joined = joined.withColumn("_mx_u", drawn)
    count = F.col("_mx_low") + F.size(F.filter("_mx_cdf", lambda c: c <= F.col("_mx_u")))
    copies = joined.withColumn("n_copies", count.cast("long")).where("n_copies > 0")
    copies = copies.withColumn("replica", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed + 1)), "_mx_name", "replica")))
    out = copies.select(*docs.columns, *ADDED)
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def _few(table: DataFrame) -> bool:
    cells = table.agg(F.coalesce(F.sum(F.size("_mx_cdf")), F.lit(0))).first()[0]
    return cells <= BROADCAST_CELLS
