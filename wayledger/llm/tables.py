"""Shipping the package to workers, intermediate tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that the driver and all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers wherever they run: once for each context, its sources go along as a zip."""
    context = spark.sparkContext
    if not getattr(context, "_wayledger_shipped", False):
        package = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="run-")) / "wayledger-sources.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(path))
        context._wayledger_shipped = True
    return spark


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, which outlive a task: its free memory goes back at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, without lineage, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of a finished query while this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``stored`` in small space: compressed well, and the shuffle files behind it are removed once it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled_at = path
    return table


def removed(table: DataFrame) -> None:
    """Delete what ``settled`` wrote, once everything made from it is written too; ``table`` cannot be read again."""
    session = table.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(table._settled_at)
    path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst: long); component is the smallest node reachable.

    Alternating large-star and small-star steps: each node hands its larger neighbours, then its smaller ones, to the smallest.
    Minima are combined before the shuffle, so a hot node costs a join that adaptive execution can split.  Every round is
    written, the rounds grow with the logarithm of the longest path, and no list of neighbours is collected."""
    edges = stored(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "edges",
    )
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
