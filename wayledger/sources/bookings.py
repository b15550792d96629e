"""Booking tables: raw text in, clean Parquet out, order lists as CSV."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.functions.calendar import month_text
from wayledger.operators.periods import MONTH_PARTITION

# Column names of the raw file, of the exported order list, and the texts read as missing.
RENAMES = {
    "booking status": "booking_status",
    "bnb city": "bnb_city",
    "column switch 1": "affiliate_id",
    "column switch 2": "coupon",
    "column switch 3": "column_switch_3",
}
EXPORT_NAMES = {
    "order_id": "訂單編號", "order_date": "下單日期", "product_line": "產品線", "bnb_name": "商品名稱",
    "bnb_city": "城市", "booking_status": "狀態", "affiliate_id": "行銷管道", "check_in": "入住/出發",
    "check_out": "退房/結束", "nights": "晚數", "twd_amount": "金額",
}
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
RAW_COLUMNS = [
    "order_date", "order_id", "booking_status", "platform", "bnb_city", "bnb_id", "bnb_name", "bnb_type",
    "check_in", "check_out", "tags", "affiliate_id", "coupon", "column_switch_3",
    "guests", "adult", "child", "nights", "rooms", "twd_amount",
]


#: Column for lines that do not fit their header, folders of the stored table, and the batch name of a full load.
BROKEN, BATCH_PARTITION, FULL_LOAD, STAGING = "_broken_line", "batch", "full", "_staged"
#: The folder of bookings without a readable date, as Spark names it.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
HEADER_THREADS = 16


class SourceTableError(Exception):
    """The source has no usable booking table; the message can be shown to a user."""


def check_header(header: Sequence[str], where: str) -> None:
    """A readable error when a header is broken or lacks a column."""
    broken = [c for c in header if "#REF!" in c]
    if broken or "order_date" not in header:
        raise SourceTableError(
            f"bookings source has no valid header (columns: {list(header[:5])}, in {where}): "
            + ("it holds broken references" if broken else "order_date is missing")
        )
    missing = [c for c in RAW_COLUMNS if c not in (RENAMES.get(name, name) for name in header)]
    if missing:
        raise SourceTableError(f"bookings source lacks the columns {missing} (in {where})")


def _jvm_path(spark: SparkSession, file: str):
    """Hadoop path and file system of a file that Spark listed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names of one file, from its first line alone; empty for a file without one."""
    path, store = _jvm_path(spark, file)
    stream = store.open(path)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(store.getConf()).getCodec(path)
    plain = codec.createInputStream(stream) if codec is not None else stream
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(plain, "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    if not line:
        return ()
    if line.count('"') % 2:
        raise SourceTableError(f"the header of {path.toString()} holds a line break")
    names: list[str] = []
    for place, name in enumerate(next(csv.reader([line.removeprefix("\ufeff")]))):
        name = name or f"Unnamed: {place}"
        again = sum(n == name or n.startswith(f"{name}.") for n in names)
        names.append(f"{name}.{again}" if name in names else name)
    return tuple(names)


def read_bookings_csv(
    spark: SparkSession, path: str | Sequence[str], line_breaks: str = "refuse", observation: Observation | None = None
) -> DataFrame:
    """Raw bookings of one or many CSV files, every column text, bound by header name in each file.

    The headers are read first, one line a file; files with equal headers make one scan, and the scans are stacked by column name, so
    files may order their columns differently or have further ones.  Files are split into many tasks, for which a booking has to be one
    line.  ``line_breaks`` says what happens to a line that is a piece of a longer row, told by its single quotation mark:

    * ``refuse``: the job fails and shows the line (the default: nothing is lost or shifted unseen);
    * ``count``: such lines, and lines with too few or too many fields, are left out and counted by ``observation`` as ``broken_lines``
      and ``ragged_lines``;
    * ``keep``: line breaks inside quotation marks are read as text, one task for each file.

    Outside ``count`` a line with too few fields is read with its last columns missing.
    """
    if line_breaks not in ("refuse", "count", "keep"):
        raise ValueError(f"line_breaks is refuse, count or keep, not {line_breaks!r}")
    if (line_breaks == "count") != (observation is not None):
        raise ValueError("line_breaks='count' and an observation go together")
    files = spark.read.text(path if isinstance(path, str) else list(path)).inputFiles()
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        headers = list(pool.map(lambda file: _header(spark, file), files))
    same: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers, strict=True):
        if header:
            check_header(header, file)
            same.setdefault(header, []).append(_jvm_path(spark, file)[0].toString())
    tables = [_scan(spark, group, header, line_breaks == "keep") for header, group in same.items()]
    if not tables or all(t.isEmpty() for t in tables):
        raise SourceTableError(f"bookings source has no rows (columns: {list(next(iter(same), ())[:5])})")
    return text_columns(_whole_lines(reduce(DataFrame.unionByName, tables), line_breaks, observation))


def _scan(spark: SparkSession, files: list[str], header: Sequence[str], multi_line: bool) -> DataFrame:
    """Files of one header; a line with another number of fields is also kept as it is in ``BROKEN``."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*header, BROKEN)])
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line)
    reader = reader.option("columnPruning", multi_line)  # a pruned line's fields are not counted
    table = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).csv(files)
    return table.withColumnsRenamed(RENAMES).select(*RAW_COLUMNS, BROKEN)


def _whole_lines(table: DataFrame, line_breaks: str, observation: Observation | None) -> DataFrame:
    line = F.col(BROKEN)
    if line_breaks == "keep":
        return table.drop(BROKEN)
    piece = F.coalesce(F.length(F.regexp_replace(line, '[^"]', "")) % 2 == 1, F.lit(False))
    if line_breaks == "count":
        table = table.observe(
            observation,
            F.count_if(piece).alias("broken_lines"),
            F.count_if(line.isNotNull() & ~piece).alias("ragged_lines"),
            F.count("order_date").alias("dated_lines"),
        )
        return table.filter(line.isNull()).drop(BROKEN)
    # naming a column beside the kept line: Spark refuses to scan for that one alone
    said = F.concat(F.lit("a booking is broken over several lines: "), F.substring(line, 1, 200), F.substring(F.coalesce("order_date", F.lit("")), 1, 0))
    return table.filter(F.when(piece, F.raise_error(said).cast("boolean")).otherwise(True)).drop(BROKEN)


def text_columns(table: DataFrame) -> DataFrame:
    """The raw columns, with every spelling of a missing value read as NULL."""
    return table.select(*[F.when(~F.col(c).isin(MISSING_TEXTS), F.col(c)).alias(c) for c in RAW_COLUMNS])


def write_clean(bookings: DataFrame, path: str, batch: str = FULL_LOAD) -> None:
    """Store clean bookings as Parquet, month folders of batch folders.

    A full load replaces the table.  Any other ``batch`` is added to it, and replaces what an earlier attempt of the same batch left
    behind, so writing a batch twice counts it once.  The rebalance hint lets adaptive execution split a month that holds most rows and
    merge thin ones; sorting by product line inside each file makes row-group statistics selective for line reports.
    """
    dated = bookings.withColumns({MONTH_PARTITION: month_text(F.col("order_date")), BATCH_PARTITION: F.lit(batch)})
    writer = _arranged(dated).write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "static" if batch == FULL_LOAD else "dynamic")
    writer.partitionBy(MONTH_PARTITION, BATCH_PARTITION).parquet(path)


def _arranged(dated: DataFrame) -> DataFrame:
    return dated.hint("rebalance", MONTH_PARTITION).sortWithinPartitions(MONTH_PARTITION, "product_line", "order_date")


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """Stored clean bookings.  Keeps the month column so that period filters can skip folders."""
    return _stored(spark, path).drop(BATCH_PARTITION)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with both folder columns, as text."""
    table = spark.read.parquet(path)
    return table.withColumns({c: F.col(c).cast("string") for c in (MONTH_PARTITION, BATCH_PARTITION)})


def _layout(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(month, batch, file) of every stored file, from the listing alone."""
    files = spark.read.parquet(path).inputFiles()
    return [(*(unquote(part.split("=", 1)[1]) for part in file.split("/")[-3:-1]), file) for file in files]


def edge_months(spark: SparkSession, path: str) -> DataFrame:
    """Stored bookings of the first and of the last month alone, found from the folder names.

    They hold the oldest and the newest order date, so date bounds read two folders whatever the table's size."""
    months = sorted({month for month, _, _ in _layout(spark, path)} - {NO_MONTH})
    return read_clean(spark, path).filter(F.col(MONTH_PARTITION).isin(months[:1] + months[-1:]))


def replace_month(bookings: DataFrame, path: str, month: str) -> None:
    """Put these clean bookings in place of everything stored for one month (``yyyy-MM``), whatever batches it came from.

    They are written beside the table first and moved into place as a whole; bookings of another month are an error."""
    other = month_text(F.col("order_date")) != month
    checked = bookings.filter(
        F.when(F.coalesce(other, F.lit(True)), F.raise_error(F.lit(f"a booking outside {month}")).cast("boolean")).otherwise(True)
    )
    _swap(checked.withColumns({MONTH_PARTITION: F.lit(month), BATCH_PARTITION: F.lit(FULL_LOAD)}), path, month)


def compact(spark: SparkSession, path: str, most_files: int = 16) -> list[str]:
    """Rewrite the months that increments left in more than ``most_files`` files; returns their names.

    The newest batch of each stream stays as it is: it alone may still be written again."""
    finish_swaps(spark, path)
    layout: dict[str, list[tuple[str, str]]] = {}
    for month, batch, file in _layout(spark, path):
        layout.setdefault(month, []).append((batch, file))
    newest: dict[str, str] = {}
    for batch, _ in (pair for pairs in layout.values() for pair in pairs):
        if batch != FULL_LOAD:
            stream = batch.rpartition("-")[0]
            newest[stream] = max(newest.get(stream, batch), batch)
    done = []
    for month, pairs in sorted(layout.items()):
        settled = [pair for pair in pairs if pair[0] not in newest.values()]
        if len(settled) > most_files:
            rows = _stored(spark, path).filter(F.col(MONTH_PARTITION).eqNullSafe(F.lit(None if month == NO_MONTH else month).cast("string")))
            batch = F.col(BATCH_PARTITION)
            merged = rows.withColumn(BATCH_PARTITION, F.when(batch.isin(list(newest.values())), batch).otherwise(FULL_LOAD))
            _swap(merged, path, month)
            done.append(month)
    return done


def _swap(rows: DataFrame, path: str, month: str) -> None:
    """Write one month's rows, batch column included, to a hidden folder and put that in the month's place."""
    spark = rows.sparkSession
    finish_swaps(spark, path)
    folder = f"{MONTH_PARTITION}={month}"
    ready = f"{path}/{STAGING}/{folder}"
    _arranged(rows).drop(MONTH_PARTITION).write.mode("overwrite").partitionBy(BATCH_PARTITION).parquet(ready)
    finish_swaps(spark, path)


def finish_swaps(spark: SparkSession, path: str) -> None:
    """Move complete staged months into place and drop incomplete ones; repeats harmlessly after a crash at any point."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    staging = jvm_path(f"{path}/{STAGING}")
    store = staging.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(staging):
        return
    for found in store.listStatus(staging):
        source = found.getPath()
        if store.exists(jvm_path(source, "_SUCCESS")):
            target = jvm_path(path, source.getName())
            store.delete(target, True)
            if not store.rename(source, target):
                raise OSError(f"could not move {source.toString()} to {target.toString()}")
    store.delete(staging, True)


def write_order_list(listed: DataFrame, path: str) -> None:
    """Order list as UTF-8 CSV with a header per file; dates print without a midnight time."""
    def shown(column: str):
        if dict(listed.dtypes)[column] != "timestamp_ntz":
            return F.col(column)
        day = F.col(column).cast("date")
        return F.when(F.col(column) == day.cast("timestamp_ntz"), day.cast("string")).otherwise(
            F.col(column).cast("string")
        )

    columns = [shown(c).alias(EXPORT_NAMES[c]) for c in EXPORT_NAMES]
    listed.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
