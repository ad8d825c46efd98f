"""Readers and sinks: trades, klines, order books, keyed series, archives, incremental ingest."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_to_timestamp, safe_ratio, text_boolean

TRADES = "id long, price double, qty double, quote_qty double, time long, is_buyer_maker string"
LIVE_TRADES = "timestamp_ms long, price double, quantity double, is_buyer_maker string"
KLINES = "open_time string, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trade_count long, taker_buy_volume double, taker_buy_quote_volume double, ignore string"


def trades(spark: SparkSession, path: str) -> DataFrame:
    """Historical trades with a header; rows without a price are dropped."""
    raw = spark.read.schema(TRADES).option("header", True).csv(path)
    return raw.filter("price > 0").select("id", F.timestamp_millis("time").cast("timestamp_ntz").alias("ts"), "price", "qty", "quote_qty", text_boolean(F.col("is_buyer_maker")).alias("is_buyer_maker"))


def live_trades(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Collected trades, as a table or as a stream of files."""
    raw = (spark.readStream if stream else spark.read).schema(LIVE_TRADES).option("header", True).csv(path)
    return raw.filter("price > 0").select(F.timestamp_millis("timestamp_ms").cast("timestamp_ntz").alias("ts"), "price", F.col("quantity").alias("qty"), text_boolean(F.col("is_buyer_maker")).alias("is_buyer_maker"))


def klines(spark: SparkSession, path: str) -> DataFrame:
    """Minute bars with or without a header: rows whose first cell is not a number are headers."""
    raw = spark.read.schema(KLINES).csv(path).filter(F.col("open_time").rlike("^[0-9]+$"))
    ratio = safe_ratio(2 * F.col("taker_buy_volume") - F.col("volume"), F.col("volume"))
    return raw.select(
        epoch_to_timestamp(F.col("open_time").cast("long")).cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", "quote_volume", "trade_count",
        safe_ratio(F.col("volume"), F.col("trade_count")).alias("avg_trade_size"), ratio.alias("trade_imbalance"),
    )


def order_book(spark: SparkSession, path: str, levels: int = 20, stream: bool = False) -> DataFrame:
    """Snapshots: ts, bids and asks as arrays of (price, size); blank levels are left out."""
    names = [f"{side}_{x}{k}" for side in ("bid", "ask") for k in range(1, levels + 1) for x in "pq"]
    schema = "timestamp_ms long, " + ", ".join(f"{n} double" for n in names)
    raw = (spark.readStream if stream else spark.read).schema(schema).option("header", True).csv(path)

    def side(name: str) -> Column:
        every = F.array(*[F.struct(F.col(f"{name}_p{k}").alias("price"), F.col(f"{name}_q{k}").alias("size")) for k in range(1, levels + 1)])
        return F.filter(every, lambda x: x["price"].isNotNull())

    return raw.select(F.timestamp_millis("timestamp_ms").cast("timestamp_ntz").alias("ts"), side("bid").alias("bids"), side("ask").alias("asks"))


def dated_values(spark: SparkSession, path: str, value: str) -> DataFrame:
    """d, value from a two-column CSV in which a dot means missing."""
    raw = spark.read.schema("d date, v string").option("header", True).csv(path)
    return raw.select("d", F.col("v").try_cast("double").alias(value)).na.drop()


def months(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Bars stored by a month partition (YYYYMM): a filter on the partition column prunes folders."""
    return spark.read.parquet(path).filter(F.col("month").between(start, end))


def zipped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the first CSV in each archive; broken archives give none. Archives are spread over tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        name = next(n for n in z.namelist() if n.endswith(".csv"))
                        lines = z.read(name).decode("utf-8", "replace").splitlines()
                except (zipfile.BadZipFile, StopIteration):
                    continue
                yield pd.DataFrame({"line": lines})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "line string")
    return lines.select(F.from_csv("line", schema).alias("r")).select("r.*")


def resolve_column(df: DataFrame, *patterns: str) -> str:
    """The first column whose name contains one of the patterns, tried in order, without case."""
    for p in patterns:
        for c in df.columns:
            if p.lower() in c.lower():
                return c
    raise KeyError(patterns)


def missing_days(wanted: DataFrame, have_months: DataFrame, have_days: DataFrame, end: str) -> DataFrame:
    """Months wanted (month, first of) -> days to fetch: those of months not had as a whole, up to end, not had singly."""
    lacking = wanted.join(have_months, "month", "left_anti")
    days = lacking.select(F.explode(F.sequence("month", F.least(F.last_day("month"), F.to_date(F.lit(end))), F.expr("INTERVAL 1 DAY"))).alias("d"))
    return days.filter(F.col("d") <= end).join(have_days, "d", "left_anti")


def ingest(new: DataFrame, path: str, part: str = "month") -> list[str]:
    """Add the partitions that are not there yet, each as a whole, and return their folders' names; running it again changes nothing.

    Rows are written into a hidden folder beside the partitions, and each partition is committed by renaming its folder, which
    fails where the partition exists. Of several runs at once the first to commit a partition wins it; a run that dies leaves
    whole partitions and a hidden folder, which no reader sees.
    """
    spark = new.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    home = fs_path(path)
    fs = home.getFileSystem(conf)
    home = fs.makeQualified(home)
    names = lambda at: [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith(f"{part}=")] if fs.exists(at) else []
    if names(home):
        there = spark.read.parquet(path).select(part).distinct()
        new = new.join(there.select(F.col(part).cast(new.schema[part].dataType).alias("__there")), F.col(part).eqNullSafe(F.col("__there")), "left_anti")
    fs.mkdirs(home)
    staging = fs_path(home, f"_staging-{uuid.uuid4().hex}")
    committed = []
    try:
        new.write.partitionBy(part).parquet(staging.toString())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(home.toUri(), conf)
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for name in names(staging):
            try:
                context.rename(fs_path(staging, name), fs_path(home, name), none)
                committed.append(name)
            except Py4JJavaError as e:
                if not fs.exists(fs_path(home, name)):
                    raise e
    finally:
        fs.delete(staging, True)
    return committed


def json_arrays(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Documents of the form [[ts, o, h, l, c], ...] -> rows with the named fields; the first is an epoch."""
    rows = df.select(F.explode(F.from_json(column, "array<array<double>>")).alias("r"))
    return rows.select(epoch_to_timestamp(F.get("r", 0)).cast("timestamp_ntz").alias("ts"), *[F.get("r", k).alias(f) for k, f in enumerate(fields, 1)])


def summary_json(df: DataFrame) -> DataFrame:
    """One JSON document a row, for a text sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Flat rows as CSV with a header; nested columns are written as JSON."""
    plain = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*plain).write.option("header", True).csv(path)


def nested(parts: dict) -> Column:
    """A struct of columns and further dicts: the shape of a nested document."""
    return F.struct(*[(nested(c) if isinstance(c, dict) else c).alias(name) for name, c in parts.items()])


def write_json(df: DataFrame, path: str) -> None:
    """A JSON document a line, nested columns as they are; nulls are written, so that every document has every field."""
    df.write.option("ignoreNullFields", False).json(path)
