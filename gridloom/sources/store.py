"""Sources and sinks: dataset catalogue, archive ingest, pruned scans, manifest and universe."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the public archive's files.
KLINES = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume", "ignore")
FUNDING = ("calc_time", "funding_interval_hours", "last_funding_rate")
METRICS = ("create_time", "symbol", "sum_open_interest", "sum_open_interest_value", "count_toptrader_long_short_ratio", "sum_toptrader_long_short_ratio", "count_long_short_ratio", "sum_taker_long_short_vol_ratio")
LIQUIDATIONS = ("time", "side", "order_type", "time_in_force", "original_quantity", "price", "average_price", "order_status", "last_fill_quantity", "accumulated_fill_quantity")
TRADES = ("agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "transact_time", "is_buyer_maker")
TEXT = {"symbol", "side", "order_type", "time_in_force", "order_status", "is_buyer_maker", "is_best_match"}
WHOLE = {"open_time", "close_time", "calc_time", "create_time", "time", "transact_time", "trade_count", "funding_interval_hours", "agg_trade_id", "first_trade_id", "last_trade_id"}


@dataclass(frozen=True)
class Dataset:
    """A dataset of the archive: where it lies, how it is cut, its columns and its time column (the key of its rows)."""

    name: str
    market: str
    kind: str
    interval: str
    granularities: tuple[str, ...]
    columns: tuple[str, ...]
    time: str

    def schema(self) -> T.StructType:
        kind = lambda c: T.StringType() if c in TEXT else T.LongType() if c in WHOLE else T.DoubleType()
        return T.StructType([T.StructField(c, kind(c)) for c in self.columns if c != "ignore"])

    def prefix(self, granularity: str, symbol: str) -> str:
        parts = [self.market, granularity, self.kind, symbol, self.interval]
        return "/".join(p for p in parts if p) + "/"


# The archive's datasets, where they lie below its root (less the leading data/), and its names for columns.
_BOTH = ("monthly", "daily")
CATALOGUE = {
    d.name: d
    for d in (
        Dataset("spot_klines", "spot", "klines", "1m", _BOTH, KLINES, "open_time"),
        Dataset("perp_klines", "futures/um", "klines", "1m", _BOTH, KLINES, "open_time"),
        Dataset("premium_index", "futures/um", "premiumIndexKlines", "1m", _BOTH, KLINES, "open_time"),
        Dataset("um_delivery_klines", "futures/um", "klines", "1m", _BOTH, KLINES, "open_time"),
        Dataset("cm_delivery_klines", "futures/cm", "klines", "1m", _BOTH, KLINES, "open_time"),
        Dataset("funding", "futures/um", "fundingRate", "", ("monthly",), FUNDING, "calc_time"),
        Dataset("metrics", "futures/um", "metrics", "", ("daily",), METRICS, "create_time"),
        Dataset("liquidations", "futures/um", "liquidationSnapshot", "", ("daily",), LIQUIDATIONS, "time"),
        Dataset("spot_aggtrades", "spot", "aggTrades", "", _BOTH, (*TRADES, "is_best_match"), "transact_time"),
        Dataset("perp_aggtrades", "futures/um", "aggTrades", "", _BOTH, TRADES, "transact_time"),
    )
}
DEFAULT_SET = ("spot_klines", "perp_klines", "premium_index", "funding", "metrics")
ALIASES = {"count": "trade_count", "taker_buy_volume": "taker_buy_base_volume"}


def epoch_ms(x: Column) -> Column:
    """Text to epoch ms, row by row: a number above 1e14 is in microseconds; else a date-time in UTC; else NULL."""
    n = F.try_to_number(F.trim(x), F.lit("9999999999999999999")).cast("bigint")
    return F.coalesce(F.when(n > 100_000_000_000_000, F.floor(n / F.lit(1000)).cast("bigint")).otherwise(n), F.unix_millis(F.try_to_timestamp(F.trim(x))))


def typed(raw: DataFrame, spec: Dataset) -> DataFrame:
    """Text columns of an archive file to the dataset's types; columns the dataset lacks are dropped, missing ones NULL."""
    names = {ALIASES.get(c, c): c for c in raw.columns}
    out = []
    for f in spec.schema():
        x = F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None).cast("string")
        if f.name == spec.time or f.name in ("open_time", "close_time"):
            x = epoch_ms(x)
        out.append((x if f.dataType == T.StringType() else x.try_cast(f.dataType)).alias(f.name))
    return raw.select(*out, *[c for c in raw.columns if c.startswith("src_")])


def scan_zips(spark: SparkSession, glob: str, spec: Dataset) -> DataFrame:
    """CSV-in-zip archives as typed rows with ``src_path``. A header line is told by its first field not being a number or time."""
    cols = list(spec.columns)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            first = f.readline().decode("utf-8-sig").strip().split(",")
                        head = not re.match(r"^\s*\d", first[0])
                        order = [ALIASES.get(x.strip(), x.strip()) for x in first] if head else [*cols, *[f"more_{i}" for i in range(len(cols), len(first))]][: len(first)]
                        if first == [""]:
                            continue
                        with z.open(name) as f:
                            options = csv.ReadOptions(column_names=order, skip_rows=int(head), block_size=8 << 20)
                            for part in csv.open_csv(f, options, convert_options=csv.ConvertOptions(column_types={c: pa.string() for c in order}, strings_can_be_null=False)):
                                got = dict(zip(part.schema.names, part.columns))
                                data = [got.get(c, pa.nulls(len(part), pa.string())) for c in cols]
                                yield pa.RecordBatch.from_arrays([*data, pa.array([path] * len(part), pa.string())], [*cols, "src_path"])

    kinds = ", ".join(f"`{c}` string" for c in [*cols, "src_path"])
    return typed(files.mapInArrow(read, kinds), spec)


def write_partitioned(df: DataFrame, path: str, time: str, symbol: str = "symbol") -> None:
    """zstd parquet by symbol and month, sorted by time within its files.

    The shuffle is a rebalance: adaptive execution cuts a large symbol and month into several tasks and joins small ones.
    """
    month = F.date_format(F.timestamp_millis(time), "yyyy-MM")
    df = df.withColumn("month", month).hint("rebalance", symbol, "month").sortWithinPartitions(symbol, "month", time)
    df.write.mode("overwrite").partitionBy(symbol, "month").option("compression", "zstd").parquet(path)


def scan(spark: SparkSession, path: str, time: str, start: int | None = None, end: int | None = None, columns: list[str] | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Rows of [start, end) with partition pruning by symbol and month and a time filter that reaches the files' statistics.

    Files without a month are always read: what has no period can't be left out by it.
    """
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(*symbols))
    months = F.lit(True)
    if start is not None:
        df, months = df.filter(F.col(time) >= start), months & (F.col("month") >= _month(start))
    if end is not None:
        df, months = df.filter(F.col(time) < end), months & (F.col("month") <= _month(end - 1))
    df = df.filter(months | F.col("month").isNull())
    return df.select(*columns) if columns else df


def _month(ms: int) -> str:
    import datetime as dt

    return dt.datetime.fromtimestamp(ms / 1000, dt.UTC).strftime("%Y-%m")


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: that with the largest ``order``. An aggregate, so copies combine on the map side."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("__v"))
    return best.select(*key, *[F.col(f"__v.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def last_instant(df: DataFrame, by: list[str], time: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max(time).alias("last"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Keys under a folder: key (path below root), size. The offline form of a paginated remote listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.select(F.regexp_replace("path", f"^(file:)?/*{re.escape(root.strip('/'))}/", "").alias("key"), F.col("length").alias("size"))


def verify_checksums(spark: SparkSession, glob: str, published: DataFrame) -> DataFrame:
    """path, sha256, ok: the files' hashes against published (path, sha256) ones; ok is NULL where none is published."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob).select("path", F.sha2("content", 256).alias("sha256"))
    return got.join(published.select("path", F.lower("sha256").alias("__want")), "path", "left").select("path", "sha256", (F.col("sha256") == F.col("__want")).alias("ok"))


def plan_downloads(wanted: DataFrame, have: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keys to fetch: wanted (key, dataset, symbol, period, granularity) less those had.

    Monthly files come first; a daily file is wanted only if its month lies
    beyond the last monthly one of its dataset and symbol. Bounds are months, inclusive.
    """
    w = wanted.withColumn("__m", F.substring("period", 1, 7))
    if start:
        w = w.filter(F.col("__m") >= start)
    if end:
        w = w.filter(F.col("__m") <= end)
    last = F.max(F.when(F.col("granularity") == "monthly", F.col("__m"))).over(W.partitionBy("dataset", "symbol"))
    w = w.withColumn("__last", last).filter((F.col("granularity") == "monthly") | F.col("__last").isNull() | (F.col("__m") > F.col("__last")))
    return w.drop("__m", "__last").join(have.select("key"), "key", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Union of two logs with the newest record of each key."""
    return keep_last(old.unionByName(new), [key], [stamp])


def done_keys(manifest: DataFrame) -> DataFrame:
    return manifest.filter("status = 'converted'").select("key")


def summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("dataset", "status").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).orderBy("dataset", "status")


def dated_contracts(df: DataFrame, symbol: str, base: str) -> DataFrame:
    """Contracts BASE_yymmdd with their expiry (epoch ms)."""
    stem, tail = F.regexp_extract(symbol, rf"^({re.escape(base)})_(\d{{6}})$", 1), F.regexp_extract(symbol, r"_(\d{6})$", 1)
    return df.filter(stem != "").withColumn("expiry", F.unix_millis(F.to_timestamp(F.concat(F.lit("20"), tail), "yyyyMMdd")))


def universe(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a text file: one to a line, '#' starts a comment, a byte-order mark is ignored."""
    line = F.upper(F.trim(F.regexp_replace(F.regexp_replace("value", "﻿", ""), "#.*", "")))
    return spark.read.text(path).select(line.alias("symbol")).filter("symbol <> ''").distinct()


def copy_filtered(spark: SparkSession, src: str, dst: str, predicate: Column) -> None:
    """Copy the rows that satisfy a predicate, which reaches the scan."""
    spark.read.parquet(src).filter(predicate).write.mode("overwrite").option("compression", "zstd").parquet(dst)
