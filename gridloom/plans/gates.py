"""Gates: all checks of a table in one aggregate; a sink that writes only if every gate holds."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(AssertionError):
    """A check failed; nothing was written."""


@dataclass(frozen=True)
class Gate:
    """name, an aggregate, and the closed range its value must lie in."""

    name: str
    value: Column
    low: float | None = None
    high: float | None = None

    def holds(self, v) -> bool:
        return v is not None and (self.low is None or v >= self.low) and (self.high is None or v <= self.high)


def unique_key(keys: list[str]) -> Gate:
    return Gate("unique key", F.count(F.lit(1)) - F.count_distinct(F.struct(*keys)), 0, 0)


def coverage(x: str, least: float) -> Gate:
    return Gate(f"coverage of {x}", F.avg(F.when(F.col(x).isNotNull(), 1.0).otherwise(0.0)), least)


def finite(x: str) -> Gate:
    return Gate(f"{x} is finite", F.count(F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 1)), 0, 0)


def not_constant(x: str) -> Gate:
    return Gate(f"{x} varies", F.count_distinct(x), 2)


def identity(name: str, a: Column, b: Column, tol: float) -> Gate:
    return Gate(name, F.coalesce(F.max(F.abs(a - b)), F.lit(0.0)), None, tol)


def evaluate(df: DataFrame, gates: list[Gate]) -> dict[str, tuple[float | None, bool]]:
    """Value and verdict of each gate, from one pass over the table."""
    row = df.agg(*[g.value.alias(f"g{i}") for i, g in enumerate(gates)]).first()
    return {g.name: (row[i], g.holds(row[i])) for i, g in enumerate(gates)}


def gated_write(df: DataFrame, path: str, gates: list[Gate], manifest: dict | None = None, sort: list[str] | None = None) -> dict:
    """Write parquet (zstd) under ``path`` and a manifest beside it, if all gates hold on the rows that are written.

    The table is staged next to its place, checked as staged, and renamed: a
    reader never sees a table that failed, nor part of one.
    """
    spark = df.sparkSession
    stage = f"{path}.{uuid.uuid4().hex}.stage"
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(stage)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    got = evaluate(spark.read.parquet(stage), gates)
    failed = {k: v for k, (v, ok) in got.items() if not ok}
    if failed:
        fs.delete(hadoop(stage), True)
        raise GateError(f"{path}: {failed}")
    fs.delete(hadoop(path), True)
    fs.rename(hadoop(stage), hadoop(path))
    note = {**(manifest or {}), "gates": {k: v for k, (v, _) in got.items()}}
    out = fs.create(hadoop(f"{path}.json"), True)
    out.write(bytearray(json.dumps(note, sort_keys=True, default=str).encode()))
    out.close()
    return note


def truncation_differences(full: DataFrame, cut: DataFrame, keys: list[str], columns: list[str], cutoff: int, t: str, tol: float = 1e-9) -> DataFrame:
    """Rows before the cutoff that a build on cut data makes differently: a look-ahead shows here. NULL patterns must be equal."""
    a = full.filter(F.col(t) < cutoff).select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = cut.filter(F.col(t) < cutoff).select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns])
    j = a.join(b, keys, "full_outer")
    bad = F.lit(False)
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        bad = bad | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tol * F.greatest(F.abs(x), F.lit(1.0)), F.lit(False))
    return j.filter(bad)
