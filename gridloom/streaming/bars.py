"""Structured Streaming twins of the bar operators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, key: str, ts: str, value: str, width: str = "8 hours", late: str = "5 minutes") -> DataFrame:
    """Sum, count and last value per key and epoch-aligned window; rows later than the watermark are left out."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(key))
    out = g.agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.max_by(value, ts).alias("last"))
    return out.select(key, F.col("w.end").alias("bar"), "total", "n", "last")


def sliding(events: DataFrame, key: str, ts: str, value: str, width: str = "24 hours", step: str = "8 hours", late: str = "5 minutes") -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w"), F.col(key))
    return g.agg(F.sum(value).alias("total"), F.count(value).alias("n")).select(key, F.col("w.end").alias("bar"), "total", "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key))
    return g.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def held_band(targets: DataFrame, key: str, value: str, band: float) -> DataFrame:
    """No-trade band over a stream: per key the held value survives between batches; rows come in order of ``ts``."""
    schema = f"{key} string, ts timestamp, held double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        for pdf in batches:
            out = []
            for v in (pdf := pdf.sort_values("ts"))[value]:
                held = v if held is None or abs(v - held) > band else held
                out.append(held)
            yield pd.DataFrame({key: k[0], "ts": pdf["ts"], "held": out})
        if held is not None:
            state.update((held,))

    return targets.groupBy(key).applyInPandasWithState(step, schema, "held double", "append", "NoTimeout")
