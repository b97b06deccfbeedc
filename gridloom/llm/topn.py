"""Top N items within every group by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.skew import lookup_join

STATE_ROWS = 262_144


def _best(table: pa.Table, n: int) -> tuple[pa.Table, np.ndarray]:
    """The n best distinct items of each group, in order, and their ranks from 0."""
    table = table.group_by(["g", "i"], use_threads=False).aggregate([("s", "min"), ("c", "sum")]).rename_columns(["g", "i", "s", "c"])
    table = table.sort_by([("g", "ascending"), ("s", "ascending"), ("i", "ascending")])
    size = len(table)
    g = table["g"].combine_chunks()
    new = np.ones(size, bool)
    if size > 1:
        new[1:] = pc.not_equal(g.slice(1), g.slice(0, size - 1)).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    rank = np.arange(size) - np.repeat(first, np.diff(np.r_[first, size]))
    # The rows a group has had go with its best item, so that they aren't lost with the items dropped.
    rows = np.add.reduceat(table["c"].to_numpy(), first) if size else np.zeros(0, np.int64)
    c = np.zeros(size, np.int64)
    c[first] = rows
    table = table.set_column(3, "c", pa.array(c))
    keep = rank < n
    return table.filter(pa.array(keep)), rank[keep]


def _bounds(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, size = None, [], 0
        schema = None

        def fold() -> None:
            nonlocal state, held, size
            parts = [pa.Table.from_batches(held)] if held else []
            if state is not None:
                parts.append(state.cast(parts[0].schema) if parts else state)
            state, _ = _best(pa.concat_tables(parts), n)
            held, size = [], 0

        for batch in batches:
            schema = batch.schema
            held.append(batch.append_column("c", pa.array(np.ones(len(batch), np.int64))))
            size += len(batch)
            if size >= max(STATE_ROWS, len(state) if state is not None else 0):
                fold()
        if schema is None:
            return
        fold()
        table, rank = _best(state, n)
        first = np.flatnonzero(rank == 0)
        last = np.flatnonzero(rank == n - 1)
        group = np.searchsorted(first, last, "right") - 1
        rows = table["c"].to_numpy()[first][group]
        got = table.take(pa.array(last))
        yield from pa.table({"g": got["g"], "s": got["s"], "i": got["i"], "c": pa.array(rows)}).to_batches()

    return run


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The ``n`` items with the highest score in each group: group, item, score, rank (from 1).

    An item counts once per group, with its highest score; equal scores rank
    by item, ascending by bytes.

    Method: each partition's n-th best item of a group bounds the group's
    n-th best from below, so the best such bound is joined to the rows, rows
    below it are dropped, and the survivors - at most n distinct items for each
    partition - are ranked. Bounds are pairs of score and item, so ties at
    a bound are cut too. The heaviest groups' bounds are broadcast (a fixed
    number of them) and cut their rows before any shuffle. A group with
    fewer than n items in every partition has no bound and keeps its few rows.

    Defined cases: rows with a NULL group or item or a NULL or NaN score don't
    count; infinity ranks first, minus infinity last; -0.0 equals 0.0; groups
    with fewer items give all of them. Empty input gives an empty result.
    Other columns, of whatever name, are ignored.
    """
    kinds = dict(rows.dtypes)
    src = rows.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), F.col(f"`{score}`").cast("double").alias("x"))
    src = src.filter("g is not null and i is not null and x is not null and not isnan(x)").select("g", "i", (F.lit(0.0) - F.col("x")).alias("s"))
    local = src.mapInArrow(_bounds(n), f"g {kinds[group]}, s double, i {kinds[item]}, c bigint")
    bounds = local.filter("g is not null").groupBy("g")  # said here, so that both reads of the bounds are one exchange
    bounds = bounds.agg(F.min(F.struct("s", "i")).alias("b"), F.sum("c").alias("c"))
    kept = lookup_join(src, bounds, ["g"], ["b"], "c", keep=lambda v: v["b"].isNull() | (F.struct("s", "i") <= v["b"]))
    best = kept.groupBy("g", "i").agg(F.min("s").alias("s"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy("s", "i"))).filter(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), (F.lit(0.0) - F.col("s")).alias(score), "rank")
