"""Train and holdout splits with purge, leak guard, purged walk-forward folds and combinatorial splits."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


class LeakError(AssertionError):
    """Rows of a holdout where only training rows may be."""


@dataclass(frozen=True)
class Split:
    """Half-open range of instants in epoch ms; an end of None is open."""

    name: str
    start: int
    end: int | None

    def usable_end(self, horizon_hours: float, data_end: int | None = None) -> int | None:
        """The end before which a label of the horizon still closes within the split."""
        ends = [x for x in (self.end, data_end) if x is not None]
        return min(ends) - int(horizon_hours * HOUR_MS) if ends else None


@dataclass(frozen=True)
class SplitScheme:
    """Ordered, disjoint splits; the first is for training. ``sealed`` names splits that may not be read any more."""

    splits: tuple[Split, ...]
    sealed: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        for a, b in zip(self.splits, self.splits[1:]):
            if a.end is None or a.end > b.start:
                raise ValueError(f"{a.name} overlaps {b.name}")

    def get(self, name: str) -> Split:
        for s in self.splits:
            if s.name == name:
                if name in self.sealed:
                    raise LeakError(f"{name} is sealed")
                return s
        raise KeyError(f"no split {name!r}; there are {[s.name for s in self.splits]}")

    def wall(self) -> int:
        """First instant that training may not see."""
        return self.splits[0].end

    def with_wall(self, wall: int) -> SplitScheme:
        """The scheme with another end of training, say for an experiment on less data; the calendar of this one is unchanged.

        The wall may only move back: what lay beyond it stays beyond it.
        """
        first = self.splits[0]
        if first.end is None or not first.start < wall <= first.end:
            raise LeakError(f"a wall at {wall} isn't within {first.name}")
        return SplitScheme((Split(first.name, first.start, wall), *self.splits[1:]), self.sealed)

    def assign(self, t: Column) -> Column:
        """Name of the split of each instant, without purge; NULL outside all."""
        out = F.lit(None).cast("string")
        for s in reversed(self.splits):
            inside = t >= s.start
            if s.end is not None:
                inside = inside & (t < s.end)
            out = F.when(inside, F.lit(s.name)).otherwise(out)
        return out

    def mask(self, t: Column, name: str, horizon_hours: float = 120, purge: bool = True, data_end: int | None = None) -> Column:
        s = self.get(name)
        end = s.usable_end(horizon_hours, data_end) if purge else s.end
        out = t >= s.start
        return out & (t < end) if end is not None else out

    def take(self, df: DataFrame, name: str, t: str, horizon_hours: float = 120, purge: bool = True) -> DataFrame:
        """Rows of a split. An open-ended split ends at the data's last instant, found by one aggregate."""
        if t not in df.columns:
            raise KeyError(f"no time column {t!r}")
        s, end = self.get(name), None
        if purge and s.end is None:
            end = df.agg(F.max(t)).first()[0]
        return df.filter(self.mask(F.col(t), name, horizon_hours, purge, end))

    def assert_train_only(self, df: DataFrame, t: str) -> None:
        """Raise LeakError with the count and earliest instant of rows at or beyond the wall."""
        n, first = df.filter(F.col(t) >= self.wall()).agg(F.count(F.lit(1)), F.min(t)).first()
        if n:
            raise LeakError(f"{n} rows at or beyond {self.wall()}, the earliest at {first}")


def bar_numbers(times: DataFrame, t: str) -> DataFrame:
    """Distinct instants with their number from 0. A list of bars (calendar-sized) is ordered by one task."""
    return times.select(t).distinct().withColumn("n", F.row_number().over(W.orderBy(t)).cast("bigint") - 1)


def walk_forward(times: DataFrame, t: str, first_train: int, test: int, folds: int, purge: int) -> DataFrame:
    """Expanding folds: (fold, role, t). Fold k trains on the bars before its test block but for the last ``purge``."""
    bars = bar_numbers(times, t)
    k = bars.crossJoin(F.broadcast(bars.sparkSession.range(folds).toDF("fold")))
    begin = F.lit(first_train) + F.col("fold") * test
    role = F.when(F.col("n") < begin - purge, "train").when((F.col("n") >= begin) & (F.col("n") < begin + test), "test")
    return k.withColumn("role", role).filter("role is not null").select("fold", "role", t)


def group_edges(n: int, groups: int) -> list[int]:
    return [n * i // groups for i in range(groups + 1)]


def combinatorial(times: DataFrame, t: str, n: int, groups: int = 6, test_groups: int = 2, purge: int = 2, embargo: int = 2) -> DataFrame:
    """Combinatorial purged splits of n bars: (fit, role, grp, t), one fit for each choice of test groups.

    Training bars within ``purge`` of a test block on either side, or within
    ``embargo`` more after it, are left out.
    """
    edges = group_edges(n, groups)
    bars = bar_numbers(times, t)
    grp = F.lit(None).cast("int")
    for g in range(groups):
        grp = F.when((F.col("n") >= edges[g]) & (F.col("n") < edges[g + 1]), g).otherwise(grp)
    bars = bars.withColumn("grp", grp)
    out = None
    for fit, chosen in enumerate(combinations(range(groups), test_groups)):
        is_test, near = F.lit(False), F.lit(False)
        for g in chosen:
            is_test = is_test | (F.col("grp") == g)
            near = near | ((F.col("n") >= edges[g] - purge) & (F.col("n") < edges[g + 1] + purge + embargo))
        role = F.when(is_test, "test").when(~near, "train")
        part = bars.select(F.lit(fit).alias("fit"), role.alias("role"), "grp", t).filter("role is not null")
        out = part if out is None else out.unionByName(part)
    return out


def stitched_paths(groups: int = 6, test_groups: int = 2) -> list[dict[int, int]]:
    """Paths that use each group's test once: path -> {group: fit}."""
    fits: dict[int, list[int]] = {g: [] for g in range(groups)}
    for fit, chosen in enumerate(combinations(range(groups), test_groups)):
        for g in chosen:
            fits[g].append(fit)
    return [{g: fits[g][p] for g in range(groups)} for p in range(len(fits[0]))]
