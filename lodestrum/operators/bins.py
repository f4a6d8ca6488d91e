"""Bins as Columns, and arrays over them as grouped tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Bins:
    """Bins between rising edges. index() is null outside; the last edge belongs to the last bin."""

    def __init__(self, edges: list[float]):
        if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
            raise ValueError("edges must rise")
        self.edges = edges

    def __len__(self) -> int:
        return len(self.edges) - 1

    def index(self, x: Column) -> Column:
        def tree(lo: int, hi: int) -> Column:
            if hi - lo == 1:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(x < self.edges[mid], tree(lo, mid)).otherwise(tree(mid, hi))

        return F.when((x >= self.edges[0]) & (x <= self.edges[-1]), tree(0, len(self)))

    def lower(self) -> list[float]:
        return self.edges[:-1]

    def upper(self) -> list[float]:
        return self.edges[1:]

    def centres(self) -> list[float]:
        return [(a + b) / 2 for a, b in zip(self.lower(), self.upper(), strict=True)]


class Linear(Bins):
    def __init__(self, lo: float, hi: float, n: int):
        super().__init__([lo + (hi - lo) * i / n for i in range(n + 1)])
        self.lo, self.hi, self.n = lo, hi, n

    def index(self, x: Column) -> Column:
        return F.when((x >= self.lo) & (x <= self.hi), F.least(F.floor((x - self.lo) / (self.hi - self.lo) * self.n), F.lit(self.n - 1)).cast("int"))


class Log(Bins):
    """Edges in geometric steps; centres are geometric too."""

    def __init__(self, lo: float, hi: float, n: int):
        super().__init__([lo * (hi / lo) ** (i / n) for i in range(n + 1)])
        self.lo, self.hi, self.n = lo, hi, n

    def index(self, x: Column) -> Column:
        return F.when((x >= self.lo) & (x <= self.hi), F.least(F.floor(F.log(x / self.lo) / math.log(self.hi / self.lo) * self.n), F.lit(self.n - 1)).cast("int"))

    def centres(self) -> list[float]:
        return [math.sqrt(a * b) for a, b in zip(self.lower(), self.upper(), strict=True)]


class Overflow(Bins):
    """Another's bins between one for all below (0) and one for all above; the upper edge is above."""

    def __init__(self, inner: Bins):
        self.inner, self.edges = inner, [-math.inf, *inner.edges, math.inf]

    def index(self, x: Column) -> Column:
        e = self.inner.edges
        return F.when(x < e[0], 0).when(x >= e[-1], len(self.inner) + 1).otherwise(self.inner.index(x) + 1)

    def centres(self) -> list[float]:
        return [-math.inf, *self.inner.centres(), math.inf]


def places(axes: dict[str, tuple[Bins, Column]]) -> list[Column]:
    return [b.index(x).alias(name) for name, (b, x) in axes.items()]


def counted(d: DataFrame, axes: dict[str, tuple[Bins, Column]], value: Column | None = None) -> DataFrame:
    """Array over bins of several axes, cells with a row only: n, and total of value. Rows outside any axis are left out."""
    d = d.select(*places(axes), (F.lit(1.0) if value is None else value.cast("double")).alias("_v"))
    inside = reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in axes])
    return d.where(inside).groupBy(*axes).agg(F.count("*").alias("n"), F.sum("_v").alias("total"))


def ratio(d: DataFrame, axes: dict[str, tuple[Bins, Column]], upper: Column, lower: Column) -> DataFrame:
    """Share of the rows meeting lower that meet upper too, cell by cell; cells whose lower count is 0 have ratio 0."""
    cells = d.select(*places(axes), upper.alias("_u"), lower.alias("_l"))
    inside = reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in axes])
    g = cells.where(inside).groupBy(*axes).agg(F.count_if(F.col("_u") & F.col("_l")).alias("upper"), F.count_if("_l").alias("lower"))
    return g.withColumn("ratio", F.coalesce(F.try_divide("upper", "lower"), F.lit(0.0)))
