"""Ordered passes over rows of any number, cut so that no task holds a whole key.

Time is cut into blocks of BLOCK; values into bins of about ROWS rows. Each pass is done
within a block or bin, and what crosses borders is worked out from one row for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block of time, in the unit of the times (microseconds: a day).
BLOCK = 86_400_000_000
#: Rows of a bin of values, about, and the fewest and the most bins.
ROWS, LEAST_BINS, MOST_BINS = 2_000_000, 8, 1024


def block_of(t: Column, block: int = BLOCK) -> Column:
    return F.floor(t / block)


def value_bin(d: DataFrame, column: str, rows: int | None = None) -> Column:
    """Number of the bin of column: bins of about equal rows, in order of value; equal values share a bin.

    The borders are quantiles from one mergeable sketch; the expression is a balanced tree of
    comparisons. A table of one value has bin 0 throughout.
    """
    cuts = [i / MOST_BINS for i in range(1, MOST_BINS)]
    n, q = d.agg(F.count(column), F.percentile_approx(column, cuts, 20_000)).first()
    bins = min(MOST_BINS, max(LEAST_BINS, -(-n // (rows or ROWS))))
    borders = sorted({q[MOST_BINS * i // bins - 1] for i in range(1, bins)}) if q else []

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) <= F.lit(borders[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(borders))


def sum_from_top(d: DataFrame, column: str, value: str, *keys: str, rows: int | None = None) -> DataFrame:
    """d (distinct by keys and column) with total, the sum of value over rows of the key at column or above."""
    d = d.withColumn("_bin", value_bin(d, column, rows))
    bins = d.groupBy(*keys, "_bin").agg(F.sum(value).alias("s"))
    if keys:
        # At most MOST_BINS rows for a key.
        above = F.sum("s").over(Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.select(*keys, "_bin", F.coalesce(above, F.lit(0.0)).alias("_above"))
    else:
        total, held = 0.0, []
        for r in bins.orderBy(F.desc("_bin")).collect():  # at most MOST_BINS rows
            held.append((r["_bin"], total))
            total += r["s"] or 0.0
        bins = d.sparkSession.createDataFrame(held, "_bin int, _above double")
    by = Window.partitionBy(*keys, "_bin").orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("total", F.sum(value).over(by)).join(bins, [*keys, "_bin"]).withColumn("total", F.col("total") + F.col("_above")).drop("_bin", "_above")


def numbered(d: DataFrame, *order: str, shared: str) -> DataFrame:
    """d with _n, from 1, in the given order, and the number of rows; order must tell rows apart.

    The rows are sorted by range once and written to the folder shared; each has its task's
    number and place, and the tasks' totals (a row each) shift the rest.
    """
    d.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(shared)
    s = d.sparkSession.read.parquet(shared)
    part = F.shiftright("_id", 33)
    shift, total = [], 0
    for r in s.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each task
        shift.append((r["p"], total))
        total += r["count"]
    add = d.sparkSession.createDataFrame(shift, "_p long, _before long")
    s = s.withColumn("_p", part).join(add, "_p")
    return s.withColumn("_n", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).withColumn("_rows", F.lit(total)).drop("_id", "_p", "_before")


def runs(d: DataFrame, gap: int, *keys: str, block: int = BLOCK) -> DataFrame:
    """d with _run, the time t at which a run began: rows of a key, each at most gap after the one before.

    The time before a block's first row, and the run that goes on into it, come from a row for each block.
    """
    d = d.withColumn("_b", block_of(F.col("t"), block))
    by_block = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last = d.groupBy(*keys, "_b").agg(F.max("t").alias("_m"))
    last = last.select(*keys, "_b", F.max("_m").over(by_block).alias("_last"))
    local = Window.partitionBy(*keys, "_b").orderBy("t")
    before = F.coalesce(F.max("t").over(local.rangeBetween(Window.unboundedPreceding, -1)), F.col("_last"))
    first = d.groupBy(*keys, "_b", "t").agg(F.lit(1).alias("_one")).drop("_one").join(last, [*keys, "_b"])
    begins = F.when(F.coalesce(F.col("t") - before > gap, F.lit(True)), F.col("t"))
    first = first.withColumn("_begin", begins)
    carry = first.groupBy(*keys, "_b").agg(F.max("_begin").alias("_m"))
    carry = carry.select(*keys, "_b", F.max("_m").over(by_block).alias("_carry"))
    own = F.max("_begin").over(local.rangeBetween(Window.unboundedPreceding, 0))
    first = first.withColumn("_own", own).join(carry, [*keys, "_b"]).select(*keys, "_b", "t", F.coalesce("_own", "_carry").alias("_run"))
    return d.join(first, [*keys, "_b", "t"]).drop("_b")


def with_neighbours(d: DataFrame, column: str, tie: str, rows: int | None = None) -> DataFrame:
    """d with _prev and _next, the values of column before and after each row in the order of (column, tie) over the whole table; null at the ends.

    Neighbours are found within bins of values; across borders they are the nearest bins' ends, a row for each bin.
    """
    d = d.withColumn("_bin", value_bin(d, column, rows))
    ends = d.groupBy("_bin").agg(F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy("_bin").collect()  # at most MOST_BINS rows
    near = [(r["_bin"], ends[i - 1]["hi"] if i else None, ends[i + 1]["lo"] if i + 1 < len(ends) else None) for i, r in enumerate(ends)]
    borders = d.sparkSession.createDataFrame(near, "_bin int, _before double, _after double")
    by = Window.partitionBy("_bin").orderBy(column, tie)
    d = d.withColumns({"_prev": F.lag(column).over(by), "_next": F.lead(column).over(by)}).join(F.broadcast(borders), "_bin")
    return d.withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")}).drop("_bin", "_before", "_after")
