"""Limits and intervals of posteriors on grids (key, mu, p), and mixture densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulated(d: DataFrame, *keys: str) -> DataFrame:
    """Share of the posterior up to the end of each interval of the grid, by trapezoids, at its lower end mu. A key's grid is short."""
    by = Window.partitionBy(*keys).orderBy("mu")
    part = (F.lead("mu").over(by) - F.col("mu")) * (F.lead("p").over(by) + F.col("p")) / 2
    d = d.withColumn("_part", part).where("_part is not null")
    upto = F.sum("_part").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return d.select(*keys, "mu", (upto / F.sum("_part").over(Window.partitionBy(*keys))).alias("share"))


def upper(alpha) -> Column:
    """Upper limit over cumulated(): the first mu with that share."""
    return F.min(F.when(F.col("share") >= alpha, F.col("mu")))


def lower(alpha) -> Column:
    """Lower limit over cumulated(): the first mu with over 1 - alpha."""
    return F.min(F.when(F.col("share") > 1 - alpha, F.col("mu")))


def narrowest(c: DataFrame, alpha: float, *keys: str, step: float = 0.01) -> DataFrame:
    """Shortest interval (low, high) of confidence alpha, sliding by step; the first of equals."""
    shifts = [i * step for i in range(100) if i * step < 1 - alpha - 1e-12]
    made = c.groupBy(*keys).agg(*[F.struct((upper(alpha + s) - lower(1 - s)).alias("width"), F.lit(n).alias("n"), lower(1 - s).alias("low"), upper(alpha + s).alias("high")).alias(f"_s{n}") for n, s in enumerate(shifts)])
    best = F.array_min(F.array(*[F.col(f"_s{n}") for n in range(len(shifts))]))
    return made.select(*keys, best.alias("x")).select(*keys, F.col("x.low").alias("low"), F.col("x.high").alias("high"))


def log_signal_density(stat: Column, least: float) -> Column:
    """Log density of statistics of sources spread evenly in space, above least."""
    return F.log(F.lit(3.0 * least**3)) - 4 * F.log(stat)


def log_background_density(d: DataFrame, counts: DataFrame, width: float, least: float, bins: int) -> DataFrame:
    """d (stat) with logp and err, the log density and its relative error from a histogram (bin, n) of the background.

    Bins of equal width begin at least; empty ones count one. Statistics beyond the last bin share one
    more count up to the loudest of them.
    """
    top = least + width * bins
    total = counts.agg(F.sum("n")).first()[0] or 0  # one row
    most = d.agg(F.max("stat")).first()[0]
    total += bool(most is not None and most >= top)
    at = F.floor((F.col("stat") - least) / width)
    j = d.withColumn("bin", at).join(counts.select(F.col("bin").cast("long").alias("bin"), "n"), "bin", "left")
    n = F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).cast("double")
    beyond = F.col("stat") >= top
    over = -F.log(F.lit(float(max(total, 1)))) - F.log(F.lit(float(most - top)) if most is not None and most > top else F.lit(None).cast("double"))
    return j.select(*d.columns, F.when(beyond, over).otherwise(F.log(n) - F.log(F.lit(width * total))).alias("logp"), F.when(beyond, 1.0).otherwise(1 / F.sqrt(n)).alias("err"))
