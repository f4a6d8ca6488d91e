"""Sample diagnostics, entropies and evidence as plain aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gelman_rubin(d: DataFrame, chain: str, value: str) -> DataFrame:
    """Potential scale reduction of chains of one parameter, with the correction for degrees of freedom.

    Chains should be of one length (the mean length is used); leave out burn-in before.
    """
    c = d.groupBy(chain).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").cast("double").alias("n"))
    g = c.agg(
        F.avg("n").alias("n"), F.count("*").cast("double").alias("c"), F.avg("v").alias("w"), F.var_samp("m").alias("vm"), F.avg("m").alias("mu"), F.var_pop("v").alias("s"),
        F.covar_samp("v", F.col("m") * F.col("m")).alias("vm2"), F.covar_samp("v", "m").alias("vm1"),
    )
    n, m, w, b = F.col("n"), F.col("c"), F.col("w"), F.col("n") * F.col("vm")
    wide = 1 + 1 / m
    both = (n - 1) * w / n + wide * b / n
    cross = n / m * (F.col("vm2") - 2 * F.col("mu") * F.col("vm1"))
    spread = ((n - 1) * (n - 1) * F.col("s") + wide * wide * 2 * b * b / (m - 1) + 2 * (n - 1) * wide * cross) / (n * n)
    dof = 2 * both * both / spread
    return g.select(F.sqrt(((n - 1) / n + wide / n * b / w) * (dof + 3) / (dof + 1)).alias("psrf"))


def geweke(d: DataFrame, index: str, value: str, size: int, stride: int, end: int, ref_start: int, *keys: str) -> DataFrame:
    """z of the mean of each segment of a chain against that of its part from index ref_start on.

    Segments of size samples begin at 0, stride, 2 stride and so on below end; each sample
    is dealt to the segments it lies in, at most size / stride of them. Variances are of the population.
    """
    i = F.col(index)
    first, last = F.greatest(F.floor((i - size) / stride) + 1, F.lit(0)), F.least(F.floor(i / stride), F.lit((end - 1) // stride))
    part = d.where(i < end + size).withColumn("_s", F.explode(F.when(first <= last, F.sequence(first, last)))).groupBy(*keys, (F.col("_s") * stride).alias("start"))
    part = part.agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    ref = d.where(i >= ref_start).groupBy(*keys).agg(F.avg(value).alias("rm"), F.var_pop(value).alias("rv"))
    return part.join(ref, list(keys)).select(*keys, "start", ((F.col("m") - F.col("rm")) / F.sqrt(F.col("v") + F.col("rv"))).alias("z"))


def histogram(d: DataFrame, value: str, lo: float, hi: float, n: int, *keys: str) -> DataFrame:
    """Counts of n equal bins of [lo, hi], the last edge inclusive; values outside are left out."""
    x = F.col(value)
    b = F.least(F.floor((x - lo) / ((hi - lo) / n)), F.lit(n - 1))
    return d.where((x >= lo) & (x <= hi)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def entropy(h: DataFrame, *keys: str) -> DataFrame:
    """Shannon entropy (nats) of counts n: log N - sum(n log n) / N."""
    s = F.sum("n").cast("double")
    return h.groupBy(*keys).agg((F.log(s) - F.sum(F.col("n") * F.log("n")) / s).alias("entropy"))


def kl_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """Sum p log(p / q) over bins where both have counts (bin, n)."""
    share = lambda d, c: d.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(c))  # noqa: E731  bins are few
    return share(p, "p").join(share(q, "q"), "bin").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


def log_evidence(d: DataFrame, logl: str, *keys: str) -> DataFrame:
    """Log of the mean, and of the harmonic mean, of exp(logl), each scaled by its largest term."""
    top, low = F.max(logl), F.min(logl)
    m = d.groupBy(*keys).agg(top.alias("_hi"), low.alias("_lo"))
    x = d.join(m, list(keys)) if keys else d.join(F.broadcast(m), F.lit(True))  # one row without keys
    g = x.groupBy(*keys, "_hi", "_lo").agg(F.avg(F.exp(F.col(logl) - F.col("_hi"))).alias("a"), F.avg(F.exp(F.col("_lo") - F.col(logl))).alias("h"))
    return g.select(*keys, (F.log("a") + F.col("_hi")).alias("arithmetic"), (F.col("_lo") - F.log("h")).alias("harmonic"))
