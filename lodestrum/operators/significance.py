"""Significance of foreground events against a background, tail fits, sensitivity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import tail_above
from . import ordered


def count_louder(fg: DataFrame, bg: DataFrame, *keys: str) -> DataFrame:
    """fg (id, stat) with louder, the summed weight of bg (stat, weight) at or above stat; null without background.

    If no background lies below, one row of the quietest background, that of least weight,
    is left out of the sum. A NaN in the background counts as quieter than all. Background
    and foreground are first reduced to distinct values; sums run within bins of values.
    """
    b = bg.select(*keys, F.when(F.isnan("stat"), F.lit(float("-inf"))).otherwise(F.col("stat")).alias("stat"), F.col("weight").cast("double").alias("weight"))
    v = b.groupBy(*keys, "stat").agg(F.sum("weight").alias("weight"), F.min("weight").alias("_one"))
    low = v.groupBy(*keys).agg(F.min(F.struct("stat", "_one")).alias("_low"))
    u = v.select(*keys, "stat", "weight").union(fg.select(*keys, "stat", F.lit(0.0).alias("weight"))).groupBy(*keys, "stat").agg(F.sum("weight").alias("weight"))
    total = ordered.sum_from_top(u, "stat", "weight", *keys).select(*keys, "stat", "total")
    if keys:
        total = total.join(low, list(keys), "left")
    else:
        r = low.first()["_low"]  # one row
        total = total.withColumn("_low", F.struct(F.lit(r["stat"] if r else None).cast("double").alias("stat"), F.lit(r["_one"] if r else None).cast("double").alias("_one")))
    clamp = F.when(F.col("stat") <= F.col("_low.stat"), F.col("_low._one")).otherwise(0.0)
    total = total.select(*keys, "stat", F.when(F.col("_low.stat").isNotNull(), F.col("total") - clamp).alias("louder"))
    return fg.select(*keys, "id", "stat").join(total, [*keys, "stat"], "left").select(*keys, "id", "stat", "louder")


def far(louder, live, exact: bool = True):
    """Rate of louder background: (n + 1) / T for counted, n / T for fitted background."""
    return (louder + 1 if exact else louder) / live


def fap(rate, foreground_time):
    return 1 - F.exp(-foreground_time * rate)


def limited(rate, limit: float):
    """A rate no lower than limit; 0 sets none."""
    return F.greatest(rate, F.lit(limit)) if limit else rate


def tail_fit(d: DataFrame, threshold: float, *keys: str, weight: str | None = None) -> DataFrame:
    """Maximum-likelihood slope of an exponential, Rayleigh and power tail from a threshold on, with the errors.

    Values are stat, weighed by weight if given; groups with none there have -1.
    """
    x, t = F.col("stat"), threshold
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    above = x >= t
    m = lambda e: F.sum(F.when(above, e * w))
    d = d.groupBy(*keys).agg(F.sum(F.when(above, 1).otherwise(0)).alias("n_above"), F.coalesce(m(F.lit(1.0)), F.lit(0.0)).alias("n"), m(x - t).alias("e"), m(x * x - t * t).alias("r"), m(F.log(x / t)).alias("p"))
    pick = lambda e: F.when((F.col("n") > 0) & (F.col("e") > 0), e).otherwise(-1.0)
    slope = {"exponential": F.col("n") / F.col("e"), "rayleigh": 2 * F.col("n") / F.col("r"), "power": F.col("n") / F.col("p") + 1}
    out = [pick(a).alias(f"alpha_{k}") for k, a in slope.items()]
    out += [pick((a - (1 if k == "power" else 0)) / F.sqrt("n")).alias(f"sigma_{k}") for k, a in slope.items()]
    return d.select(*keys, "n_above", *out)


def louder_by_fit(fg: DataFrame, bg: DataFrame, kind: str, threshold: float, *keys: str) -> DataFrame:
    """fg (id, stat) with louder, estimated from a tail fitted to bg (stat, weight) above a threshold.

    At or below the threshold the background there is counted, and all above it added.
    """
    fit = tail_fit(bg, threshold, *keys, weight="weight").select(*keys, F.col(f"alpha_{kind}").alias("_a"))
    above = bg.groupBy(*keys).agg(F.sum(F.when(F.col("stat") > threshold, F.col("weight")).otherwise(0.0)).alias("_n"))
    low = count_louder(fg.where(F.col("stat") <= threshold), bg.where(F.col("stat") <= threshold), *keys)
    both = low.unionByName(fg.where(F.col("stat") > threshold).select(*keys, "id", "stat"), allowMissingColumns=True)
    if keys:
        both = both.join(fit.join(above, list(keys)), list(keys), "left")
    else:
        both = both.join(F.broadcast(fit.join(F.broadcast(above), F.lit(True))), F.lit(True))  # one row each
    tail = F.col("_n") * tail_above(kind, F.col("stat"), F.col("_a"), F.lit(float(threshold)))
    return both.select(*keys, "id", "stat", F.when(F.col("stat") > threshold, tail).otherwise(F.col("louder") + F.col("_n")).alias("louder"))


def louder(method: str, fg: DataFrame, bg: DataFrame, *keys: str, kind: str = "exponential", threshold: float = 0.0) -> DataFrame:
    """Louder background by method: counted, or by a fit."""
    if method == "count":
        return count_louder(fg, bg, *keys)
    if method == "fit":
        return louder_by_fit(fg, bg, kind, threshold, *keys)
    raise ValueError(f"no method {method}; there are count and fit")


def without_loud(fg: DataFrame, bg: DataFrame, rate: float, live: float, w: int, most: int) -> DataFrame:
    """Hierarchical removal: fg (id, stat, t) with louder and stage, its last estimate and the removals before it.

    While the loudest event left has a rate below `rate`, its estimate stands, and all background
    (stat, weight, t) within w of it is removed, for the others to be estimated anew. The loop is over the
    loudest few, most of them at most; each round is an aggregation.
    """
    done = None
    for stage in range(most + 1):
        now = count_louder(fg, bg).join(fg.select("id", "t"), "id").withColumn("stage", F.lit(stage))
        top = now.orderBy(F.desc("stat"), "id").limit(1).collect()
        if stage == most or not top or top[0]["louder"] is None or (top[0]["louder"] + 1) / live >= rate:
            return now if done is None else done.union(now)
        this = now.where(F.col("id") == top[0]["id"])
        done = this if done is None else done.union(this)
        fg = fg.where(F.col("id") != top[0]["id"])
        bg = bg.where(F.abs(F.col("t") - top[0]["t"]) > w)
    return done


def efficiency(d: DataFrame, width: float, *keys: str) -> DataFrame:
    """Found share of injections (distance, found) in bins of distance, with binomial error."""
    g = d.groupBy(*keys, F.floor(F.col("distance") / width).alias("bin")).agg(F.sum(F.col("found").cast("double")).alias("found"), F.count("*").cast("double").alias("total"))
    e = F.col("found") / F.col("total")
    return g.select(*keys, "bin", e.alias("eff"), F.sqrt(e * (1 - e) / F.col("total")).alias("err"))


def efficiency_volume(eff: DataFrame, width: float, logarithmic: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Volume and its error from efficiencies (bin, eff, err) in bins of distance, by the midpoint of each.

    logarithmic: bins are of width in log distance, and midpoints geometric.
    """
    mid = (F.col("bin") + 0.5) * width
    cell = 4 * math.pi * (F.exp(3 * mid) if logarithmic else mid * mid) * width
    return eff.groupBy(*keys).agg(F.sum(cell * F.col("eff")).alias("volume"), F.sqrt(F.sum(F.pow(cell * F.col("err"), 2.0))).alias("error"))


def shell_volume(d: DataFrame) -> DataFrame:
    """Volume and error from injections (id, distance, found): the shell about each found one reaches half-way to its neighbours.

    The first shell begins at 0; the farthest injection has none.
    """
    n = ordered.with_neighbours(d.select("id", "distance", "found"), "distance", "id")
    x = F.col("distance")
    inner = F.coalesce((F.col("_prev") + x) / 2, F.lit(0.0))
    shell = 4 * math.pi * x * x * ((F.col("_next") + x) / 2 - inner)
    n = n.where(F.col("found") & F.col("_next").isNotNull())
    return n.agg(F.coalesce(F.sum(shell), F.lit(0.0)).alias("volume"), F.sqrt(F.coalesce(F.sum(shell * shell), F.lit(0.0))).alias("error"))


def distance_of_volume(volume, error) -> tuple:
    """Radius of a volume, and how far it rises and falls with the volume's error."""
    radius = lambda v: F.pow(v * 3.0 / 4.0 / math.pi, 1.0 / 3)
    return radius(volume), radius(volume + error) - radius(volume), radius(volume) - radius(F.greatest(volume - error, F.lit(0.0)))


def monte_carlo_volume(d: DataFrame, power: float) -> DataFrame:
    """Share of weight (distance ** power) found, of the sphere of the largest distance, with the sample error."""
    w = F.pow("distance", power)
    f = F.when(F.col("found"), w).otherwise(0.0)
    g = d.agg(F.sum(f).alias("f"), F.sum(w).alias("w"), F.sum(f * f).alias("f2"), F.count("*").cast("double").alias("n"), F.max("distance").alias("r"))
    v = 4 / 3 * 3.141592653589793 * F.pow("r", 3.0)
    mean = F.col("f") / F.col("n")
    return g.select((v * F.col("f") / F.col("w")).alias("volume"), (v * F.sqrt(F.col("n") * (F.col("f2") / F.col("n") - mean * mean)) / F.col("w")).alias("error"))
