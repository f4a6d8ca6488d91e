"""Packed series (arrays of samples) as Columns: no shuffle, no Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import asum, at_linear


def doubles(a) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def crop(a, left: int, right: int) -> Column:
    """Without the first left and the last right samples."""
    return F.slice(a, left + 1, F.greatest(F.size(a) - left - right, F.lit(0)))


def time_slice(a, epoch: float, dt: float, start: float, end: float) -> Column:
    """Samples from start to before end, to the nearest sample."""
    i, j = F.round((F.lit(start) - epoch) / dt).cast("int"), F.round((F.lit(end) - epoch) / dt).cast("int")
    return F.slice(a, i + 1, j - i)


def rolled(a, n: int) -> Column:
    """Moved on by n samples, the last ones coming round to the front."""
    k = F.pmod(F.lit(n), F.size(a))
    return F.concat(F.slice(a, F.size(a) - k + 1, k), F.slice(a, F.lit(1), F.size(a) - k))


def added_at(a, b, at: int) -> Column:
    """a with b added from sample at on; what of b lies outside is left out."""
    return F.transform(a, lambda x, i: x.cast("double") + F.coalesce(F.when(i >= at, F.get(b, i - at).cast("double")), F.lit(0.0)))


def without_mean(a) -> Column:
    mean = asum(doubles(a)) / F.size(a)
    return F.transform(F.arrays_zip(doubles(a).alias("x"), F.array_repeat(mean, F.size(a)).alias("m")), lambda z: z["x"] - z["m"])


def without_line(a) -> Column:
    """Less the least-squares line; a series of one sample becomes 0."""
    n = F.size(a).cast("double")
    mid = (n - 1) / 2
    moment = F.aggregate(F.transform(a, lambda x, i: (i - mid) * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    slope = F.coalesce(F.try_divide(moment * 12, n * (n * n - 1)), F.lit(0.0))
    fitted = F.array_repeat(F.struct((asum(doubles(a)) / n).alias("m"), slope.alias("s"), mid.alias("c")), F.size(a))
    return F.transform(F.arrays_zip(doubles(a).alias("x"), fitted.alias("f")), lambda z, i: z["x"] - z["f"]["m"] - z["f"]["s"] * (i - z["f"]["c"]))


def gated(a, lo: int, hi: int, taper: int = 0) -> Column:
    """Zero from sample lo to before hi, with cosine tapers of so many samples on both sides."""

    def weight(i: Column) -> Column:
        w = F.when((i >= lo) & (i < hi), 0.0)
        if taper:
            w = w.when((i >= lo - taper) & (i < lo), 0.5 * (1 - F.cos(math.pi * (lo - i) / (taper + 1))))
            w = w.when((i >= hi) & (i < hi + taper), 0.5 * (1 - F.cos(math.pi * (i - hi + 1) / (taper + 1))))
        return w.otherwise(1.0)

    return F.transform(a, lambda x, i: x.cast("double") * weight(i))


def resampled_line(a, step: float, n: int) -> Column:
    """n values on lines between samples, step samples apart; null beyond the end."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at_linear(a, i * step))


def mean_square(a, window: int) -> Column:
    """Mean of squares over each whole window of samples, one after the other."""
    many = F.floor(F.size(a) / window).cast("int")
    starts = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: asum(F.transform(F.slice(a, k * window + 1, F.lit(window)), lambda x: x.cast("double") * x.cast("double"))) / window)


def filtered(a, taps: list[float]) -> Column:
    """Convolution with symmetric taps about each sample, so without delay; samples without all neighbours become 0."""
    half = len(taps) // 2
    whole = lambda i: (i >= half) & (i < F.size(a) - half)
    at = lambda i: sum((t * F.get(a, i + k - half).cast("double") for k, t in enumerate(taps)), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.when(whole(i), at(i)).otherwise(0.0))


def lowpass_taps(cutoff: float, n: int, beta: float = 5.0) -> list[float]:
    """Sinc taps (n odd) under a Kaiser window, of unit gain at zero; cutoff in units of the Nyquist frequency."""
    import numpy as np

    if n % 2 == 0:
        raise ValueError("an odd number of taps")
    k = np.arange(n) - n // 2
    t = cutoff * np.sinc(cutoff * k) * np.kaiser(n, beta)
    return (t / t.sum()).tolist()


def highpass_taps(cutoff: float, n: int, beta: float = 5.0) -> list[float]:
    """A unit sample less the lowpass of the same cutoff."""
    t = [-x for x in lowpass_taps(cutoff, n, beta)]
    t[n // 2] += 1
    return t


def notch_taps(low: float, high: float, n: int, beta: float = 5.0) -> list[float]:
    """What passes below low or above high."""
    return [a + b for a, b in zip(lowpass_taps(low, n, beta), highpass_taps(high, n, beta), strict=True)]


def window_tops(a, w: int, threshold: float = float("-inf")) -> Column:
    """(i, v) of the samples above a threshold that are the first maximum of modulus within w samples on both sides."""
    size = doubles(F.transform(a, lambda x: F.abs(x)))
    each = F.transform(size, lambda v, i: F.struct(i.cast("long").alias("i"), v.alias("v"), F.slice(size, F.greatest(i - w, F.lit(0)) + 1, F.least(i, F.lit(w))).alias("before"), F.slice(size, i + 2, F.lit(w)).alias("after")))
    top = lambda x: (x["v"] > threshold) & (x["v"] > F.coalesce(F.array_max(x["before"]), F.lit(-1.0))) & (x["v"] >= F.coalesce(F.array_max(x["after"]), F.lit(-1.0)))
    return F.transform(F.filter(each, top), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))


def autogates(a, threshold: float, w: int) -> Column:
    """(start, end) of gates of w samples on both sides of each top above a threshold, that of the samples within."""
    return F.transform(window_tops(a, w, threshold), lambda x: F.struct(F.greatest(x["i"] - w, F.lit(0)).alias("start"), F.least(x["i"] + w + 1, F.size(a)).alias("end")))


def smeared(indices, by: int) -> Column:
    """Every index within by of a given one, once, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(indices, lambda i: F.sequence(i - by, i + by)))))
