"""Ranking statistics of single events and coincidences, chosen by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as L
from ..functions.physics import noise_area

#: Log rate that a fit-based ranking is measured against, its least value.
BENCHMARK, LEAST = -14.6, -30.0


def log_noise_rate(stat: Column, alpha: Column, rate: Column, threshold: float, alpha_below: float | None = None) -> Column:
    """Log density of noise events over stat, from the slope and rate of its template's fit; below the threshold by a slope of its own."""
    at = -alpha * (stat - threshold) + F.log(alpha) + F.log(rate)
    if alpha_below is None:
        return at
    return F.when(stat < threshold, -alpha_below * (stat - threshold) + F.log(F.lit(alpha_below)) + F.log(rate)).otherwise(at)


def log_noise_coincidence(parts: list[Column], sites: tuple[str, ...], slop: float) -> Column:
    """Log rate density of chance coincidences of events with these log noise rates."""
    return sum(parts[1:], parts[0]) + F.log(F.lit(noise_area(sites, slop)))


@dataclass
class Statistic:
    """single: of one event, from its row; coinc: of the singles of a coincidence; bound: the least value that
    a further single needs for the coincidence to reach a threshold, given those that are there."""

    single: Callable[..., Column]
    coinc: Callable[..., Column]
    bound: Callable[..., Column]


def quadrature() -> Statistic:
    return Statistic(lambda row, name="newsnr": L.ranking(name, row["snr"], row["rchisq"], row["sg_chisq"], row["psd_var_val"]), lambda singles: L.quadrature(*singles), lambda singles, t: F.sqrt(F.greatest(t * t - sum((s * s for s in singles), F.lit(0.0)), F.lit(0.0))))


def exp_fit(sites: tuple[str, ...] = ("H1", "L1"), slop: float = 0.002, threshold: float = 6.0, alpha_below: float | None = None) -> Statistic:
    """Log likelihood ratio over noise of fitted tails; singles are log noise rates, so lower is better."""
    area = F.log(F.lit(noise_area(sites, slop)))
    return Statistic(
        lambda row: log_noise_rate(row["stat"], row["alpha"], row["rate"], threshold, alpha_below),
        lambda singles: F.greatest(-log_noise_coincidence(singles, sites, slop) + BENCHMARK, F.lit(LEAST)),
        lambda singles, t: BENCHMARK - t - area - sum(singles, F.lit(0.0)),
    )


#: Statistics by name.
NAMED: dict[str, Callable[..., Statistic]] = {"quadsum": quadrature, "exp_fit": exp_fit}


def named(name: str, **options) -> Statistic:
    if name not in NAMED:
        raise ValueError(f"no statistic {name}; there are {', '.join(NAMED)}")
    return NAMED[name](**options)


def ranked(coincs: DataFrame, statistic: Statistic, singles: list[str], out: str = "rank") -> DataFrame:
    """coincs with the statistic of their singles' columns; a coincidence that lacks one has null."""
    return coincs.withColumn(out, statistic.coinc([F.col(c) for c in singles]))
