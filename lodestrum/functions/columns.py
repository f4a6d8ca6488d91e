"""Scalar library: every function takes and returns Columns, so Catalyst sees through all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Solar mass in seconds, Julian year in seconds, reference chirp mass of the chirp distance.
MTSUN, YEAR, REF_MASS = 4.925490947641267e-06, 31557600.0, 1.4


def first_match(cases: list[tuple], otherwise=None) -> Column:
    """Value of the first condition that holds."""
    return reduce(lambda w, c: w.when(c[1], c[0]), cases[1:], F.when(cases[0][1], cases[0][0])).otherwise(otherwise)


# --- masses and spins -------------------------------------------------------
def mtotal(m1, m2):
    return m1 + m2


def eta(m1, m2):
    return m1 * m2 / ((m1 + m2) * (m1 + m2))


def q(m1, m2):
    return F.greatest(m1, m2) / F.least(m1, m2)


def mchirp(m1, m2):
    return F.pow(eta(m1, m2), 0.6) * (m1 + m2)


def mass1_from_mchirp_q(mc, ratio):
    return mc * F.pow(1 + ratio, 0.2) * F.pow(ratio, 0.4)


def tau0(m1, m2, f_lower=20.0):
    return 5.0 / (256 * 3.141592653589793 * f_lower * eta(m1, m2) * F.pow(3.141592653589793 * MTSUN * (m1 + m2) * f_lower, 5.0 / 3))


def chi_eff(m1, m2, s1, s2):
    return (m1 * s1 + m2 * s2) / (m1 + m2)


def chirp_distance(distance, mc):
    return distance * F.pow(F.lit(0.5**0.2 * REF_MASS) / mc, 5.0 / 6)


def sec_to_year(s):
    return s / YEAR


# --- geometry and boundaries ---------------------------------------------------
def cartesian_to_spherical(x, y, z):
    rho = F.sqrt(x * x + y * y + z * z)
    return rho, F.pmod(F.atan2(y, x), F.lit(6.283185307179586)), F.when(rho == 0, 0.0).otherwise(F.acos(z / rho))


def cyclic(x, lo: float, hi: float):
    """Fold into [lo, hi)."""
    return lo + F.pmod(x - lo, F.lit(hi - lo))


def reflected(x, lo: float, hi: float):
    """Fold into [lo, hi] by mirrors at both ends."""
    p = F.pmod(x - lo, F.lit(2 * (hi - lo)))
    return lo + F.least(p, 2 * (hi - lo) - p)


def logit(x, lo: float, hi: float):
    """Infinite at the ends, not a number beyond them."""
    inside = F.when((x > lo) & (x < hi), F.log((x - lo) / (hi - x)))
    return inside.when(x == lo, float("-inf")).when(x == hi, float("inf")).when(x.isNotNull(), float("nan"))


def logistic(y, lo: float, hi: float):
    return (lo + hi * F.exp(y)) / (1 + F.exp(y))


# --- rankings of single events ---------------------------------------------------
def effective_snr(snr, rchisq, fac=250.0):
    return snr / F.pow(rchisq * (1 + snr * snr / fac), 0.25)


def newsnr(snr, rchisq, power=6.0, n=2.0):
    """Reweighted by the reduced chi-square where that is above one."""
    return F.when(rchisq > 1, snr * F.pow(0.5 * (1 + F.pow(rchisq, power / n)), -1 / power)).otherwise(snr)


def newsnr_sg(snr, rchisq, sg):
    r = newsnr(snr, rchisq)
    return F.when(sg > 4, r / F.sqrt(sg / 4)).otherwise(r)


#: Fixed value: variation of the spectrum below which it counts as none.
LEAST_VARIATION = 0.65


def variation(v):
    return F.when(v < LEAST_VARIATION, 1.0).otherwise(v)


def newsnr_psdvar(snr, rchisq, sg, v):
    """SNR and chi-square taken in units of the varying spectrum."""
    v = variation(v)
    return newsnr_sg(snr / F.sqrt(v), rchisq / v, sg)


def newsnr_psdvar_threshold(snr, rchisq, sg, v, most_chisq=10.0, most_variation=10.0):
    return F.when((rchisq > most_chisq) | (v > most_variation), 1.0).otherwise(newsnr_psdvar(snr, rchisq, sg, v))


def newsnr_psdvar_scaled(snr, rchisq, sg, v, scale=0.33):
    return newsnr_sg(snr, rchisq, sg) / F.pow(variation(v), scale)


def newsnr_psdvar_scaled_threshold(snr, rchisq, sg, v, most_chisq=2.0):
    return F.when(rchisq > most_chisq, 1.0).otherwise(newsnr_psdvar_scaled(snr, rchisq, sg, v))


#: Rankings of a single event by name, of (snr, reduced chi-square, sine-Gaussian chi-square, variation).
RANKINGS = {
    "snr": lambda s, x, g, v: s,
    "newsnr": lambda s, x, g, v: newsnr(s, x),
    "new_snr": lambda s, x, g, v: newsnr(s, x),
    "newsnr_sgveto": lambda s, x, g, v: newsnr_sg(s, x, g),
    "newsnr_sgveto_psdvar": newsnr_psdvar,
    "newsnr_sgveto_psdvar_threshold": newsnr_psdvar_threshold,
    "newsnr_sgveto_psdvar_scaled": newsnr_psdvar_scaled,
    "newsnr_sgveto_psdvar_scaled_threshold": newsnr_psdvar_scaled_threshold,
}


def ranking(name: str, snr, rchisq, sg, v) -> Column:
    if name not in RANKINGS:
        raise ValueError(f"no ranking {name}; there are {', '.join(RANKINGS)}")
    return RANKINGS[name](snr, rchisq, sg, v)


def quadrature(*stats):
    """Root of the sum of squares; 0 if any part was cut (-1)."""
    return F.when(reduce(lambda a, b: a | b, [s == -1 for s in stats]), 0.0).otherwise(F.sqrt(reduce(lambda a, b: a + b, [s * s for s in stats])))


def null_snr(coinc, coh):
    return F.sqrt(F.greatest(coinc * coinc - coh * coh, F.lit(0.0)))


# --- densities ---------------------------------------------------------------
def uniform_logpdf(x, lo, hi):
    return F.when((x >= lo) & (x < hi), -F.log(F.lit(float(hi - lo))))


def powerlaw_pdf(x, lo, hi, dim=3):
    return F.when((x >= lo) & (x < hi), dim * F.pow(x, dim - 1.0) / (hi**dim - lo**dim)).otherwise(0.0)


def normal_logpdf(x, mean, sd):
    return -0.5 * F.pow((x - mean) / sd, 2.0) - F.log(sd * F.lit(2.5066282746310002))


# --- packed series -----------------------------------------------------------
def fold(a, start, f):
    return F.aggregate(a, F.lit(start), f)


def asum(a):
    return fold(a, 0.0, lambda s, x: s + x)


def inner(a, b):
    return asum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def overlap(a, b):
    return inner(a, b) / F.sqrt(inner(a, a) * inner(b, b))


def at_linear(a, x):
    """Value at a fractional index from 0, on the line between its neighbours; null outside."""
    i = F.floor(x).cast("int")
    lo, hi = F.get(a, i).cast("double"), F.get(a, F.least(i + 1, F.size(a) - 1)).cast("double")
    return lo + (hi - lo) * (x - i)


# --- samples and banks ---------------------------------------------------------------
def hypertriangle(parts: list, lo: float = 0.0, hi: float = 1.0) -> list[Column]:
    """Ascending values from as many independent uniform ones: 1 - y is a running product of powers of 1 - x."""
    n, out, left = len(parts), [], F.lit(1.0)
    for i, x in enumerate(parts):
        left = left * F.pow(1 - (x - lo) / (hi - lo), 1.0 / (n - i))
        out.append(lo + (hi - lo) * (1 - left))
    return out


def template_hash(*parts) -> Column:
    """A number from a template's parameters: the same for the same, whatever bank it stands in."""
    return F.xxhash64(*[p.cast("double") for p in parts])


def metric_mismatch(a: list, b: list) -> Column:
    """Squared distance in orthonormal metric coordinates, one less the match of near templates."""
    return sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))
