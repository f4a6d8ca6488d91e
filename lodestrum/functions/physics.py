"""Binary parameters, detector geometry, sidereal time, fitted tails, priors and closed-form waveforms as Columns."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import MTSUN, eta

PI = math.pi
C_SI = 299792458.0
GPS_EPOCH = 315964800
# UTC days from which a further leap second holds, from the beginning of GPS time.
LEAPS = ["1981-07-01", "1982-07-01", "1983-07-01", "1985-07-01", "1988-01-01", "1990-01-01", "1991-01-01", "1992-07-01", "1993-07-01", "1994-07-01", "1996-01-01", "1997-07-01", "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01"]
# Vertex in metres, directions of the two arms, Earth-fixed axes.
SITES = {
    "H1": ((-2.16141492636e6, -3.83469517889e6, 4.60035022664e6), (-0.22389266154, 0.79983062746, 0.55690487831), (-0.91397818574, 0.02609403989, -0.40492342125)),
    "L1": ((-7.42760447238e4, -5.49628371971e6, 3.22425701744e6), (-0.95457412153, -0.14158077340, -0.26218911324), (0.29774156894, -0.48791033647, -0.82054461286)),
    "V1": ((4.54637409900e6, 8.42989697626e5, 4.37857696241e6), (-0.70045821479, 0.20848948619, 0.68256166277), (-0.05379255368, -0.96908180549, 0.24080451708)),
}


# --- masses and frequencies ---------------------------------------------------
def masses_from_mchirp_eta(mc, e):
    total = mc / F.pow(e, 0.6)
    root = F.sqrt(1 - 4 * e)
    return 0.5 * total * (1 + root), 0.5 * total * (1 - root)


def tau3(m1, m2, f0=20.0):
    return 1 / (8 * f0 * eta(m1, m2)) / F.pow(PI * MTSUN * (m1 + m2) * f0, 2.0 / 3)


def chi_p(m1, m2, perp1, perp2):
    """Effective precession spin from the in-plane spins; the heavier body leads."""
    big, small = F.when(m1 >= m2, perp1).otherwise(perp2), F.when(m1 >= m2, perp2).otherwise(perp1)
    r = F.least(m1, m2) / F.greatest(m1, m2)
    return F.greatest(big, r * (4 * r + 3) / (4 + 3 * r) * small)


def lambda_tilde(m1, m2, l1, l2):
    return 16.0 / 13 * ((m1 + 12 * m2) * F.pow(m1, 4.0) * l1 + (m2 + 12 * m1) * F.pow(m2, 4.0) * l2) / F.pow(m1 + m2, 5.0)


def f_isco(total):
    return 1 / (6**1.5 * PI * MTSUN * total)


def f_light_ring(total):
    return 1 / (3**1.5 * PI * MTSUN * total)


def f_bkl_isco(m1, m2):
    r = F.least(m1, m2) / F.greatest(m1, m2)
    return f_isco(m1 + m2) * (1 + 2.8 * r - 2.6 * r * r + 0.8 * r * r * r)


def snr_from_loglr(x):
    return F.sqrt(2 * F.greatest(x, F.lit(0.0)))


# --- time and sky -----------------------------------------------------------------
def _leaps() -> list[int]:
    import datetime as dt

    return [int(dt.datetime.fromisoformat(x).replace(tzinfo=dt.UTC).timestamp()) for x in LEAPS]


def gps_from_unix(s: Column) -> Column:
    """GPS seconds of UTC seconds since 1970; null before GPS time began."""
    return F.when(s >= GPS_EPOCH, s - GPS_EPOCH + reduce(lambda a, b: a + b, [F.when(s >= x, 1).otherwise(0) for x in _leaps()]))


def unix_from_gps(g: Column) -> Column:
    """UTC seconds since 1970 of GPS seconds; a leap second itself is given as the second after it. Null before GPS time began."""
    return F.when(g >= 0, g + GPS_EPOCH - reduce(lambda a, b: a + b, [F.when(g >= x - GPS_EPOCH + n, 1).otherwise(0) for n, x in enumerate(_leaps())]))


def gmst(unix: Column) -> Column:
    """Greenwich mean sidereal time in radians of UTC seconds (polynomial of 1982), in [0, 2 pi)."""
    t = (unix - 946728000.0) / (86400.0 * 36525)
    s = 67310.54841 + (876600.0 * 3600 + 8640184.812866) * t + 0.093104 * t * t - 6.2e-6 * t * t * t
    return F.pmod(s * (PI / 43200), F.lit(2 * PI))


def tensor(site: str) -> list[list[float]]:
    _, x, y = SITES[site]
    return [[0.5 * (x[i] * x[j] - y[i] * y[j]) for j in range(3)] for i in range(3)]


def antenna_pattern(site: str, ra, dec, psi, sidereal) -> tuple[Column, Column]:
    """Responses (plus, cross) of a detector: its tensor along the sky's east and north at the source, turned by the polarization.

    Towards the source, e points east and n north; the tensor has D(e, e), D(n, n) and
    D(e, n) there, and a turn by psi mixes half their difference with the last.
    """
    d = tensor(site)
    lon = ra - sidereal
    e = (-F.sin(lon), F.cos(lon), F.lit(0.0))
    n = (-F.sin(dec) * F.cos(lon), -F.sin(dec) * F.sin(lon), F.cos(dec))
    along = lambda a, b: reduce(lambda x, y: x + y, [d[i][j] * a[i] * b[j] for i in range(3) for j in range(3)])
    level, slant = along(e, e) - along(n, n), 2 * along(e, n)
    return F.cos(2 * psi) * level - F.sin(2 * psi) * slant, -F.sin(2 * psi) * level - F.cos(2 * psi) * slant


def delay_from_centre(site: str, ra, dec, sidereal) -> Column:
    g, (x, y, z) = sidereal - ra, SITES[site][0]
    return -(x * F.cos(dec) * F.cos(g) - y * F.cos(dec) * F.sin(g) + z * F.sin(dec)) / C_SI


def light_travel_time(a: str, b: str) -> float:
    return math.dist(SITES[a][0], SITES[b][0]) / C_SI


def noise_area(sites: tuple[str, ...], slop: float) -> float:
    """Extent of the time differences of two detectors, or area of those of three, at which noise may coincide."""
    if len(sites) == 2:
        return 2 * (light_travel_time(*sites) + slop)
    if len(sites) != 3:
        raise ValueError("two or three detectors")
    t = [light_travel_time(sites[i], sites[(i + 1) % 3]) + slop for i in range(3)]
    return sum(2 * t[i] * t[(i + 1) % 3] - t[i] ** 2 for i in range(3))


def signal_area(sites: tuple[str, ...]) -> float:
    """Extent or area of the time differences that a signal can have: for three, an ellipse."""
    if len(sites) == 2:
        return 2 * light_travel_time(*sites)
    if len(sites) != 3:
        raise ValueError("two or three detectors")
    u, v, w = (light_travel_time(sites[i], sites[(i + 1) % 3]) for i in range(3))
    corner = math.acos((u * u + v * v - w * w) / (2 * u * v))
    return PI * u * v * math.sin(corner)


# --- fitted tails ------------------------------------------------------------------
def tail_pdf(kind: str, x, alpha, t) -> Column:
    """Density of a fitted tail; 0 below the threshold."""
    f = {"exponential": lambda: alpha * F.exp(-alpha * (x - t)), "rayleigh": lambda: alpha * x * F.exp(-alpha * (x * x - t * t) / 2), "power": lambda: (alpha - 1) * F.pow(x, -alpha) * F.pow(t, alpha - 1)}[kind]()
    return F.when(x >= t, f).otherwise(0.0)


def tail_above(kind: str, x, alpha, t) -> Column:
    """Share of a fitted tail above x; 0 below the threshold."""
    f = {"exponential": lambda: F.exp(-alpha * (x - t)), "rayleigh": lambda: F.exp(-alpha * (x * x - t * t) / 2), "power": lambda: F.pow(x, 1 - alpha) * F.pow(t, alpha - 1)}[kind]()
    return F.when(x >= t, f).otherwise(0.0)


# --- coherent rankings --------------------------------------------------------------
def network_chisq(parts: list[tuple]) -> Column:
    """Reduced chi-squares (chisq, dof, snr) weighted by squared snr."""
    whole = reduce(lambda a, b: a + b, [s * s for _, _, s in parts])
    return reduce(lambda a, b: a + b, [c / n * (s * s) / whole for c, n, s in parts])


def reweight_by_null(network, null, coherent, least=5.25, grad=0.2, step=20.0) -> Column:
    """Ranking divided down where the null part is large; threshold and divisor differ beyond step, as defined."""
    far = coherent > step
    hit = F.when(far, null > coherent * grad + (least - 1)).otherwise(null > least - 1)
    factor = F.when(far, 1 + null - (least - 1) - (coherent - step) * grad).otherwise(1 + null - (least - 1))
    return F.when(hit, network / factor).otherwise(network)


def null_kept(null, coherent, least=5.25, grad=0.2, step=20.0) -> Column:
    return F.when(coherent <= step, null < least).otherwise(null < (coherent - step) * grad + least)


# --- priors from the unit interval -----------------------------------------------------
def draw_powerlaw(u, lo: float, hi: float, dim: int = 3):
    return F.pow(u * (hi**dim - lo**dim) + lo**dim, 1.0 / dim)


def draw_log10(u, lo: float, hi: float):
    return F.pow(F.lit(10.0), u * (math.log10(hi) - math.log10(lo)) + math.log10(lo))


def draw_sin_angle(u):
    """Polar angle in [0, pi], density proportional to its sine."""
    return F.acos(1 - 2 * u)


def draw_cos_angle(u):
    """Latitude in [-pi/2, pi/2], density proportional to its cosine."""
    return F.asin(2 * u - 1)


def volume_to_distance(v):
    return F.pow(3 * v / (4 * PI), 1.0 / 3)


# --- waveforms --------------------------------------------------------------------------
def spa_amplitude(f, mc):
    """Newtonian amplitude over frequency, up to distance."""
    return F.pow(mc * MTSUN, 5.0 / 6) * F.pow(f, -7.0 / 6)


def spa_phase(f, m1, m2):
    """Stationary phase to second post-Newtonian order, no spins, no time or phase shift."""
    e = eta(m1, m2)
    v = F.pow(PI * MTSUN * (m1 + m2) * f, 1.0 / 3)
    series = 1 + (3715.0 / 756 + 55.0 / 9 * e) * v * v - 16 * PI * v * v * v + (15293365.0 / 508032 + 27145.0 / 504 * e + 3085.0 / 72 * e * e) * v * v * v * v
    return 3 / (128 * e) / F.pow(v, 5.0) * series


def ringdown(t, f0, tau, amp=1.0, phi=0.0):
    return F.when(t >= 0, amp * F.exp(-t / tau) * F.cos(2 * PI * f0 * t + phi)).otherwise(0.0)


def sine_gaussian(t, f0, quality, amp=1.0):
    w = quality / (2 * PI * f0)
    return amp * F.exp(-t * t / (2 * w * w)) * F.cos(2 * PI * f0 * t)


# --- further masses, distances and times ---------------------------------------------------
def mass2_from_mchirp_q(mc, ratio):
    return mc * F.pow(1 + ratio, 0.2) * F.pow(ratio, -0.6)


def mass2_from_mchirp_mass1(mc, m1) -> Column:
    """The real root x of x^3 = a (x + m1) with a = mc^5 / m1^3, of one or of three real ones."""
    a = F.pow(mc, 5.0) / F.pow(m1, 3.0)
    half = a * m1 / 2
    gap = half * half - F.pow(a / 3, 3.0)
    one = F.cbrt(half + F.sqrt(F.greatest(gap, F.lit(0.0)))) + F.cbrt(half - F.sqrt(F.greatest(gap, F.lit(0.0))))
    three = 2 * F.sqrt(a / 3) * F.cos(F.acos(F.least(half / F.pow(a / 3, 1.5), F.lit(1.0))) / 3)
    return F.when(gap >= 0, one).otherwise(three)


def other_mass(known, e, heavier: bool) -> Column:
    """The other mass of a binary of symmetric mass ratio e, the heavier or the lighter one."""
    root = F.sqrt(F.greatest(1 - 4 * e, F.lit(0.0)))
    return known * (1 - 2 * e + (root if heavier else -root)) / (2 * e)


def spherical_to_cartesian(rho, azimuth, polar) -> tuple[Column, Column, Column]:
    return rho * F.cos(azimuth) * F.sin(polar), rho * F.sin(azimuth) * F.sin(polar), rho * F.cos(polar)


def spherical_near(rho, azimuth, polar, near_azimuth, near_polar) -> tuple[Column, Column]:
    """The azimuth and polar angle of a direction in the turn that given ones lie in, at any number of turns; those given where the length is 0."""
    half = F.floor(near_polar / PI)
    odd = half % 2 != 0
    p = F.when(odd, (half + 1) * PI - polar).otherwise(half * PI + polar)
    a = F.when(odd, azimuth + PI).otherwise(azimuth)
    a = a + 2 * PI * F.round((near_azimuth - a) / (2 * PI))
    return F.when(rho == 0, near_azimuth).otherwise(a), F.when(rho == 0, near_polar).otherwise(p)


def effective_distance(distance, inclination, plus, cross) -> Column:
    c = F.cos(inclination)
    return distance / F.sqrt(F.pow((1 + c * c) / 2 * plus, 2.0) + F.pow(c * cross, 2.0))


def larger_power_of_two(x) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(x)))


def detector_time(site: str, unix, ra, dec) -> Column:
    """Arrival at a detector of what reaches the centre of the earth at a time."""
    return unix + delay_from_centre(site, ra, dec, gmst(unix))


#: Hubble constant in km/s/Mpc, matter share of a flat universe.
HUBBLE, MATTER = 67.74, 0.3075
#: Intervals of the distance integral (even), and Newton steps of its inverse.
INTERVALS, STEPS = 32, 8


def _rates(z, root):
    """Weighted sum of the rates of expansion from 0 to z by Simpson's rule, of a column or an array."""
    out = 1.0
    for i in range(1, INTERVALS + 1):
        x = 1 + z * (i / INTERVALS)
        out = out + (1.0 if i == INTERVALS else 4.0 if i % 2 else 2.0) / root(MATTER * (x * x * x) + (1 - MATTER))
    return out


def luminosity_distance(z) -> Column:
    """Mpc, of a flat universe of matter and a constant, by Simpson's rule."""
    return (1 + z) * (C_SI / 1000 / HUBBLE) * z / (3 * INTERVALS) * _rates(z, F.sqrt)


def redshift(distance, most: float = 10.0) -> Column:
    """Redshift of a luminosity distance in Mpc; most for what is farther. Arrow batches: steps of columns would be interpreted row by row.

    Newton steps on integral - d / (1 + z), which is concave: from the start, where the
    rates are taken as 1 and the redshift so too small, they rise to the root.
    """

    @F.pandas_udf("double")
    def inverse(distance: pd.Series) -> pd.Series:
        d = np.maximum(distance.to_numpy() / (C_SI / 1000 / HUBBLE), 0.0)
        z = np.minimum((np.sqrt(1 + 4 * d) - 1) / 2, most)
        for _ in range(STEPS):
            x = 1 + z
            slope = 1 / np.sqrt(MATTER * (x * x * x) + (1 - MATTER)) + d / (x * x)
            z = np.clip(z - (z / (3 * INTERVALS) * _rates(z, np.sqrt) - d / x) / slope, 0.0, most)
        return pd.Series(z).fillna(most)

    return F.when(distance.isNotNull(), inverse(distance))
