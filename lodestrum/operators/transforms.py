"""Changes of parameters with their Jacobians, and priors over several parameters, as Columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as L
from ..functions import physics as P
from . import tables


@dataclass
class Transform:
    """outputs from inputs; jacobian is the size of the determinant of the outputs' derivatives, of the input columns."""

    inputs: list[str]
    outputs: list[str]
    make: Callable[..., tuple[Column, ...]]
    jacobian: Callable[..., Column] | None = None


def mchirp_q_to_masses() -> Transform:
    return Transform(["mchirp", "q"], ["mass1", "mass2"], lambda mc, q: (L.mass1_from_mchirp_q(mc, q), P.mass2_from_mchirp_q(mc, q)), lambda mc, q: mc * F.pow((1 + q) / F.pow(q, 3.0), 0.4))


def masses_to_mchirp_q() -> Transform:
    return Transform(["mass1", "mass2"], ["mchirp", "q"], lambda a, b: (L.mchirp(a, b), a / b), lambda a, b: L.mchirp(a, b) / (b * b))


def masses_to_mchirp_eta() -> Transform:
    return Transform(["mass1", "mass2"], ["mchirp", "eta"], lambda a, b: (L.mchirp(a, b), L.eta(a, b)), lambda a, b: F.abs(a - b) / F.pow(a + b, 2.0) * F.pow(L.eta(a, b), 0.6))


def mchirp_eta_to_masses() -> Transform:
    def jacobian(mc, e):
        total = mc / F.pow(e, 0.6)
        return total / (F.pow(e, 0.6) * F.sqrt(1 - 4 * e))

    return Transform(["mchirp", "eta"], ["mass1", "mass2"], P.masses_from_mchirp_eta, jacobian)


def logarithm(name: str, out: str) -> Transform:
    return Transform([name], [out], lambda x: (F.log(x),), lambda x: 1 / F.abs(x))


def exponent(name: str, out: str) -> Transform:
    return Transform([name], [out], lambda x: (F.exp(x),), lambda x: F.exp(x))


def logit(name: str, out: str, lo: float = 0.0, hi: float = 1.0) -> Transform:
    return Transform([name], [out], lambda x: (L.logit(x, lo, hi),), lambda x: (hi - lo) / ((x - lo) * (hi - x)))


def logistic(name: str, out: str, lo: float = 0.0, hi: float = 1.0) -> Transform:
    return Transform([name], [out], lambda y: (L.logistic(y, lo, hi),), lambda y: F.exp(y) * (hi - lo) / F.pow(1 + F.exp(y), 2.0))


def spherical(x: str, y: str, z: str, rho: str, azimuth: str, polar: str) -> Transform:
    return Transform([rho, azimuth, polar], [x, y, z], P.spherical_to_cartesian, lambda r, a, p: r * r * F.sin(p))


def cartesian(x: str, y: str, z: str, rho: str, azimuth: str, polar: str) -> Transform:
    return Transform([x, y, z], [rho, azimuth, polar], L.cartesian_to_spherical, lambda a, b, c: 1 / (F.sqrt(a * a + b * b + c * c) * F.sqrt(a * a + b * b)))


def custom(inputs: list[str], outputs: dict[str, str], jacobian: str | None = None) -> Transform:
    """From SQL text for each output."""
    made = lambda *_: tuple(F.expr(e) for e in outputs.values())
    return Transform(inputs, list(outputs), made, (lambda *_: F.expr(jacobian)) if jacobian else None)


def ordered(transforms: list[Transform], have: list[str]) -> list[Transform]:
    """The transforms in an order in which each finds its inputs; those that never do are an error."""
    have, left, out = set(have), list(transforms), []
    while left:
        ready = [t for t in left if have.issuperset(t.inputs)]
        if not ready:
            raise ValueError(f"no inputs for {[t.outputs for t in left]}")
        out += ready
        have.update(o for t in ready for o in t.outputs)
        left = [t for t in left if t not in ready]
    return out


def needed(wanted: list[str], have: list[str], known: list[Transform]) -> list[Transform]:
    """Of the known transforms those that lead from what a table has to what is wanted, in order; the first known way counts."""

    def way(name: str, above: frozenset[str]) -> list[Transform] | None:
        if name in have:
            return []
        for t in known:
            if name in t.outputs and not above.intersection(t.inputs):
                parts = [way(i, above | {name}) for i in t.inputs]
                if all(p is not None for p in parts):
                    return [x for p in parts for x in p] + [t]
        return None

    out: list[Transform] = []
    for w in wanted:
        found = way(w, frozenset())
        if found is None:
            raise ValueError(f"nothing leads to {w}")
        out += [t for t in found if t not in out]
    return out


def apply(d: DataFrame, transforms: list[Transform], jacobian: str | None = None) -> DataFrame:
    """d with the outputs of all transforms, in order of need; jacobian names a column for the product of theirs."""
    if jacobian:
        d = d.withColumn(jacobian, F.lit(1.0))
    for t in ordered(transforms, d.columns):
        parts = [F.col(i) for i in t.inputs]
        made = dict(zip(t.outputs, t.make(*parts), strict=True))
        if jacobian:
            if t.jacobian is None:
                raise ValueError(f"no jacobian for {t.outputs}")
            made[jacobian] = F.col(jacobian) * F.abs(t.jacobian(*parts))
        d = d.withColumns(made)
    return d


# --- priors --------------------------------------------------------------------------------
@dataclass
class Prior:
    """Density of one parameter: its log (null for none outside), and a draw from a number in [0, 1)."""

    name: str
    log_density: Callable[[Column], Column]
    draw: Callable[[Column], Column]


def _within(x: Column, lo: float, hi: float, value: Column) -> Column:
    return F.when((x >= lo) & (x < hi), value)


def uniform(name: str, lo: float, hi: float) -> Prior:
    return Prior(name, lambda x: _within(x, lo, hi, F.lit(-math.log(hi - lo))), lambda u: lo + u * (hi - lo))


def uniform_log10(name: str, lo: float, hi: float) -> Prior:
    return Prior(name, lambda x: _within(x, lo, hi, -F.log(x * math.log(hi / lo))), lambda u: P.draw_log10(u, lo, hi))


def power_law(name: str, lo: float, hi: float, dim: int = 3) -> Prior:
    """Uniform in the volume of so many dimensions; 2 is a disk's, and that of chirp mass for uniform masses."""
    return Prior(name, lambda x: _within(x, lo, hi, F.log(dim * F.pow(x, dim - 1.0) / (hi**dim - lo**dim))), lambda u: P.draw_powerlaw(u, lo, hi, dim))


def gaussian(name: str, mean: float, sd: float, lo: float = -math.inf, hi: float = math.inf) -> Prior:
    """Normal, cut to [lo, hi) and normed there; drawn by a polynomial for its inverse where it is not cut."""
    part = 0.5 * (math.erf((hi - mean) / sd / math.sqrt(2)) - math.erf((lo - mean) / sd / math.sqrt(2)))
    return Prior(name, lambda x: _within(x, lo, hi, L.normal_logpdf(x, mean, F.lit(sd)) - math.log(part)), lambda u: mean + sd * normal_quantile(F.lit(0.5 * (1 + math.erf((lo - mean) / sd / math.sqrt(2)))) + u * part))


def sin_angle(name: str) -> Prior:
    return Prior(name, lambda x: _within(x, 0.0, math.pi, F.log(F.sin(x) / 2)), P.draw_sin_angle)


def cos_angle(name: str) -> Prior:
    return Prior(name, lambda x: _within(x, -math.pi / 2, math.pi / 2, F.log(F.cos(x) / 2)), P.draw_cos_angle)


def sky(azimuth: str, latitude: str) -> list[Prior]:
    """Even over the sphere."""
    return [uniform(azimuth, 0.0, 2 * math.pi), cos_angle(latitude)]


#: A rational approximation of the normal quantile, good to 1e-9: numerators and denominators of its middle and its tails.
_MID = ([-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239], [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0])
_TAIL = ([-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783], [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0])


def normal_quantile(u: Column) -> Column:
    horner = lambda c, x: reduce(lambda a, b: a * x + b, c[1:], F.lit(c[0]))
    low = F.least(u, 1 - u)
    t = F.sqrt(-2 * F.log(low))
    tail = horner(_TAIL[0], t) / horner(_TAIL[1], t)
    m = u - 0.5
    return F.when(low >= 0.02425, horner(_MID[0], m * m) * m / horner(_MID[1], m * m)).when(u < 0.5, tail).otherwise(-tail)


#: Draws looked at together for a number, of which the first that meets the constraints counts.
TRIES = 16


@dataclass
class Joint:
    """Independent priors, and constraints (SQL text, derived names allowed) on all of them."""

    priors: list[Prior]
    constraints: list[str] = field(default_factory=list)

    def log_density(self, d: DataFrame, out: str = "logp") -> DataFrame:
        """d with the log density, minus infinity outside a bound or constraint; the constraints' share of the volume is not divided out."""
        d = tables.with_names(d, self.constraints)
        total = reduce(lambda a, b: a + b, [p.log_density(F.col(p.name)) for p in self.priors])
        inside = reduce(lambda a, b: a & b, [F.coalesce(F.expr(c), F.lit(False)) for c in self.constraints], F.lit(True))
        return d.withColumn(out, F.coalesce(F.when(inside, total), F.lit(-math.inf)))

    def draws(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """n draws that meet the constraints, by their number. Each is a hash of seed, number and try, so any task can make it anew."""
        u = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_try", F.lit(k), "id"), 11).cast("double") + 0.5) / float(1 << 53)
        drawn = lambda d: d.select("id", "_try", *[p.draw(u(k)).alias(p.name) for k, p in enumerate(self.priors)])
        names = [p.name for p in self.priors]
        if not self.constraints:
            return drawn(spark.range(n).withColumn("_try", F.lit(0))).drop("_try")
        wanted, out = spark.range(n), None
        for turn in range(0, 64 * TRIES, TRIES):
            made = drawn(wanted.withColumn("_try", F.explode(F.sequence(F.lit(turn), F.lit(turn + TRIES - 1)))))
            good = tables.constrained(made, self.constraints).groupBy("id").agg(F.min_by(F.struct(*names), "_try").alias("x")).select("id", "x.*")
            out = good if out is None else out.union(good)
            wanted = wanted.join(good.select("id"), "id", "left_anti")
            if wanted.isEmpty():
                return out
        raise RuntimeError("the constraints leave nearly nothing")


def mass_ratio_prior(name: str, lo: float, hi: float) -> Prior:
    """Mass ratio (at least 1) for masses that are uniform each; normed by Simpson's rule, drawn from a table of its integral."""
    import numpy as np

    x = np.linspace(lo, hi, 2001)
    p = ((1 + x) / x**3) ** 0.4
    upto = np.concatenate([[0.0], np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(x))])
    total = float((p[0] + p[-1] + 4 * p[1:-1:2].sum() + 2 * p[2:-1:2].sum()) * (x[1] - x[0]) / 3)
    # A draw is a value on the table's inverse, 64 lines.
    u = np.linspace(0, 1, 65)
    at = F.array(*[F.lit(float(v)) for v in np.interp(u, upto / upto[-1], x)])
    return Prior(name, lambda q: _within(q, lo, hi, 0.4 * F.log((1 + q) / F.pow(q, 3.0)) - math.log(total)), lambda v: L.at_linear(at, v * 64))


def hexagonal(spark: SparkSession, lo: tuple[float, float], hi: tuple[float, float], distance: float) -> DataFrame:
    """Points (x, y) of a plane such that none of the box is farther than distance from one; rows shifted by half a step."""
    dx, dy = distance * math.sqrt(3), distance * 1.5
    wide, high = int((hi[0] - lo[0]) / dx) + 2, int((hi[1] - lo[1]) / dy) + 2
    rows = spark.range(high).select(F.col("id").alias("j")).select("j", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("i"))
    return rows.select((lo[0] + dx * F.col("i") + F.when(F.col("j") % 2 == 1, dx / 2).otherwise(0.0) - dx / 2).alias("x"), (lo[1] + dy * F.col("j")).alias("y"))
