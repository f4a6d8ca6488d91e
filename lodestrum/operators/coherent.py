"""Networks of detectors taken together: coherent and coincident signal to noise as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def coincident_snr(series: list[tuple[Column, Column]]) -> Column:
    """Root of the summed squares of the detectors' complex values (re, im)."""
    return F.sqrt(_sum([a * a + b * b for a, b in series]))


def projection(sigmas: list[Column], plus: list[Column], cross: list[Column]) -> tuple[list[list[Column]], Column]:
    """Matrix onto the plane of the two responses, each weighed by its detector's sensitivity; and its determinant, 0 if they are alike."""
    p, x = [s * f for s, f in zip(sigmas, plus, strict=True)], [s * f for s, f in zip(sigmas, cross, strict=True)]
    a, b, c = _sum([v * v for v in p]), _sum([v * w for v, w in zip(p, x, strict=True)]), _sum([v * v for v in x])
    det = a * c - b * b
    return [[(c * p[i] * p[j] - b * (p[i] * x[j] + x[i] * p[j]) + a * x[i] * x[j]) / det for j in range(len(p))] for i in range(len(p))], det


def coherent_snr(series: list[tuple[Column, Column]], sigmas: list[Column], plus: list[Column], cross: list[Column]) -> Column:
    """Size of the detectors' complex values after projection onto what one source can cause; null if the responses are alike."""
    m, det = projection(sigmas, plus, cross)
    n = range(len(series))
    square = _sum([m[i][j] * (series[i][0] * series[j][0] + series[i][1] * series[j][1]) for i in n for j in n])
    return F.when(det > 1e-12, F.sqrt(F.greatest(square, F.lit(0.0))))
