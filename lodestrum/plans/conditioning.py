"""Queries of conditioned series over the driver's packed arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as S
from ..operators import signal
from ..sources import tables as T
from .catalog import _FT, _XS, query, r

C = F.col


def _series(spark, d):
    return T.read(spark, d, "embeddings").select("vec_id", S.doubles("embedding").alias("x"))


def _rows(df, column: str = "y"):
    return df.select("vec_id", F.posexplode(column).alias("i", "v")).select("vec_id", C("i").cast("long").alias("i"), r(C("v")).alias("v"))


@query(f"WITH {_XS} SELECT vec_id, i - 5 AS i, round(v, 6) AS v FROM x WHERE i >= 5 AND i < 54")
def cropped_series(spark, d):
    return _rows(_series(spark, d).withColumn("y", S.crop("x", 5, 10)))


@query(f"WITH {_XS} SELECT vec_id, i - 8 AS i, round(v, 6) AS v FROM x WHERE i >= 8 AND i < 24")
def time_sliced_series(spark, d):
    """Quarter-second samples from 102 to 106 s of a series that begins at 100 s."""
    return _rows(_series(spark, d).withColumn("y", S.time_slice("x", 100.0, 0.25, 102.0, 106.0)))


@query(f"WITH {_XS} SELECT vec_id, (i + 61) % 64 AS i, round(v, 6) AS v FROM x")
def rolled_series(spark, d):
    return _rows(_series(spark, d).withColumn("y", S.rolled("x", -3)))


@query(f"WITH {_XS} SELECT a.vec_id, a.i, round(a.v + coalesce(b.v, 0), 6) AS v FROM x a LEFT JOIN x b ON b.vec_id = a.vec_id AND b.i = a.i - 40")
def injected_series(spark, d):
    """A signal (here the series itself) added from sample 40 on, cut off at the end."""
    return _rows(_series(spark, d).withColumn("y", S.added_at("x", C("x"), 40)))


@query(f"WITH {_XS} SELECT vec_id, i, round(v - avg(v) OVER (PARTITION BY vec_id), 6) AS v FROM x")
def series_without_mean(spark, d):
    return _rows(_series(spark, d).withColumn("y", S.without_mean(C("x"))))


@query(f"WITH {_XS}, l AS (SELECT vec_id, regr_slope(v, i) AS s, regr_intercept(v, i) AS c FROM x GROUP BY vec_id) SELECT vec_id, i, round(v - s * i - c, 6) AS v FROM x JOIN l USING (vec_id)")
def series_without_line(spark, d):
    return _rows(_series(spark, d).withColumn("y", S.without_line(C("x"))))


@query(f"WITH {_XS} SELECT vec_id, i, round(v * CASE WHEN i >= 20 AND i < 30 THEN 0 WHEN i >= 16 AND i < 20 THEN 0.5 * (1 - cos(pi() * (20 - i) / 5)) WHEN i >= 30 AND i < 34 THEN 0.5 * (1 - cos(pi() * (i - 29) / 5)) ELSE 1 END, 6) AS v FROM x")
def gated_series(spark, d):
    return _rows(_series(spark, d).withColumn("y", S.gated("x", 20, 30, 4)))


@query(f"WITH {_XS} SELECT a.vec_id, k AS i, round(a.v + (b.v - a.v) * (k * 0.75 - floor(k * 0.75)), 6) AS v FROM range(0, 84) g(k), x a JOIN x b ON b.vec_id = a.vec_id AND b.i = least(a.i + 1, 63) WHERE a.i = floor(k * 0.75)")
def interpolated_spectrum(spark, d):
    """Values a step of three quarters apart, on lines between the given ones."""
    return _rows(_series(spark, d).withColumn("y", S.resampled_line(C("x"), 0.75, 84)))


@query(f"WITH {_XS} SELECT vec_id, i // 10 AS i, round(avg(v * v), 6) AS v FROM x WHERE i < 60 GROUP BY 1, 2")
def mean_squares(spark, d):
    return _rows(_series(spark, d).withColumn("y", S.mean_square("x", 10)))


def _taps_sql(cutoff: float, n: int, beta: float) -> str:
    h = n // 2
    sinc = f"CASE WHEN k = 0 THEN 1 ELSE sin(pi() * {cutoff} * k) / (pi() * {cutoff} * k) END"
    raw = f"SELECT k, {cutoff} * {sinc} * list_sum(list_transform(range(0, 30), lambda j: pow({beta} * sqrt(1 - k * k / {h * h}.0) / 2, 2 * j) / pow(gamma(j + 1), 2))) / list_sum(list_transform(range(0, 30), lambda j: pow({beta} / 2.0, 2 * j) / pow(gamma(j + 1), 2))) AS w FROM range({-h}, {h + 1}) g(k)"
    return f"(SELECT k, w / sum(w) OVER () AS w FROM ({raw}))"


def _fir_sql(taps: str) -> str:
    return f"WITH {_XS}, t AS {taps} SELECT o.vec_id, o.i, round(CASE WHEN o.i >= 5 AND o.i < 59 THEN (SELECT sum(w * x.v) FROM t JOIN x ON x.vec_id = o.vec_id AND x.i = o.i + t.k) ELSE 0 END, 6) AS v FROM x o"


_LOW = _taps_sql(0.25, 11, 5.0)


@query(_fir_sql(_LOW))
def lowpass_series(spark, d):
    return _rows(_series(spark, d).withColumn("y", S.filtered("x", S.lowpass_taps(0.25, 11))))


@query(_fir_sql(f"(SELECT k, CASE WHEN k = 0 THEN 1 ELSE 0 END - w AS w FROM {_LOW})"))
def highpass_series(spark, d):
    return _rows(_series(spark, d).withColumn("y", S.filtered("x", S.highpass_taps(0.25, 11))))


@query(_fir_sql(f"(SELECT a.k, a.w + CASE WHEN a.k = 0 THEN 1 ELSE 0 END - b.w AS w FROM {_LOW} a JOIN {_taps_sql(0.6, 11, 5.0)} b USING (k))"))
def notched_series(spark, d):
    return _rows(_series(spark, d).withColumn("y", S.filtered("x", S.notch_taps(0.25, 0.6, 11))))


@query(_fir_sql(_LOW).replace("SELECT o.vec_id, o.i,", "SELECT o.vec_id, o.i // 2 AS i,") + " WHERE o.i % 2 = 0")
def halved_rate(spark, d):
    """Lowpassed, then every second sample."""
    low = S.filtered("x", S.lowpass_taps(0.25, 11))
    return _rows(_series(spark, d).withColumn("y", F.filter(low, lambda v, i: i % 2 == 0)))


@query(f"""WITH {_XS}, {_FT}, w AS (SELECT vec_id, f, re / sqrt(1 + f) AS re, im / sqrt(1 + f) AS im FROM f) SELECT vec_id, i, round(sqrt(2) / 64 * sum(CASE WHEN f IN (0, 32) THEN re * cos(2 * pi() * f * i / 64) ELSE 2 * (re * cos(2 * pi() * f * i / 64) - im * sin(2 * pi() * f * i / 64)) END), 6) AS v FROM w, range(0, 64) g(i) GROUP BY vec_id, i""")
def whitened_series(spark, d):
    """Divided by the root of a spectrum that rises by one a bin."""
    import numpy as np

    return _rows(signal.whitened(_series(spark, d), "x", 1.0 + np.arange(33), ["vec_id"]), "white")
