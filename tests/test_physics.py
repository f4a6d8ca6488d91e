"""Geometry and tails against what holds of them whatever the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from lodestrum.functions import physics as P


def test_light_travel_time():
    assert P.light_travel_time("H1", "L1") == pytest.approx(0.010013, abs=1e-6)


def test_pattern_is_bounded_and_turns_with_polarization(spark):
    d = spark.range(50).select((F.col("id") * 0.37).alias("ra"), F.sin("id").alias("dec"), (F.col("id") * 0.11).alias("psi"))
    a, b = P.antenna_pattern("H1", d["ra"], d["dec"], d["psi"], F.lit(1.0)), P.antenna_pattern("H1", d["ra"], d["dec"], d["psi"] + math.pi / 2, F.lit(1.0))
    for p, x, p2, x2 in d.select(a[0], a[1], b[0], b[1]).toDF("p", "x", "p2", "x2").collect():
        assert p * p + x * x <= 1 + 1e-6
        assert (p2, x2) == pytest.approx((-p, -x), abs=1e-9)


def test_sidereal_time_at_j2000(spark):
    got = spark.range(1).select(P.gmst(F.lit(946728000.0))).first()[0]
    assert math.degrees(got) == pytest.approx(280.4606, abs=1e-3)


def test_gps_epochs(spark):
    got = spark.createDataFrame([(1126259445,)], "g long").select((F.col("g") + P.GPS_EPOCH).alias("u"), "g")
    assert [r[0] for r in got.select(P.gps_from_unix(F.col("u") - 17)).collect()][0] == 1126259445


def test_masses_round_trip(spark):
    m1, m2 = P.masses_from_mchirp_eta(F.lit(30.0), F.lit(0.24))
    a, b = spark.range(1).select(m1, m2).first()
    assert a * b / (a + b) ** 2 == pytest.approx(0.24)
    assert (a * b) ** 0.6 / (a + b) ** 0.2 == pytest.approx(30.0)
    assert a > b


@pytest.mark.parametrize("kind,alpha", [("exponential", 0.5), ("rayleigh", 0.3), ("power", 3.0)])
def test_density_is_slope_of_tail(spark, kind, alpha):
    x = F.col("id") * 0.7 + 5.0
    a, t, h = F.lit(alpha), F.lit(5.0), 1e-5
    d = spark.range(10).select(P.tail_pdf(kind, x + h / 2, a, t), (P.tail_above(kind, x, a, t) - P.tail_above(kind, x + h, a, t)) / h)
    for p, slope in d.collect():
        assert p == pytest.approx(slope, rel=1e-4, abs=1e-9)
