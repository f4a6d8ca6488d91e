"""Ordered passes in small blocks and bins against plain loops, parsing of cuts, formulas against numbers worked out apart."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrum.functions import columns as L
from lodestrum.functions import physics as P
from lodestrum.functions import series as S
from lodestrum.operators import bins, clustering, diagnostics, intervals, ordered, signal, significance, tables, transforms
from lodestrum.plans import catalog, conditioning, extended, files, further, parameters, ranking, selection, statistics  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_interval_algebra_in_small_blocks(spark):
    rng = np.random.default_rng(1)
    a, b = ([(int(s), int(s + n)) for s, n in zip(rng.integers(0, 400, 40), rng.integers(0, 25, 40), strict=True)] for _ in range(2))

    def points(iv):
        return {x for s, e in iv for x in range(s, e)}

    def pieces(p):
        return sorted((x, next(y for y in range(x, 10_000) if y not in p)) for x in p if x - 1 not in p)

    frame = lambda iv: spark.createDataFrame(iv, "start long, end long")
    got = lambda d: sorted(map(tuple, d.collect()))
    for block in (7, 50, 10_000):
        assert got(intervals.coalesce(frame(a), block=block)) == pieces(points(a))
        assert got(intervals.intersect(frame(a), frame(b), block=block)) == pieces(points(a) & points(b))
        assert got(intervals.subtract(frame(a), frame(b), block=block)) == pieces(points(a) - points(b))


def test_runs_and_clusters_in_small_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(t), float(s), int(k)) for i, (t, s, k) in enumerate(zip(rng.integers(0, 600, 80), rng.integers(0, 9, 80), rng.integers(0, 2, 80), strict=True))]
    d = spark.createDataFrame(rows, "id long, t long, stat double, k long")
    want = {}
    for key in (0, 1):
        last = begin = None
        for i, t, _, _ in sorted((r for r in rows if r[3] == key), key=lambda r: r[1]):
            begin = t if last is None or t - last > 5 else begin
            last, want[i] = t, begin
    for block in (3, 40, 10_000):
        assert {r["id"]: r["_run"] for r in ordered.runs(d, 5, "k", block=block).collect()} == want
        near = [r for r in rows if not any(x[3] == r[3] and r[1] - 9 <= x[1] < r[1] + 9 and (-x[2], x[1], x[0]) < (-r[2], r[1], r[0]) for x in rows)]
        assert sorted(r["id"] for r in clustering.cluster_over_time(d, 9, "k", block=block).collect()) == sorted(r[0] for r in near)


def test_sums_and_neighbours_in_small_bins(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(w), k) for k in "ab" for x, w in zip(rng.choice(5000, 300, replace=False), rng.integers(1, 5, 300), strict=True)]
    d = spark.createDataFrame(rows, "stat double, w double, k string")
    for r in ordered.sum_from_top(d, "stat", "w", "k", rows=20).collect():
        assert r["total"] == sum(w for x, w, k in rows if k == r["k"] and x >= r["stat"])
    one = d.where("k = 'a'")
    for r in ordered.sum_from_top(one, "stat", "w", rows=20).collect():
        assert r["total"] == sum(w for x, w, k in rows if k == "a" and x >= r["stat"])
    assert one.select(ordered.value_bin(one, "stat", 20).alias("b")).distinct().count() > 10
    x = sorted(x for x, _, k in rows if k == "a")
    got = {r["stat"]: (r["_prev"], r["_next"]) for r in ordered.with_neighbours(one, "stat", "w", rows=20).collect()}
    assert got == {v: (x[i - 1] if i else None, x[i + 1] if i + 1 < len(x) else None) for i, v in enumerate(x)}


@pytest.mark.parametrize("name", ["coincidence_far", "louder_background", "segments_intersected", "segments_subtracted", "except_foreground", "cluster_over_time", "split_bank", "findchirp_cluster", "clustered_networks", "false_alarm_rates"])
def test_no_window_over_everything(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # A pass over pieces that touch the borders of blocks, two for each, may stand in one task.
    one_task = plan.count("Exchange SinglePartition")
    assert one_task <= (1 if "segments" in name or name == "except_foreground" else 0)


def test_count_louder_counts(spark):
    bg = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (3.0, 1.0), (float("nan"), 4.0)], "stat double, weight double")
    fg = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 2.0), (4, 3.0), (5, 9.0)], "id long, stat double")
    got = {r["id"]: r["louder"] for r in significance.count_louder(fg, bg).collect()}
    assert got == {1: 4.0, 2: 4.0, 3: 1.0, 4: 1.0, 5: 0.0}  # the NaN row is quietest of all and lies below
    none = significance.count_louder(fg, bg.limit(0)).collect()
    assert [r["louder"] for r in none] == [None] * 5


def test_cuts():
    assert tables.parse_cuts(["a:1:lower", "a:2:lower", "a:5:upper_inc", "a:5:upper", "b:3:upper", "b:4:upper_inc"]) == {("a", "lower"): 2.0, ("a", "upper"): 5.0, ("b", "upper"): 3.0}
    with pytest.raises(ValueError):
        tables.parse_cuts(["a:1:below"])


def test_expression_reads_only_what_it_names(spark):
    d = catalog.T.read(spark, SF, "lineitem")
    plan = tables.select(d, ["l_orderkey", "l_quantity * 2 AS x"], "l_tax > 0.05 AND l_returnflag = 'l_comment mchirp'")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "l_discount" not in schema and "l_shipdate" not in schema and "PushedFilters: [IsNotNull(l_tax)" in plan
    with pytest.raises(ValueError):
        tables.with_names(d, ["a"], {"a": (("b",), lambda b: b), "b": (("a",), lambda a: a)})


def test_gelman_rubin_and_geweke_formulas(spark):
    rng = np.random.default_rng(4)
    chains = rng.normal(size=(3, 50)) + np.arange(3)[:, None] * 0.2
    d = spark.createDataFrame([(c, i, float(x)) for c, row in enumerate(chains) for i, x in enumerate(row)], "c long, i long, x double")
    m, n = chains.shape
    means, var = chains.mean(axis=1), chains.var(axis=1, ddof=1)
    w, b = var.mean(), n * means.var(ddof=1)
    v = (n - 1) * w / n + (1 + 1 / m) * b / n
    cross = n / m * (np.cov(var, means**2)[0, 1] - 2 * means.mean() * np.cov(var, means)[0, 1])
    spread = ((n - 1) ** 2 * var.var() + (1 + 1 / m) ** 2 * 2 * b**2 / (m - 1) + 2 * (n - 1) * (1 + 1 / m) * cross) / n**2
    dof = 2 * v**2 / spread
    assert diagnostics.gelman_rubin(d, "c", "x").first()[0] == pytest.approx(math.sqrt(((n - 1) / n + (1 + 1 / m) / n * b / w) * (dof + 3) / (dof + 1)))
    for r in diagnostics.geweke(d, "i", "x", 10, 5, 22, 25, "c").collect():
        x = chains[r["c"]]
        a, e = x[r["start"] : r["start"] + 10], x[25:]
        assert r["z"] == pytest.approx((a.mean() - e.mean()) / math.sqrt(a.var() + e.var()))


def test_variation_below_the_least_counts_as_none(spark):
    f = spark.range(1).select(L.newsnr_psdvar_scaled(F.lit(8.0), F.lit(2.0), F.lit(16.0), F.lit(0.5)), L.newsnr_psdvar_threshold(F.lit(8.0), F.lit(11.0), F.lit(1.0), F.lit(1.0)), L.newsnr_psdvar(F.lit(8.0), F.lit(0.5), F.lit(1.0), F.lit(4.0))).first()
    assert f[0] == pytest.approx(8 * (0.5 * 9) ** (-1 / 6) / 2) and f[1] == 1.0 and f[2] == pytest.approx(4.0)
    with pytest.raises(ValueError):
        L.ranking("loudest", F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))


def test_matched_filter_finds_a_template_at_its_norm(spark):
    rng = np.random.default_rng(5)
    t = rng.normal(size=64)
    psd = 1 + rng.random(33)
    d = spark.createDataFrame([(1, np.roll(t, 9).tolist()), (2, (3 * t).tolist())], "i long, x array<double>")
    got = {r["i"]: r for r in signal.matched_filter(d, "x", t, ["i"], psd, 0.05, 0.4).collect()}
    norm = math.sqrt(signal.sigmasq(t, psd, 0.05, 0.4))
    # Real filtering over positive frequencies: the modulus at the template's own time is its norm.
    assert got[1]["peak"] == pytest.approx(norm) and got[1]["at"] == 9
    assert got[2]["peak"] == pytest.approx(3 * norm) and got[2]["at"] == 0
    c = {r["i"]: r["chisq"] for r in signal.power_chisq(d, "x", t, 4, ["i"], psd, 0.05, 0.4).collect()}
    assert c[2] == pytest.approx(9 * c[1]) and c[1] < norm**2  # uneven bins leave little
    assert all(r["match"] == pytest.approx(1) for r in signal.match(d, "x", t, ["i"], psd).collect())
    with pytest.raises(ValueError):
        signal.cutoffs(0.3, 0.2, 64, 1 / 64)


def test_welch_of_uneven_length(spark):
    x = np.random.default_rng(6).normal(size=45)
    d = spark.createDataFrame([(1, x.tolist())], "i long, x array<double>")
    for average in ("mean", "median", "median-mean"):
        got = np.array(signal.welch(d, "x", ["i"], 16, 8, average).first()["psd"])
        w = np.hanning(16)
        s = np.array([np.abs(np.fft.rfft(x[3 + a : 19 + a] * w)) ** 2 for a in (0, 8, 16, 24)]) * 2 / (w**2).sum()  # five spare samples: three before, two after
        s[:, [0, -1]] /= 2
        bias = {2: 1.0, 4: 1 - 1 / 2 + 1 / 3}
        want = {"mean": s.mean(axis=0), "median": np.median(s, axis=0) / bias[4], "median-mean": (np.median(s[::2], axis=0) + np.median(s[1::2], axis=0)) / 2 / bias[2]}[average]
        assert np.allclose(got, want)


def test_truncated_inverse_is_short():
    psd = 1 + np.random.default_rng(7).random(65)
    q = np.fft.irfft(1 / np.sqrt(signal.truncated_inverse(psd, 16)), 128)
    assert np.abs(np.fft.irfft(np.sqrt(np.abs(np.fft.rfft(q)) ** 2))).max() > 0
    assert len(signal.truncated_inverse(psd, 16)) == 65


def test_gps_round_trip_over_all_leaps(spark):
    days = [P.GPS_EPOCH, *P._leaps()]
    at = [x + k for x in days for k in (-2, -1, 0, 1, 10_000_000)]
    d = spark.createDataFrame([(x,) for x in at], "u long")
    for u, g, back in d.select("u", P.gps_from_unix(F.col("u")), P.unix_from_gps(P.gps_from_unix(F.col("u")))).collect():
        assert (g is None) == (u < P.GPS_EPOCH)
        if g is not None:
            assert g == u - P.GPS_EPOCH + sum(u >= x for x in P._leaps()) and back == u


def test_antenna_pattern_from_axes(spark):
    """Against the tensor in a frame built by turning the axes, and the sum of squares that no polarization changes."""
    d = np.array(P.tensor("H1"))
    for ra, dec, psi, st in [(0.3, 0.2, 0.0, 1.0), (2.0, -1.1, 0.7, 4.0), (5.5, 1.3, 2.2, 0.1)]:
        g = st - ra
        turn_z = lambda a: np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
        turn_y = lambda a: np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
        # From a wave that comes from the pole to one from (ra, dec), turned about its way by psi.
        frame = turn_z(-g) @ turn_y(math.pi / 2 - dec) @ turn_z(-psi - math.pi / 2)
        x, y = frame[:, 0], frame[:, 1]
        a, b = P.antenna_pattern("H1", F.lit(ra), F.lit(dec), F.lit(psi), F.lit(st))
        p, c = spark.range(1).select(a, b).first()
        assert p == pytest.approx(x @ d @ x - y @ d @ y, abs=1e-12)
        assert abs(c) == pytest.approx(abs(2 * x @ d @ y), abs=1e-12)


def test_bins_and_transforms(spark):
    with pytest.raises(ValueError):
        bins.Bins([1, 1])
    assert bins.Log(1, 100, 2).centres() == pytest.approx([math.sqrt(10), 10**1.5])
    with pytest.raises(ValueError):
        transforms.ordered([transforms.logarithm("x", "y")], ["z"])
    with pytest.raises(ValueError):
        transforms.needed(["mass1"], ["q"], [transforms.mchirp_q_to_masses()])
    # Jacobians against differences.
    d = spark.createDataFrame([(30.0, 0.4), (5.0, 0.9)], "mchirp double, q double")
    h = 1e-6
    for t in (transforms.mchirp_q_to_masses(), transforms.masses_to_mchirp_q(), transforms.masses_to_mchirp_eta(), transforms.mchirp_eta_to_masses()):
        x = (d.withColumn("q", F.col("q") / 4) if "eta" in t.inputs else d).toDF(*t.inputs)
        a, b = (F.col(c) for c in t.inputs)
        f, fa, fb = t.make(a, b), t.make(a + h, b), t.make(a, b + h)
        j = (fa[0] - f[0]) / h * (fb[1] - f[1]) / h - (fb[0] - f[0]) / h * (fa[1] - f[1]) / h
        for got, want in x.select(t.jacobian(a, b), F.abs(j)).collect():
            assert got == pytest.approx(want, rel=1e-3)
    u = [0.001, 0.01, 0.3, 0.5, 0.77, 0.999]
    q = [r[0] for r in spark.createDataFrame([(x,) for x in u], "u double").select(transforms.normal_quantile(F.col("u"))).collect()]
    assert [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in q] == pytest.approx(u, abs=1e-8)


def test_taps():
    low = S.lowpass_taps(0.25, 31)
    assert sum(low) == pytest.approx(1) and low == low[::-1]
    gain = lambda taps, f: abs(sum(t * np.exp(1j * math.pi * f * k) for k, t in enumerate(taps)))
    assert gain(low, 0.9) < 0.01 and gain(S.highpass_taps(0.25, 31), 0.9) == pytest.approx(1, abs=0.01)
    assert gain(S.notch_taps(0.3, 0.7, 61), 0.5) < 0.02


def test_files_of_few_templates_are_opened(spark, tmp_path):
    from lodestrum.sources import files as S_

    t = catalog.T.triggers(spark, SF)
    S_.write_triggers(t, f"{tmp_path}/x")
    d = S_.read_triggers(spark, f"{tmp_path}/x", ["view"], [3])
    assert "PartitionFilters: [" in d._jdf.queryExecution().executedPlan().toString() and len(d.inputFiles()) <= 1 or d.count() == t.where("k = 'view' and tid = 3").count()
