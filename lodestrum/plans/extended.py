"""Further queries: geometry, tails, bins, rates, smoothing, evidence and waveforms over the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as L
from ..functions import physics as P
from ..sources import tables as T
from .catalog import SEC, query, r

C = F.col
M1, M2 = "(l_extendedprice / 1e4)", "(l_quantity * 1.0)"
MT = f"(4.925490947641267e-06 * ({M1} + {M2}))"
ETA = f"({M1} * {M2} / (({M1} + {M2}) * ({M1} + {M2})))"
RQ = f"(least({M1}, {M2}) / greatest({M1}, {M2}))"


def _lines(spark, d):
    return T.read(spark, d, "lineitem"), C("l_extendedprice") / 1e4, C("l_quantity") * 1.0


@query(f"""SELECT l_orderkey, l_linenumber, round(1 / (160 * {ETA}) / pow(pi() * {MT} * 20, 2.0/3), 6) AS tau3,
 round(CASE WHEN {M1} >= {M2} THEN greatest(l_discount, {RQ} * (4 * {RQ} + 3) / (4 + 3 * {RQ}) * l_tax) ELSE greatest(l_tax, {RQ} * (4 * {RQ} + 3) / (4 + 3 * {RQ}) * l_discount) END, 6) AS chi_p,
 round(16.0/13 * (({M1} + 12 * {M2}) * pow({M1}, 4) * 100 + ({M2} + 12 * {M1}) * pow({M2}, 4) * 200) / pow({M1} + {M2}, 5), 6) AS lambda_tilde,
 round(1 / (pow(6, 1.5) * pi() * {MT}), 6) AS f_isco, round(1 / (pow(3, 1.5) * pi() * {MT}), 6) AS f_light_ring,
 round(1 / (pow(6, 1.5) * pi() * {MT}) * (1 + 2.8 * {RQ} - 2.6 * {RQ} * {RQ} + 0.8 * {RQ} * {RQ} * {RQ}), 6) AS f_bkl FROM lineitem""")
def binary_frequencies(spark, d):
    t, m1, m2 = _lines(spark, d)
    return t.select("l_orderkey", "l_linenumber", r(P.tau3(m1, m2)).alias("tau3"), r(P.chi_p(m1, m2, C("l_discount"), C("l_tax"))).alias("chi_p"), r(P.lambda_tilde(m1, m2, 100.0, 200.0)).alias("lambda_tilde"), r(P.f_isco(m1 + m2)).alias("f_isco"), r(P.f_light_ring(m1 + m2)).alias("f_light_ring"), r(P.f_bkl_isco(m1, m2)).alias("f_bkl"))


_GPS = "CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT)"


@query(f"""SELECT l_orderkey, l_linenumber, {_GPS} - 315964800 + CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 10 WHEN l_shipdate < TIMESTAMP '1997-07-01' THEN 11 WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 12 ELSE 13 END AS gps FROM lineitem""")
def gps_times(spark, d):
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)")
    return T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.gps_from_unix(s).cast("long").alias("gps"))


def _pattern_sql() -> str:
    def total(f):
        return " + ".join(f"({v!r}) * ({f(i, j)})" for i in range(3) for j, v in enumerate(P.tensor("L1")[i]))

    plus, cross = total(lambda i, j: f"x{i}*x{j} - y{i}*y{j}"), total(lambda i, j: f"x{i}*y{j} + y{i}*x{j}")
    x, y, z = P.SITES["L1"][0]
    return f"""WITH a AS (SELECT id, tid * 0.01 AS ra, stat / 400 - 0.6 AS de, stat * 0.01 AS ps, (t / 1e6 - 946728000.0) / (86400.0 * 36525) AS c FROM {{T}}),
 b AS (SELECT *, (67310.54841 + (876600.0 * 3600 + 8640184.812866) * c + 0.093104 * c * c - 6.2e-6 * c * c * c) * pi() / 43200 - ra AS g FROM a),
 v AS (SELECT id, g, de, -cos(ps)*sin(g) - sin(ps)*cos(g)*sin(de) AS x0, -cos(ps)*cos(g) + sin(ps)*sin(g)*sin(de) AS x1, sin(ps)*cos(de) AS x2,
  sin(ps)*sin(g) - cos(ps)*cos(g)*sin(de) AS y0, sin(ps)*cos(g) + cos(ps)*sin(g)*sin(de) AS y1, cos(ps)*cos(de) AS y2 FROM b)
 SELECT id, round({plus}, 5) AS f_plus, round({cross}, 5) AS f_cross, round(-(({x!r})*cos(de)*cos(g) - ({y!r})*cos(de)*sin(g) + ({z!r})*sin(de)) / 299792458.0, 7) AS delay FROM v"""


@query(_pattern_sql())
def antenna_patterns(spark, d):
    e = T.triggers(spark, d)
    ra, dec, psi, st = C("tid") * 0.01, C("stat") / 400 - 0.6, C("stat") * 0.01, P.gmst(C("t") / 1e6)
    plus, cross = P.antenna_pattern("L1", ra, dec, psi, st)
    return e.select("id", r(plus, 5).alias("f_plus"), r(cross, 5).alias("f_cross"), r(P.delay_from_centre("L1", ra, dec, st), 7).alias("delay"))


@query("""SELECT id, round(CASE WHEN stat >= 50 THEN 0.02 * exp(-0.02 * (stat - 50)) ELSE 0 END, 9) AS pdf_exponential, round(CASE WHEN stat >= 50 THEN exp(-0.02 * (stat - 50)) ELSE 0 END, 9) AS above_exponential,
 round(CASE WHEN stat >= 50 THEN 1e-4 * stat * exp(-1e-4 * (stat * stat - 2500) / 2) ELSE 0 END, 9) AS pdf_rayleigh, round(CASE WHEN stat >= 50 THEN exp(-1e-4 * (stat * stat - 2500) / 2) ELSE 0 END, 9) AS above_rayleigh,
 round(CASE WHEN stat >= 50 THEN 2 * pow(stat, -3) * pow(50, 2) ELSE 0 END, 9) AS pdf_power, round(CASE WHEN stat >= 50 THEN pow(stat, -2) * pow(50, 2) ELSE 0 END, 9) AS above_power FROM {T}""")
def tail_densities(spark, d):
    cols = []
    for kind, a in (("exponential", 0.02), ("rayleigh", 1e-4), ("power", 3.0)):
        cols += [r(P.tail_pdf(kind, C("stat"), F.lit(a), F.lit(50.0)), 9).alias(f"pdf_{kind}"), r(P.tail_above(kind, C("stat"), F.lit(a), F.lit(50.0)), 9).alias(f"above_{kind}")]
    return T.triggers(spark, d).select("id", *cols)


@query("""WITH a AS (SELECT k, stat, 1 / (avg(stat) OVER (PARTITION BY k) - 50) AS alpha, rank() OVER (PARTITION BY k ORDER BY stat) - 1 AS below, count(*) OVER (PARTITION BY k ORDER BY stat) AS upto, count(*) OVER (PARTITION BY k) AS n FROM {T} WHERE stat >= 50)
 SELECT k, max(n) AS n, round(max(alpha), 6) AS alpha, round(max(greatest(abs(upto * 1.0 / n - (1 - exp(-alpha * (stat - 50)))), abs(below * 1.0 / n - (1 - exp(-alpha * (stat - 50)))))), 6) AS ks FROM a GROUP BY k""")
def tail_ks(spark, d):
    e = T.triggers(spark, d).where("stat >= 50")
    fit = e.groupBy("k").agg(F.count("*").alias("n"), (1 / (F.avg("stat") - 50)).alias("alpha"))
    # Equal values are counted first: the ordered pass sees each distinct value once.
    v = e.groupBy("k", "stat").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("stat")))
    j = v.join(F.broadcast(fit), "k")
    cdf = 1 - F.exp(-C("alpha") * (C("stat") - 50))
    gap = F.greatest(F.abs(C("upto") / C("n") - cdf), F.abs((C("upto") - C("c")) / C("n") - cdf))
    return j.groupBy("k").agg(F.max("n").alias("n"), r(F.max("alpha")).alias("alpha"), r(F.max(gap)).alias("ks"))


@query("""SELECT id, round(CASE WHEN c > 20 THEN CASE WHEN nl > c * 0.2 + 4.25 THEN w / (nl - 3.25 - (c - 20) * 0.2) ELSE w END ELSE CASE WHEN nl > 4.25 THEN w / (nl - 3.25) ELSE w END END, 6) AS ranked,
 CASE WHEN c <= 20 THEN nl < 5.25 ELSE nl < (c - 20) * 0.2 + 5.25 END AS kept, round((2.0 * stat * stat / 10 + 3.0 * tid * tid / 20) / (stat * stat + tid * tid), 6) AS net_chisq FROM (SELECT *, stat / 4 AS c, tid / 10.0 AS nl, stat / 3 AS w FROM {T}) WHERE tid > 0""")
def coherent_rankings(spark, d):
    e = T.triggers(spark, d).where("tid > 0")
    coh, null, snr = C("stat") / 4, C("tid") / 10.0, C("tid").cast("double")
    return e.select("id", r(P.reweight_by_null(C("stat") / 3, null, coh)).alias("ranked"), P.null_kept(null, coh).alias("kept"), r(P.network_chisq([(F.lit(2.0), 10, C("stat")), (F.lit(3.0), 20, snr)])).alias("net_chisq"))


@query("""SELECT id, round(pow(u * (1e6 - 1000.0) + 1000.0, 1.0/3), 6) AS distance, round(pow(10, u * 2 + 1), 6) AS log_mass, round(acos(1 - 2 * u), 6) AS polar, round(asin(2 * u - 1), 6) AS latitude FROM (SELECT id, stat / 500 AS u FROM {T})""")
def prior_draws(spark, d):
    u = C("stat") / 500
    return T.triggers(spark, d).select("id", r(P.draw_powerlaw(u, 10.0, 100.0)).alias("distance"), r(P.draw_log10(u, 10.0, 1000.0)).alias("log_mass"), r(P.draw_sin_angle(u)).alias("polar"), r(P.draw_cos_angle(u)).alias("latitude"))


@query("""SELECT least(tid // 30, 4) AS b1, CASE WHEN stat < 10 THEN 0 WHEN stat >= 100 THEN 3 WHEN stat < 31.6 THEN 1 ELSE 2 END AS b2, count(*) AS total, count(*) FILTER (WHERE k = 'click') AS found,
 round(count(*) FILTER (WHERE k = 'click') * 1.0 / count(*), 6) AS share, round(sqrt(count(*) FILTER (WHERE k = 'click') * 1.0 / count(*) * (1 - count(*) FILTER (WHERE k = 'click') * 1.0 / count(*)) / count(*)), 6) AS error FROM {T} GROUP BY 1, 2""")
def binned_efficiency(spark, d):
    s = C("stat")
    g = T.triggers(spark, d).groupBy(F.least(F.floor(C("tid") / 30), F.lit(4)).alias("b1"), L.first_match([(F.lit(0), s < 10), (F.lit(3), s >= 100), (F.lit(1), s < 31.6)], F.lit(2)).alias("b2")).agg(F.count("*").alias("total"), F.count_if(C("k") == "click").alias("found"))
    p = C("found") / C("total")
    return g.select("b1", "b2", "total", "found", r(p).alias("share"), r(F.sqrt(p * (1 - p) / C("total"))).alias("error"))


@query("""WITH a AS (SELECT tid, count(*) AS n, sum(stat - 50) AS s FROM {T} WHERE stat >= 50 GROUP BY tid)
 SELECT x.tid, CAST(sum(y.n) AS BIGINT) AS near, round(sum(y.n) / sum(y.s), 6) AS alpha FROM a x JOIN a y ON abs(x.tid - y.tid) <= 5 GROUP BY x.tid""")
def smoothed_fits(spark, d):
    """Exponential fits over templates within 5 of each: every template is dealt to its neighbours' keys."""
    a = T.triggers(spark, d).where("stat >= 50").groupBy("tid").agg(F.count("*").alias("n"), F.sum(C("stat") - 50).alias("s"))
    spread = a.select(F.explode(F.sequence(C("tid") - 5, C("tid") + 5)).alias("tid"), "n", "s")
    g = spread.groupBy("tid").agg(F.sum("n").alias("near"), F.sum("s").alias("s"))
    return g.join(a.select("tid"), "tid", "left_semi").select("tid", "near", r(C("near") / C("s")).alias("alpha"))


@query("""WITH s AS (SELECT k, CASE WHEN t // 1000000 % 3600 < 60 THEN 2 WHEN t // 1000000 % 3600 < 600 THEN 1 ELSE 0 END AS state, tid // 50 AS bin FROM {T})
 SELECT k, bin, state, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY k, bin) / CASE state WHEN 2 THEN 60.0 / 3600 WHEN 1 THEN 540.0 / 3600 ELSE 3000.0 / 3600 END, 6) AS rate FROM s GROUP BY k, bin, state""")
def data_quality_rates(spark, d):
    """Share of a bin's triggers in each state over the share of live time in that state."""
    sec = F.floor(C("t") / SEC) % 3600
    state = L.first_match([(F.lit(2), sec < 60), (F.lit(1), sec < 600)], F.lit(0))
    g = T.triggers(spark, d).groupBy("k", F.floor(C("tid") / 50).alias("bin"), state.alias("state")).agg(F.count("*").alias("n"))
    live = L.first_match([(F.lit(60.0 / 3600), C("state") == 2), (F.lit(540.0 / 3600), C("state") == 1)], F.lit(3000.0 / 3600))
    return g.withColumn("rate", r(C("n") / F.sum("n").over(Window.partitionBy("k", "bin")) / live))


_BETA = "CASE k WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.75 WHEN 'purchase' THEN 0.5 WHEN 'signup' THEN 0.25 ELSE 0.0 END"


@query(f"""WITH a AS (SELECT {_BETA} AS b, stat / 100 AS l FROM {{T}}), g AS (SELECT b, avg(l) AS m FROM a GROUP BY b), o AS (SELECT b, m, lead(b) OVER (ORDER BY b) AS b2, lead(m) OVER (ORDER BY b) AS m2 FROM g),
 s AS (SELECT b, ln(avg(exp(0.25 * l))) AS x FROM a GROUP BY b)
 SELECT round((SELECT sum((b2 - b) * (m + m2) / 2) FROM o WHERE b2 IS NOT NULL), 6) AS thermodynamic, round((SELECT sum(x) FROM s WHERE b < 1), 6) AS stepping_stone""")
def tempered_evidence(spark, d):
    """Log evidence from five temperatures, 0.25 apart: trapezoid of mean log likelihood, and stepping stones."""
    a = T.triggers(spark, d).select(F.expr(_BETA).cast("double").alias("b"), (C("stat") / 100).alias("l"))
    top = a.groupBy("b").agg(F.avg("l").alias("m"), F.max("l").alias("top"))
    # A row for each temperature: the ladder is short by definition.
    by = Window.partitionBy(F.lit(1)).orderBy("b")
    area = top.select(((F.lead("b").over(by) - C("b")) * (C("m") + F.lead("m").over(by)) / 2).alias("x")).agg(F.sum("x").alias("thermodynamic"))
    stone = a.join(F.broadcast(top.select("b", "top")), "b").where("b < 1").groupBy("b").agg((0.25 * F.max("top") + F.log(F.avg(F.exp(0.25 * (C("l") - C("top")))))).alias("x")).agg(F.sum("x").alias("stepping_stone"))
    return area.join(F.broadcast(stone), F.lit(True)).select(r(C("thermodynamic")).alias("thermodynamic"), r(C("stepping_stone")).alias("stepping_stone"))


@query("""WITH h AS (SELECT bin, count(*) FILTER (WHERE k = 'click') * 1.0 / sum(count(*) FILTER (WHERE k = 'click')) OVER () AS p, count(*) FILTER (WHERE k = 'view') * 1.0 / sum(count(*) FILTER (WHERE k = 'view')) OVER () AS q FROM (SELECT k, floor(stat / 25) AS bin FROM {T}) GROUP BY bin)
 SELECT round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) / 2 ELSE 0 END), 6) AS js FROM h""")
def js_divergence(spark, d):
    h = T.triggers(spark, d).groupBy(F.floor(C("stat") / 25).alias("bin")).agg(F.count_if(C("k") == "click").alias("a"), F.count_if(C("k") == "view").alias("b"))
    h = h.join(F.broadcast(h.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))), F.lit(True))
    p, q = C("a") / C("na"), C("b") / C("nb")
    part = lambda x: F.when(x > 0, x * F.log(2 * x / (p + q)) / 2).otherwise(0.0)
    return h.agg(r(F.sum(part(p) + part(q))).alias("js"))


def _noise_sql() -> str:
    pairs = [("H1", "L1", "click", "view"), ("H1", "V1", "click", "purchase"), ("L1", "V1", "view", "purchase")]
    one = "(SELECT ln(count(*) / 2592000.0) FROM {T} WHERE k = '%s')"
    return " UNION ALL ".join(f"SELECT '{a}{b}' AS combo, round({one % x} + {one % y} + ln({2 * (P.light_travel_time(a, b) + 0.003)!r}), 6) AS log_rate" for a, b, x, y in pairs)


@query(_noise_sql())
def noise_coincidence_rates(spark, d):
    """Log rate of chance coincidences of each detector pair: log rates and the log of the window allowed."""
    stream = {"H1": "click", "L1": "view", "V1": "purchase"}
    n = T.triggers(spark, d).agg(*[F.log(F.count_if(C("k") == k) / 2592000.0).alias(s) for s, k in stream.items()])
    combos = [F.struct(F.lit(a + b).alias("combo"), r(C(a) + C(b) + math.log(2 * (P.light_travel_time(a, b) + 0.003))).alias("log_rate")) for a, b in (("H1", "L1"), ("H1", "V1"), ("L1", "V1"))]
    return n.select(F.inline(F.array(*combos)))


@query(f"""SELECT l_orderkey, l_linenumber, f, round(pow(m, 5.0/6) * pow(f, -7.0/6) * 1e6, 6) AS amplitude, round(3 / (128 * e) / pow(v, 5) * (1 + (3715.0/756 + 55.0/9 * e) * v * v - 16 * pi() * v * v * v + (15293365.0/508032 + 27145.0/504 * e + 3085.0/72 * e * e) * v * v * v * v), 4) AS phase
 FROM (SELECT *, pow(pi() * mt * f, 1.0/3) AS v FROM (SELECT l_orderkey, l_linenumber, {ETA} AS e, {MT} AS mt, {MT} * pow({ETA}, 0.6) AS m, unnest([20.0, 40.0, 80.0]) AS f FROM lineitem))""")
def spa_waveform(spark, d):
    t, m1, m2 = _lines(spark, d)
    t = t.select("l_orderkey", "l_linenumber", m1.alias("m1"), m2.alias("m2"), F.explode(F.array(F.lit(20.0), F.lit(40.0), F.lit(80.0))).alias("f"))
    return t.select("l_orderkey", "l_linenumber", "f", r(P.spa_amplitude(C("f"), L.mchirp(C("m1"), C("m2"))) * 1e6).alias("amplitude"), r(P.spa_phase(C("f"), C("m1"), C("m2")), 4).alias("phase"))


@query("SELECT i, round(exp(-i / 4096.0 / 0.004) * cos(2 * pi() * 250 * i / 4096.0), 6) AS ringdown, round(exp(-(i - 512) / 4096.0 * (i - 512) / 4096.0 / (2 * pow(9 / (2 * pi() * 100), 2))) * cos(2 * pi() * 100 * (i - 512) / 4096.0), 6) AS sine_gaussian FROM generate_series(0, 1023) g(i)")
def closed_form_waveforms(spark, d):
    t = C("id") / 4096.0
    return spark.range(1024).select(C("id").alias("i"), r(P.ringdown(t, 250.0, 0.004)).alias("ringdown"), r(P.sine_gaussian(t - 0.125, 100.0, 9.0)).alias("sine_gaussian"))


@query("SELECT vec_id, i - 1 AS i, round(CAST(embedding[i] AS DOUBLE) * 0.5 + CAST(embedding[i - 1] AS DOUBLE) * 0.25 + CAST(embedding[i - 2] AS DOUBLE) * 0.25, 6) AS filtered FROM embeddings, range(3, 65) g(i)")
def fir_filter(spark, d):
    """Each sample from itself and the two before it, by weights 0.5, 0.25, 0.25; samples without both are left off."""
    x = lambda i, k: F.get(C("embedding"), i - k).cast("double")
    made = F.transform(F.sequence(F.lit(2), F.size("embedding") - 1), lambda i: F.struct(i.cast("long").alias("i"), r(x(i, 0) * 0.5 + x(i, 1) * 0.25 + x(i, 2) * 0.25).alias("filtered")))
    return T.read(spark, d, "embeddings").select("vec_id", F.inline(made))
