"""All queries over the driver tables, with the SQL that each must equal.

events stand for triggers: event_type is the detector, user_id the template,
value the statistic, times are whole microseconds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as L
from ..operators import clustering, coincidence, diagnostics, intervals, ordered, signal, significance
from ..sources import tables as T
from ..streaming import coincidence as live

FLAGSHIP = "coincidence_far"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SEC = 1_000_000
T_SQL = "(SELECT event_id AS id, event_type AS k, user_id AS tid, epoch_us(ts) AS t, value AS stat FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{T}", T_SQL)
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n)


# --- scans, projections, cuts ---------------------------------------------------------
@query("SELECT event_id, value, value * value AS energy FROM events WHERE value * value > 10000 AND event_type <> 'error'")
def chunk_scan(spark, d):
    e = T.read(spark, d, "events").where("value * value > 10000 AND event_type <> 'error'")
    return e.select("event_id", "value", (F.col("value") * F.col("value")).alias("energy"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'a' WHEN l_discount > 0.05 THEN 'b' WHEN l_returnflag = 'R' THEN 'c' ELSE 'z' END AS bin FROM lineitem")
def first_match_bins(spark, d):
    c = F.col
    return T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", L.first_match([(F.lit("a"), c("l_quantity") < 5), (F.lit("b"), c("l_discount") > 0.05), (F.lit("c"), c("l_returnflag") == "R")], F.lit("z")).alias("bin"))


_SNR, _RC = "(l_extendedprice / 10000)", "(l_quantity / 10)"
_NEW = f"CASE WHEN {_RC} > 1 THEN {_SNR} * pow(0.5 * (1 + pow({_RC}, 3)), -1.0 / 6) ELSE {_SNR} END"


_SG, _VAR = "(l_tax * 100)", "(l_tax * 20)"
_V = f"(CASE WHEN {_VAR} < 0.65 THEN 1.0 ELSE {_VAR} END)"
_SGV = f"(({_NEW}) / CASE WHEN {_SG} > 4 THEN sqrt({_SG} / 4) ELSE 1 END)"
_RCV = f"({_RC} / {_V})"
_PSD = f"({_SNR} / sqrt({_V}) * CASE WHEN {_RCV} > 1 THEN pow(0.5 * (1 + pow({_RCV}, 3)), -1.0 / 6) ELSE 1 END / CASE WHEN {_SG} > 4 THEN sqrt({_SG} / 4) ELSE 1 END)"
_SCALED = f"({_SGV} / pow({_V}, 0.33))"


@query(f"""SELECT l_orderkey, l_linenumber, round({_SNR} / pow({_RC} * (1 + {_SNR} * {_SNR} / 250), 0.25), 6) AS effsnr, round({_SNR}, 6) AS snr, round({_NEW}, 6) AS newsnr, round({_NEW}, 6) AS new_snr, round({_SGV}, 6) AS newsnr_sgveto,
 round({_PSD}, 6) AS newsnr_sgveto_psdvar, round(CASE WHEN {_RC} > 10 OR {_VAR} > 10 THEN 1 ELSE {_PSD} END, 6) AS newsnr_sgveto_psdvar_threshold, round({_SCALED}, 6) AS newsnr_sgveto_psdvar_scaled, round(CASE WHEN {_RC} > 2 THEN 1 ELSE {_SCALED} END, 6) AS newsnr_sgveto_psdvar_scaled_threshold FROM lineitem""")
def single_rankings(spark, d):
    s, x = F.col("l_extendedprice") / 10000, F.col("l_quantity") / 10
    named = [r(L.ranking(n, s, x, F.col("l_tax") * 100, F.col("l_tax") * 20)).alias(n) for n in L.RANKINGS]
    return T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(L.effective_snr(s, x)).alias("effsnr"), *named)


@query("""WITH p AS (SELECT p_partkey, p_size + 1.0::DOUBLE AS m1, p_retailprice / 100 AS m2 FROM part), e AS (SELECT *, m1 * m2 / ((m1 + m2) * (m1 + m2)) AS eta FROM p)
SELECT p_partkey, round(pow(eta, 0.6) * (m1 + m2), 6) AS mchirp, round(eta, 6) AS eta, round(greatest(m1, m2) / least(m1, m2), 6) AS q, round((m1 * 0.3 - m2 * 0.1) / (m1 + m2), 6) AS chi_eff,
round(100 * pow(pow(0.5::DOUBLE, 0.2) * 1.4 / (pow(eta, 0.6) * (m1 + m2)), 5.0::DOUBLE / 6), 6) AS chirp_distance,
round(5.0::DOUBLE / (256 * pi() * 20 * eta * pow(pi() * 4.925490947641267e-06::DOUBLE * (m1 + m2) * 20, 5.0::DOUBLE / 3)), 6) AS tau0 FROM e""")
def binary_parameters(spark, d):
    a, b = F.col("p_size") + 1.0, F.col("p_retailprice") / 100
    mc = L.mchirp(a, b)
    return T.read(spark, d, "part").select("p_partkey", r(mc).alias("mchirp"), r(L.eta(a, b)).alias("eta"), r(L.q(a, b)).alias("q"), r(L.chi_eff(a, b, F.lit(0.3), F.lit(-0.1))).alias("chi_eff"), r(L.chirp_distance(F.lit(100.0), mc)).alias("chirp_distance"), r(L.tau0(a, b)).alias("tau0"))


@query("""SELECT event_id, round(10 + ((value - 10) % 40 + 40) % 40, 6) AS cyc, round(10 + least(((value - 10) % 80 + 80) % 80, 80 - ((value - 10) % 80 + 80) % 80), 6) AS refl,
round(ln(value / (500 - value)), 6) AS lgt, round(-0.5 * pow((value - 100) / 30, 2) - ln(30 * sqrt(2 * pi())), 6) AS lognormal, round(CASE WHEN value >= 1 AND value < 400 THEN 3 * value * value / (400.0 * 400 * 400 - 1) ELSE 0 END, 9) AS radius_pdf FROM events""")
def transforms_and_priors(spark, d):
    v = F.col("value")
    return T.read(spark, d, "events").select("event_id", r(L.cyclic(v, 10, 50)).alias("cyc"), r(L.reflected(v, 10, 50)).alias("refl"), r(L.logit(v, 0, 500)).alias("lgt"), r(L.normal_logpdf(v, 100.0, F.lit(30.0))).alias("lognormal"), r(L.powerlaw_pdf(v, 1, 400), 9).alias("radius_pdf"))


# --- intervals ------------------------------------------------------------------------
_IV = "(SELECT k, t - 300000000 AS \"start\", t + 300000000 AS \"end\" FROM {T} WHERE stat > 150)"
_CO = f"""(SELECT k, min("start") AS "start", max("end") AS "end" FROM (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS run
FROM (SELECT *, max("end") OVER (PARTITION BY k ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_IV})) GROUP BY k, run)"""


def _loud(spark, d):
    return T.triggers(spark, d).where("stat > 150").select("k", (F.col("t") - 300 * SEC).alias("start"), (F.col("t") + 300 * SEC).alias("end"))


@query(f"SELECT * FROM {_CO}")
def segments_coalesced(spark, d):
    return intervals.coalesce(_loud(spark, d), "k")


@query(f'SELECT k, sum("end" - "start")::BIGINT AS live FROM {_CO} GROUP BY k')
def live_time(spark, d):
    return intervals.live_time(_loud(spark, d), "k")


@query(f'SELECT greatest(a."start", b."start") AS "start", least(a."end", b."end") AS "end" FROM {_CO} a, {_CO} b WHERE a.k = \'click\' AND b.k = \'view\' AND a."start" < b."end" AND b."start" < a."end"')
def segments_intersected(spark, d):
    s = _loud(spark, d)
    return intervals.intersect(s.where("k = 'click'").drop("k"), s.where("k = 'view'").drop("k"))


@query(f"""WITH a AS (SELECT * FROM {_CO} WHERE k = 'click'), b AS (SELECT * FROM {_CO} WHERE k = 'view'),
e AS (SELECT "start" AS x FROM a UNION SELECT "end" FROM a UNION SELECT "start" FROM b UNION SELECT "end" FROM b), p AS (SELECT x AS "start", lead(x) OVER (ORDER BY x) AS "end" FROM e)
SELECT "start", "end" FROM p WHERE EXISTS (SELECT 1 FROM a WHERE a."start" <= p."start" AND p."end" <= a."end") AND NOT EXISTS (SELECT 1 FROM b WHERE b."start" <= p."start" AND p."end" <= b."end")""")
def segments_subtracted(spark, d):
    s = _loud(spark, d)
    return intervals.subtract(s.where("k = 'click'").drop("k"), s.where("k = 'view'").drop("k"))


@query(f'SELECT id, EXISTS (SELECT 1 FROM {_CO} s WHERE s.k = e.k AND s."start" <= e.t AND e.t < s."end") AS inside FROM {{T}} e')
def times_in_segments(spark, d):
    return intervals.mark(T.triggers(spark, d), _loud(spark, d), 3600 * SEC, "k").select("id", "inside")


# --- joins ----------------------------------------------------------------------------
_PAIR = "SELECT a.tid, a.id AS a_id, a.t AS a_t, a.stat AS a_stat, b.id AS b_id, b.t AS b_t, b.stat AS b_stat FROM {T} a JOIN {T} b ON a.tid = b.tid AND a.k = 'click' AND b.k = 'view' AND b.t >= a.t - 3600000000 AND b.t < a.t + 3600000000"


def _side(spark, d, k):
    return T.triggers(spark, d).where(F.col("k") == k)


@query(_PAIR)
def time_coincidence(spark, d):
    return coincidence.time_coincidence(_side(spark, d, "click"), _side(spark, d, "view"), 3600 * SEC, "tid")


_STEP = 86400 * SEC
_SLIDE = f"""(SELECT a.tid, a.id AS a_id, a.t AS a_t, a.stat AS a_stat, b.id AS b_id, b.t AS b_t, b.stat AS b_stat, round((a.t - b.t) / {_STEP}.0::DOUBLE)::BIGINT AS slide
FROM (SELECT *, unnest([-1, 0, 1]) * {_STEP} + t % {_STEP} AS f FROM {{T}} WHERE k = 'click') a JOIN (SELECT *, t % {_STEP} AS g FROM {{T}} WHERE k = 'view') b ON a.tid = b.tid AND g >= f - 600000000 AND g < f + 600000000)"""


def _slides(spark, d):
    return coincidence.slide_coincidence(_side(spark, d, "click"), _side(spark, d, "view"), 600 * SEC, _STEP, "tid")


@query(f"SELECT * FROM {_SLIDE}")
def slide_coincidence(spark, d):
    return _slides(spark, d)


@query(f"""WITH p AS ({_PAIR}), j AS (SELECT p.*, c.id AS c_id, c.t AS c_t, c.stat AS c_stat, row_number() OVER (PARTITION BY p.tid, a_id, b_id ORDER BY c.t, c.id) AS rn FROM p JOIN {{T}} c ON c.k = 'purchase' AND c.tid = p.tid
AND c.t >= greatest(a_t, b_t) - 3600000000 AND c.t < least(a_t, b_t) + 3600000000) SELECT * EXCLUDE (rn) FROM j WHERE rn = 1""")
def multi_coincidence(spark, d):
    return coincidence.with_third(time_coincidence(spark, d), _side(spark, d, "purchase"), 3600 * SEC, "tid")


@query("""SELECT i.id, i.t, (SELECT count(*) FROM {T} e WHERE e.k = 'view' AND e.t BETWEEN i.t - 60000000 AND i.t + 60000000) AS n,
(SELECT count(*) FROM {T} e WHERE e.k = 'view' AND e.t BETWEEN i.t - 60000000 AND i.t + 60000000) = 1 AS found FROM {T} i WHERE i.k = 'purchase'""")
def found_injections(spark, d):
    return coincidence.found_once(_side(spark, d, "purchase"), _side(spark, d, "view"), 60 * SEC)


@query("SELECT p.id, p.t, (SELECT s.stat FROM {T} s WHERE s.tid = p.tid AND s.k = 'view' AND s.t <= p.t ORDER BY s.t DESC, s.stat DESC LIMIT 1) AS value, p.tid FROM {T} p WHERE p.k = 'click'")
def state_at_time(spark, d):
    s = _side(spark, d, "view").select("tid", "t", F.col("stat").alias("value"))
    return coincidence.last_before(_side(spark, d, "click"), s, "tid")


@query("SELECT l_orderkey, l_linenumber, p_brand, p_size, s_nationkey FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 25")
def bank_join(spark, d):
    li, p, s = (T.read(spark, d, x) for x in ("lineitem", "part", "supplier"))
    p = p.where("p_size > 25").select("p_partkey", "p_brand", "p_size")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "p_brand", "p_size", "s_nationkey")


@query("SELECT t // 60000000 AS idx, count(DISTINCT k) AS n FROM {T} GROUP BY 1 HAVING count(DISTINCT k) >= 2")
def exact_index_coincidence(spark, d):
    x = T.triggers(spark, d).select(F.floor(F.col("t") / (60 * SEC)).alias("idx"), "k").distinct()
    return x.groupBy("idx").agg(F.count("*").alias("n")).where("n >= 2")


# --- clustering, top-k ------------------------------------------------------------------
@query("""WITH x AS (SELECT * FROM {T}) SELECT id, k, t, stat FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.k = a.k AND b.t >= a.t - 600000000 AND b.t < a.t + 600000000
AND (b.stat > a.stat OR (b.stat = a.stat AND (b.t < a.t OR (b.t = a.t AND b.id < a.id)))))""")
def cluster_over_time(spark, d):
    return clustering.cluster_over_time(T.triggers(spark, d), 600 * SEC, "k").select("id", "k", "t", "stat")


_O = "o AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY {BY}) AS n, count(*) OVER (PARTITION BY tid) AS m FROM {T})"


@query(f"""WITH RECURSIVE {_O.replace('{BY}', 't, id')}, x(tid, n, cur, t, stat, new) AS (SELECT tid, n, id, t, stat, false FROM o WHERE n = 1 UNION ALL
 SELECT o.tid, o.n, CASE WHEN o.t - x.t > 21600000000 OR abs(o.stat) > abs(x.stat) THEN o.id ELSE x.cur END, CASE WHEN o.t - x.t > 21600000000 OR abs(o.stat) > abs(x.stat) THEN o.t ELSE x.t END,
 CASE WHEN o.t - x.t > 21600000000 OR abs(o.stat) > abs(x.stat) THEN o.stat ELSE x.stat END, o.t - x.t > 21600000000 FROM x JOIN o ON o.tid = x.tid AND o.n = x.n + 1)
 SELECT x.tid, x.t, x.cur AS id, x.stat FROM x LEFT JOIN x y ON y.tid = x.tid AND y.n = x.n + 1 WHERE y.n IS NULL OR y.new""")
def findchirp_cluster(spark, d):
    return clustering.findchirp(T.triggers(spark, d), 6 * 3600 * SEC, "tid")


@query(f"""WITH RECURSIVE {_O.replace('{BY}', 'stat DESC, t, id')}, x(tid, n, kept, id, t, stat, own) AS (SELECT tid, n, [t], id, t, stat, true FROM o WHERE n = 1 UNION ALL
 SELECT o.tid, o.n, CASE WHEN len(list_filter(x.kept, lambda y: abs(y - o.t) < 86400000000)) = 0 THEN list_append(x.kept, o.t) ELSE x.kept END, o.id, o.t, o.stat, len(list_filter(x.kept, lambda y: abs(y - o.t) < 86400000000)) = 0 FROM x JOIN o ON o.tid = x.tid AND o.n = x.n + 1)
 SELECT tid, t, id, stat FROM x WHERE own""")
def separated_loudest(spark, d):
    return clustering.separated_loudest(T.triggers(spark, d), 86400 * SEC, "tid")


@query("SELECT id, k, bin, stat, rank FROM (SELECT *, t // 86400000000 AS bin, row_number() OVER (PARTITION BY k, t // 86400000000 ORDER BY stat DESC, id) AS rank FROM {T}) WHERE rank <= 3")
def loudest_per_bin(spark, d):
    return clustering.loudest_per_bin(T.triggers(spark, d), 86400 * SEC, 3, "k").select("id", "k", "bin", "stat", "rank")


@query("SELECT id, k, tid, t, stat, CASE WHEN stat < 50 THEN 10 WHEN stat < 100 THEN 3 ELSE 1 END AS weight FROM {T} WHERE id % (CASE WHEN stat < 50 THEN 10 WHEN stat < 100 THEN 3 ELSE 1 END) = 0")
def decimation(spark, d):
    return clustering.decimate(T.triggers(spark, d), [(100.0, 3), (50.0, 10)])


@query("SELECT id, k, tid, t, stat FROM {T} ORDER BY stat DESC, id LIMIT 100")
def loudest_foreground(spark, d):
    return T.triggers(spark, d).orderBy(F.desc("stat"), "id").limit(100)


# --- significance -----------------------------------------------------------------------
_BG = f"(SELECT sqrt(a_stat * a_stat + b_stat * b_stat) AS stat, slide, tid, a_id, b_id FROM {_SLIDE})"


@query(f"""WITH x AS (SELECT * FROM {_BG}), b AS (SELECT stat FROM x WHERE slide <> 0), f AS (SELECT * FROM x WHERE slide = 0), m AS (SELECT min(stat) AS lo FROM b)
SELECT a_id, b_id, round(stat, 6) AS stat, n::DOUBLE AS louder, round((n + 1) * 31557600.0 / 2592000 / 29, 6) AS far FROM (SELECT f.*, (SELECT count(*) FROM b WHERE b.stat >= f.stat) - CASE WHEN stat <= (SELECT lo FROM m) THEN 1 ELSE 0 END AS n FROM f)""")
def coincidence_far(spark, d):
    """Zero-lag coincidences with the rate of louder time-slid ones, per year."""
    x = _slides(spark, d).withColumn("stat", L.quadrature(F.col("a_stat"), F.col("b_stat"))).withColumn("id", F.col("a_id") * 1_000_000_000 + F.col("b_id"))
    x = T.table(x.select("id", "slide", "stat"), "coincidences")
    fg = significance.count_louder(x.where("slide = 0"), x.where("slide <> 0").withColumn("weight", F.lit(1.0)))
    z = fg.select(F.floor(F.col("id") / 1_000_000_000).alias("a_id"), (F.col("id") % 1_000_000_000).alias("b_id"), r(F.col("stat")).alias("stat"), "louder", F.col("louder").alias("_n"))
    return z.withColumn("far", r((F.col("_n") + 1) * L.YEAR / 2592000 / 29)).drop("_n")


@query("""WITH b AS (SELECT k, stat FROM {T} WHERE id % 5 <> 0), f AS (SELECT k, id, stat FROM {T} WHERE id % 5 = 0), m AS (SELECT k, min(stat) AS lo FROM b GROUP BY k)
SELECT f.k, id, f.stat, (SELECT count(*) FROM b WHERE b.k = f.k AND b.stat >= f.stat)::DOUBLE - CASE WHEN f.stat <= lo THEN 1 ELSE 0 END AS louder FROM f LEFT JOIN m ON m.k = f.k""")
def louder_background(spark, d):
    t = T.triggers(spark, d)
    return significance.count_louder(t.where("id % 5 = 0"), t.where("id % 5 <> 0").withColumn("weight", F.lit(1.0)), "k")


_TAIL = """round(w / e, 9) AS alpha_exponential, round(2 * w / q, 9) AS alpha_rayleigh, round(w / p + 1, 6) AS alpha_power, round(sqrt(w) / e, 9) AS sigma_exponential, round(2 * sqrt(w) / q, 9) AS sigma_rayleigh, round(sqrt(w) / p, 9) AS sigma_power"""


def _tail(f):
    return f.select("k", "n_above", *[r(F.col(c), 6 if c == "alpha_power" else 9).alias(c) for c in f.columns if c[:5] in ("alpha", "sigma")])


@query(f"SELECT k, n_above, {_TAIL} FROM (SELECT k, count(*) AS n_above, count(*)::DOUBLE AS w, sum(stat - 100) AS e, sum(stat * stat - 10000) AS q, sum(ln(stat / 100)) AS p FROM {{T}} WHERE stat >= 100 GROUP BY k)")
def tail_fit(spark, d):
    return _tail(significance.tail_fit(T.triggers(spark, d), 100.0, "k"))


@query(f"SELECT k, n_above, {_TAIL} FROM (SELECT k, count(*) AS n_above, sum(x) AS w, sum(x * (stat - 100)) AS e, sum(x * (stat * stat - 10000)) AS q, sum(x * ln(stat / 100)) AS p FROM (SELECT *, 1.0::DOUBLE + id % 3 AS x FROM {{T}}) WHERE stat >= 100 GROUP BY k)")
def weighted_tail_fit(spark, d):
    return _tail(significance.tail_fit(T.triggers(spark, d).withColumn("weight", 1.0 + F.col("id") % 3), 100.0, "k", weight="weight"))


_INJ = "(SELECT o_orderkey AS id, o_totalprice / 1000 AS distance, o_orderstatus = 'F' AS found FROM orders)"


def _injections(spark, d):
    return T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("distance"), (F.col("o_orderstatus") == "F").alias("found"))


@query(f"SELECT floor(distance / 50)::BIGINT AS bin, round(avg(found::INT), 6) AS eff, round(sqrt(avg(found::INT) * (1 - avg(found::INT)) / count(*)), 6) AS err FROM {_INJ} GROUP BY 1")
def efficiency(spark, d):
    return significance.efficiency(_injections(spark, d), 50.0).select("bin", r(F.col("eff")).alias("eff"), r(F.col("err")).alias("err"))


@query(f"SELECT round(sum(c * eff) / 1e6, 4) AS volume, round(sqrt(sum(c * c * eff * (1 - eff) / n)) / 1e6, 4) AS error FROM (SELECT 4 * pi() * pow((floor(distance / 50) + 0.5) * 50, 2) * 50 AS c, avg(found::INT) AS eff, count(*) AS n FROM {_INJ} GROUP BY floor(distance / 50))")
def efficiency_volume(spark, d):
    """Mean efficiency in shells of distance, summed by their midpoints."""
    v = significance.efficiency_volume(significance.efficiency(_injections(spark, d), 50.0), 50.0)
    return v.select(*[r(F.col(c) / 1e6, 4).alias(c) for c in ("volume", "error")])


@query(f"SELECT round(sum(c * eff) / 1e6, 4) AS volume, round(sqrt(sum(c * c * eff * (1 - eff) / n)) / 1e6, 4) AS error FROM (SELECT 4 * pi() * exp(3 * (floor(ln(distance) / 0.2) + 0.5) * 0.2) * 0.2 AS c, avg(found::INT) AS eff, count(*) AS n FROM {_INJ} GROUP BY floor(ln(distance) / 0.2))")
def log_efficiency_volume(spark, d):
    e = significance.efficiency(_injections(spark, d).withColumn("distance", F.log("distance")), 0.2)
    return significance.efficiency_volume(e, 0.2, logarithmic=True).select(*[r(F.col(c) / 1e6, 4).alias(c) for c in ("volume", "error")])


@query(f"""WITH s AS (SELECT found, distance AS x, lag(distance) OVER (ORDER BY distance, id) AS a, lead(distance) OVER (ORDER BY distance, id) AS b FROM {_INJ}), c AS (SELECT 4 * pi() * x * x * ((b + x) / 2 - coalesce((a + x) / 2, 0)) AS v FROM s WHERE found AND b IS NOT NULL),
 t AS (SELECT sum(v) AS v, sqrt(sum(v * v)) AS e FROM c) SELECT round(v / 1e6, 4) AS volume, round(e / 1e6, 4) AS error, round(pow(v * 3 / 4 / pi(), 1.0/3), 5) AS distance, round(pow((v + e) * 3 / 4 / pi(), 1.0/3) - pow(v * 3 / 4 / pi(), 1.0/3), 5) AS up, round(pow(v * 3 / 4 / pi(), 1.0/3) - pow(greatest(v - e, 0) * 3 / 4 / pi(), 1.0/3), 5) AS down FROM t""")
def shell_volume(spark, d):
    v = significance.shell_volume(_injections(spark, d))
    at, up, down = significance.distance_of_volume(F.col("volume"), F.col("error"))
    return v.select(r(F.col("volume") / 1e6, 4).alias("volume"), r(F.col("error") / 1e6, 4).alias("error"), r(at, 5).alias("distance"), r(up, 5).alias("up"), r(down, 5).alias("down"))


@query(f"SELECT round(v * f / w, 0) AS volume, round(v * sqrt(n * (f2 / n - (f / n) * (f / n))) / w, 0) AS error FROM (SELECT 4.0::DOUBLE / 3 * pi() * pow(max(distance), 3) AS v, sum(CASE WHEN found THEN distance ELSE 0 END) AS f, sum(distance) AS w, sum(CASE WHEN found THEN distance * distance ELSE 0 END) AS f2, count(*)::DOUBLE AS n FROM {_INJ})")
def monte_carlo_volume(spark, d):
    return significance.monte_carlo_volume(_injections(spark, d), 1.0).select(r(F.col("volume"), 0).alias("volume"), r(F.col("error"), 0).alias("error"))


@query("SELECT k, least(floor(stat / 25)::BIGINT, 19) AS bin, count(*) AS n FROM {T} WHERE stat >= 0 AND stat <= 500 GROUP BY ALL")
def histogram(spark, d):
    return diagnostics.histogram(T.triggers(spark, d), "stat", 0.0, 500.0, 20, "k")


@query("SELECT k, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM (SELECT k, least(floor(stat / 25), 19) AS bin, count(*)::DOUBLE AS n FROM {T} WHERE stat BETWEEN 0 AND 500 GROUP BY ALL) GROUP BY k")
def entropy(spark, d):
    return diagnostics.entropy(histogram(spark, d), "k").select("k", r(F.col("entropy")).alias("entropy"))


@query("WITH h AS (SELECT k, least(floor(stat / 25), 19) AS bin, count(*)::DOUBLE AS n FROM {T} WHERE stat BETWEEN 0 AND 500 GROUP BY ALL), p AS (SELECT bin, n / sum(n) OVER () AS p FROM h WHERE k = 'click'), q AS (SELECT bin, n / sum(n) OVER () AS q FROM h WHERE k = 'view') SELECT round(sum(p * ln(p / q)), 6) AS kl FROM p JOIN q USING (bin)")
def kl_divergence(spark, d):
    h = histogram(spark, d)
    return diagnostics.kl_divergence(h.where("k = 'click'"), h.where("k = 'view'")).select(r(F.col("kl")).alias("kl"))


@query("""WITH c AS (SELECT id % 4 AS c, avg(stat) AS m, var_samp(stat) AS v, count(*)::DOUBLE AS n FROM {T} WHERE id // 4 >= 100 GROUP BY 1),
 g AS (SELECT avg(n) AS n, count(*)::DOUBLE AS k, avg(v) AS w, avg(n) * var_samp(m) AS b, avg(m) AS mu, var_pop(v) AS s, covar_samp(v, m * m) AS c2, covar_samp(v, m) AS c1 FROM c),
 h AS (SELECT *, (n - 1) * w / n + (1 + 1 / k) * b / n AS big, (pow(n - 1, 2) * s + pow(1 + 1 / k, 2) * 2 * b * b / (k - 1) + 2 * (n - 1) * (1 + 1 / k) * n / k * (c2 - 2 * mu * c1)) / (n * n) AS var FROM g)
 SELECT round(sqrt(((n - 1) / n + (1 + 1 / k) / n * b / w) * (2 * big * big / var + 3) / (2 * big * big / var + 1)), 6) AS psrf FROM h""")
def gelman_rubin(spark, d):
    """Four chains, the first hundred samples of each left out."""
    x = T.triggers(spark, d).where("id >= 400").withColumn("chain", F.col("id") % 4)
    return diagnostics.gelman_rubin(x, "chain", "stat").select(r(F.col("psrf")).alias("psrf"))


@query("""WITH x AS (SELECT id % 4 AS c, id // 4 AS i, stat FROM {T}), e AS (SELECT c, avg(stat) AS m, var_pop(stat) AS v FROM x WHERE i >= 125 GROUP BY c)
 SELECT c, s AS "start", round((avg(x.stat) - max(e.m)) / sqrt(var_pop(x.stat) + max(e.v)), 6) AS z FROM x JOIN e USING (c) JOIN range(0, 100, 10) g(s) ON i >= s AND i < s + 20 GROUP BY c, s""")
def geweke(spark, d):
    x = T.triggers(spark, d).select((F.col("id") % 4).alias("c"), F.floor(F.col("id") / 4).alias("i"), "stat")
    return diagnostics.geweke(x, "i", "stat", 20, 10, 100, 125, "c").select("c", "start", r(F.col("z")).alias("z"))


@query("SELECT k, round(ln(avg(exp(-stat / 100 - hi))) + hi, 6) AS arithmetic, round(lo - ln(avg(exp(lo + stat / 100))), 6) AS harmonic FROM (SELECT *, max(-stat / 100) OVER (PARTITION BY k) AS hi, min(-stat / 100) OVER (PARTITION BY k) AS lo FROM {T}) GROUP BY k, hi, lo")
def log_evidence(spark, d):
    x = T.triggers(spark, d).withColumn("logl", -F.col("stat") / 100)
    return diagnostics.log_evidence(x, "logl", "k").select("k", r(F.col("arithmetic")).alias("arithmetic"), r(F.col("harmonic")).alias("harmonic"))


# --- sets -------------------------------------------------------------------------------
@query("SELECT id, t FROM {T} a WHERE k = 'view' AND NOT EXISTS (SELECT 1 FROM {T} b WHERE b.k = 'purchase' AND b.stat > 300 AND a.t >= b.t - 600000000 AND a.t < b.t + 600000000)")
def except_foreground(spark, d):
    p = _side(spark, d, "purchase").where("stat > 300")
    iv = p.select((F.col("t") - 600 * SEC).alias("start"), (F.col("t") + 600 * SEC).alias("end"))
    return intervals.mark(_side(spark, d, "view"), iv, 3600 * SEC).where("not inside").select("id", "t")


@query("SELECT tid FROM (SELECT DISTINCT tid FROM {T} WHERE k = 'click' AND stat > 200) INTERSECT SELECT tid FROM {T} WHERE k = 'view' AND stat > 200")
def common_templates(spark, d):
    loud = T.triggers(spark, d).where("stat > 200")
    return loud.where("k = 'click'").select("tid").intersect(loud.where("k = 'view'").select("tid"))


@query("SELECT id, t AS a_t, NULL::BIGINT AS b_t FROM {T} WHERE k = 'click' UNION ALL SELECT id, NULL, t FROM {T} WHERE k = 'view'")
def union_missing(spark, d):
    a, b = _side(spark, d, "click").select("id", F.col("t").alias("a_t")), _side(spark, d, "view").select("id", F.col("t").alias("b_t"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT p_partkey, p_size, ntile(8) OVER (ORDER BY p_size, p_partkey) AS split FROM part")
def split_bank(spark, d):
    """Eight parts of nearly equal size in order; the first ones hold one more."""
    p = ordered.numbered(T.read(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", shared=T.new_path(spark, "split"))
    n, small, more = F.col("_n") - 1, F.floor(F.col("_rows") / 8), F.col("_rows") % 8
    split = F.when(n < more * (small + 1), F.floor(n / (small + 1))).otherwise(more + F.floor((n - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return p.select("p_partkey", "p_size", (split + 1).alias("split"))


# --- packed series ------------------------------------------------------------------------
@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, round(list_max(embedding)::DOUBLE, 6) AS high, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(embedding[4]::DOUBLE + (embedding[5]::DOUBLE - embedding[4]::DOUBLE) * 0.25, 6) AS at FROM embeddings")
def array_reductions(spark, d):
    e = F.col("embedding")
    return T.read(spark, d, "embeddings").select("vec_id", r(L.asum(F.transform(e, lambda x: x.cast("double"))), 5).alias("total"), r(F.array_max(e).cast("double")).alias("high"), r(F.sqrt(L.inner(e, e)), 5).alias("norm"), r(L.at_linear(e, F.lit(3.25))).alias("at"))


@query("""WITH c AS (SELECT label, min_by(embedding, vec_id) AS m FROM embeddings GROUP BY label)
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, m), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(m, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS match FROM embeddings JOIN c USING (label)""")
def template_match(spark, d):
    e = T.read(spark, d, "embeddings")
    m = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("m"))
    return e.join(m, "label").select("vec_id", r(L.overlap(F.col("embedding"), F.col("m")), 5).alias("match"))


@query("SELECT vec_id, i - 1 AS i, round(embedding[i]::DOUBLE, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) WHERE abs(embedding[i]) > 0.3")
def threshold_series(spark, d):
    e = T.read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.where(F.abs(F.col("x").cast("double")) > 0.3).select("vec_id", F.col("i").cast("long"), r(F.col("x").cast("double")).alias("x"))


_XS = "x AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) g(i))"
_FT = "f AS (SELECT vec_id, f, sum(v * cos(2 * pi() * f * i / 64)) AS re, -sum(v * sin(2 * pi() * f * i / 64)) AS im FROM x, range(0, 33) h(f) GROUP BY vec_id, f)"


def _exploded(df, column, name):
    return df.select("vec_id", F.posexplode(column).alias(name, "v")).select("vec_id", F.col(name).cast("long").alias(name), r(F.col("v")).alias(column))


@query(f"WITH {_XS}, {_FT} SELECT vec_id, f, round((re * re + im * im) / 32, 6) AS psd FROM f")
def power_spectrum(spark, d):
    return _exploded(signal.power_spectrum(T.read(spark, d, "embeddings"), "embedding", ["vec_id"]), "psd", "f")


_WIN = "(0.5 - 0.5 * cos(2 * pi() * (i - 8 * s) / 15))"


@query(f"""WITH {_XS}, q AS (SELECT vec_id, s, f, sum(v * {_WIN} * cos(2 * pi() * f * (i - 8 * s) / 16)) AS re, sum(v * {_WIN} * sin(2 * pi() * f * (i - 8 * s) / 16)) AS im FROM x, range(0, 7) g(s), range(0, 9) h(f) WHERE i >= 8 * s AND i < 8 * s + 16 GROUP BY ALL),
 w AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * n / 15), 2)) AS w FROM range(0, 16) g(n)) SELECT vec_id, f, round(median(2 * (re * re + im * im) / w / CASE WHEN f IN (0, 8) THEN 2 ELSE 1 END) / (1 - 1.0/2 + 1.0/3 - 1.0/4 + 1.0/5 - 1.0/6 + 1.0/7), 6) AS psd FROM q, w GROUP BY vec_id, f""")
def welch_psd(spark, d):
    return _exploded(signal.welch(T.read(spark, d, "embeddings"), "embedding", ["vec_id"], 16, 8), "psd", "f")


_MF = """t AS (SELECT f, sum(s * cos(2 * pi() * f * i / 64)) AS tr, -sum(s * sin(2 * pi() * f * i / 64)) AS ti FROM (SELECT i, {W} AS s FROM range(0, 64) g(i)), range(1, 32) h(f) GROUP BY f), n AS (SELECT sum(tr * tr + ti * ti) AS p FROM t),
 c AS (SELECT vec_id, f, re * tr + im * ti AS a, im * tr - re * ti AS b FROM f JOIN t USING (f)), z AS (SELECT vec_id, k, sqrt(pow(sum(a * cos(2 * pi() * f * k / 64) - b * sin(2 * pi() * f * k / 64)), 2) + pow(sum(a * sin(2 * pi() * f * k / 64) + b * cos(2 * pi() * f * k / 64)), 2)) AS z FROM c, range(0, 64) g(k) GROUP BY vec_id, k)"""
_TONE, _CHIRP = "sin(0.3 * i)", "cos(0.02 * i * i)"


@query(f"WITH {_XS}, {_FT}, {_MF.replace('{W}', _TONE)} SELECT vec_id, round(max(z) * 4 / 64 / sqrt(4.0 / 64 * max(p)), 6) AS peak, arg_max(k, z)::INT AS at FROM z, n GROUP BY vec_id")
def matched_filter(spark, d):
    return signal.matched_filter(T.read(spark, d, "embeddings"), "embedding", np.sin(np.arange(64) * 0.3), ["vec_id"]).select("vec_id", r(F.col("peak")).alias("peak"), "at")


@query(f"WITH {_XS}, {_FT}, {_MF.replace('{W}', _CHIRP)}, o AS (SELECT vec_id, sum(re * re + im * im) AS o FROM f WHERE f BETWEEN 1 AND 31 GROUP BY vec_id) SELECT vec_id, round(max(z) / sqrt(max(p) * max(o)), 6) AS match FROM z JOIN o USING (vec_id), n GROUP BY vec_id")
def waveform_match(spark, d):
    return signal.match(T.read(spark, d, "embeddings"), "embedding", np.cos(0.02 * np.arange(64) ** 2), ["vec_id"]).select("vec_id", r(F.col("match")).alias("match"))


@query(f"""WITH {_XS}, {_FT}, {_MF.replace('{W}', _CHIRP)}, m AS (SELECT vec_id, arg_max(k, z) AS place, max(z) AS z FROM z GROUP BY vec_id), s AS (SELECT f, sum(tr * tr + ti * ti) OVER (ORDER BY f) AS upto FROM t),
 e AS (SELECT l, 1 + count(*) FILTER (upto <= l * p / 4) AS lo FROM s, n, range(0, 4) g(l) GROUP BY l), g AS (SELECT l, lo, coalesce(lead(lo) OVER (ORDER BY l), 32) AS hi FROM e),
 y AS (SELECT vec_id, l, pow(sum(a * cos(2 * pi() * f * place / 64) - b * sin(2 * pi() * f * place / 64)), 2) + pow(sum(a * sin(2 * pi() * f * place / 64) + b * cos(2 * pi() * f * place / 64)), 2) AS y FROM c JOIN m USING (vec_id) JOIN g ON f >= lo AND f < hi GROUP BY vec_id, l)
 SELECT vec_id, place::INT AS at, round(z * 4 / 64 / sqrt(4.0 / 64 * p), 6) AS peak, round((4 * t - z * z) * 4 / 64 / p, 6) AS chisq FROM m JOIN (SELECT vec_id, sum(y) AS t FROM y GROUP BY vec_id) USING (vec_id), n""")
def power_chisq(spark, d):
    x = signal.power_chisq(T.read(spark, d, "embeddings"), "embedding", np.cos(0.02 * np.arange(64) ** 2), 4, ["vec_id"])
    return x.select("vec_id", "at", r(F.col("peak")).alias("peak"), r(F.col("chisq")).alias("chisq"))


@query(f"""WITH {_XS}, y AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM x), a AS (SELECT p.vec_id, k, sum(p.v * q.v) AS a FROM y p, range(0, 64) g(k), y q WHERE q.vec_id = p.vec_id AND q.i = p.i + k GROUP BY p.vec_id, k),
 s AS (SELECT vec_id, k, a / first_value(a) OVER w AS rho, 2 * sum(a) OVER w / first_value(a) OVER w - 1 AS tau FROM a WINDOW w AS (PARTITION BY vec_id ORDER BY k)) SELECT vec_id, round(max(rho) FILTER (k = 1), 6) AS rho1, round(max(rho) FILTER (k = 5), 6) AS rho5, round(coalesce(arg_min(tau, k) FILTER (5 * tau <= k), 'inf'::DOUBLE), 6) AS acl FROM s GROUP BY vec_id""")
def autocorrelation(spark, d):
    a = signal.autocorrelation(T.read(spark, d, "embeddings"), "embedding", ["vec_id"])
    return a.select("vec_id", r(F.get("acf", 1)).alias("rho1"), r(F.get("acf", 5)).alias("rho5"), r(F.col("acl")).alias("acl"))


# --- streaming ------------------------------------------------------------------------------
@query("SELECT a.tid, a.id AS a_id, b.id AS b_id FROM {T} a JOIN {T} b ON a.tid = b.tid AND a.k = 'click' AND b.k = 'view' AND b.t >= a.t - 3600000000 AND b.t < a.t + 3600000000")
def streaming_coincidence(spark, d):
    return live.run_once(live.coincidences(live.stream(spark, d), "click", "view", 3600), "stream")
