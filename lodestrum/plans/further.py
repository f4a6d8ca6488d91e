"""Queries of coherent rankings, time slides, volumes by mass, views, and of the SQL interface, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as L
from ..operators import coherent, coincidence, intervals, significance
from ..sources import tables as T
from ..sources import views
from .catalog import _CO, _INJ, _PAIR, SEC, _injections, _loud, _side, query, r, time_coincidence

C = F.col


@query("""WITH z AS (SELECT id, stat * cos(tid) AS a1, stat * sin(tid) AS b1, stat / 2 * cos(id) AS a2, stat / 2 * sin(id) AS b2, stat / 3 * cos(t // 1000000 % 7) AS a3, stat / 3 * sin(t // 1000000 % 7) AS b3, 1.0 * 0.5 * cos(tid * 0.1) AS p1, 2.0 * 0.4 AS p2, 1.5 * 0.3 * sin(tid * 0.1) AS p3, 1.0 * 0.5 * sin(tid * 0.1) AS x1, 2.0 * -0.2 AS x2, 1.5 * 0.6 AS x3 FROM {T}),
m AS (SELECT *, p1*p1+p2*p2+p3*p3 AS a, p1*x1+p2*x2+p3*x3 AS b, x1*x1+x2*x2+x3*x3 AS c, p1*a1+p2*a2+p3*a3 AS pr, p1*b1+p2*b2+p3*b3 AS pi, x1*a1+x2*a2+x3*a3 AS xr, x1*b1+x2*b2+x3*b3 AS xi FROM z)
SELECT id, round(sqrt(a1*a1+b1*b1+a2*a2+b2*b2+a3*a3+b3*b3), 5) AS coincident, round(sqrt((c * (pr*pr+pi*pi) - 2 * b * (pr*xr+pi*xi) + a * (xr*xr+xi*xi)) / (a*c-b*b)), 5) AS coherent FROM m""")
def coherent_snr(spark, d):
    """Three detectors' complex values, summed and projected onto what one source can cause."""
    s, tid = C("stat"), C("tid")
    sec = F.floor(C("t") / SEC) % 7
    z = [(s * F.cos(tid), s * F.sin(tid)), (s / 2 * F.cos("id"), s / 2 * F.sin("id")), (s / 3 * F.cos(sec), s / 3 * F.sin(sec))]
    plus, cross = [0.5 * F.cos(tid * 0.1), F.lit(0.4), 0.3 * F.sin(tid * 0.1)], [0.5 * F.sin(tid * 0.1), F.lit(-0.2), F.lit(0.6)]
    return T.triggers(spark, d).select("id", r(coherent.coincident_snr(z), 5).alias("coincident"), r(coherent.coherent_snr(z, [F.lit(1.0), F.lit(2.0), F.lit(1.5)], plus, cross), 5).alias("coherent"))


@query(f"""SELECT n AS slide, sum(least(a."end", b."end" + n * 900000000) - greatest(a."start", b."start" + n * 900000000))::BIGINT AS live FROM range(-3, 4) g(n), {_CO} a, {_CO} b WHERE a.k = 'click' AND b.k = 'view' AND a."start" < b."end" + n * 900000000 AND b."start" + n * 900000000 < a."end" GROUP BY n""")
def slide_live_times(spark, d):
    """Time that two detectors share, for each of a few slides of the second."""
    s = _loud(spark, d)
    slid = lambda k, step: s.where(C("k") == k).select(F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(3).cast("long"))).alias("slide"), "start", "end").select("slide", (C("start") + C("slide") * step).alias("start"), (C("end") + C("slide") * step).alias("end"))
    return intervals.live_time(intervals.intersect(slid("click", 0), slid("view", 900 * SEC), "slide"), "slide")


@query(f"SELECT mass, round(sum(c * eff) / 1e6, 4) AS volume, round(sqrt(sum(c * c * eff * (1 - eff) / n)) / 1e6, 4) AS error FROM (SELECT id % 4 AS mass, 4 * pi() * pow((floor(distance / 50) + 0.5) * 50, 2) * 50 AS c, avg(found::INT) AS eff, count(*) AS n FROM {_INJ} GROUP BY id % 4, floor(distance / 50)) GROUP BY mass")
def volume_by_mass(spark, d):
    """Volume by its bins of distance, in each bin of mass."""
    i = _injections(spark, d).withColumn("mass", C("id") % 4)
    e = significance.efficiency(i, 50.0, "mass")
    return significance.efficiency_volume(e, 50.0, keys=("mass",)).select("mass", *[r(C(c) / 1e6, 4).alias(c) for c in ("volume", "error")])


@query("""WITH x AS (SELECT id % 4 AS c, id // 4 AS i, -pow((stat - 100) / 50, 2) / 2 AS l FROM {T}), m AS (SELECT c, max(l) AS top, max(i) AS n FROM x GROUP BY c) SELECT x.c, min(i) FILTER (l >= top - 1) AS by_posterior, max(n) // 2 + 1 AS by_half, min(i) FILTER (l = top) AS at_top FROM x JOIN m USING (c) GROUP BY x.c""")
def burn_in(spark, d):
    """Where each chain first comes within one of its highest log posterior (two parameters), its half, and its top."""
    x = T.triggers(spark, d).select((C("id") % 4).alias("c"), F.floor(C("id") / 4).alias("i"), (-F.pow((C("stat") - 100) / 50, 2.0) / 2).alias("l"))
    m = x.groupBy("c").agg(F.max("l").alias("top"), F.max("i").alias("n"))
    return x.join(m, "c").groupBy("c").agg(F.min(F.when(C("l") >= C("top") - 1, C("i"))).alias("by_posterior"), (F.floor(F.max("n") / 2) + 1).alias("by_half"), F.min(F.when(C("l") == C("top"), C("i"))).alias("at_top"))


@query("""WITH s AS (SELECT *, CASE WHEN t // 1000000 % 3600 < 60 THEN 1 ELSE 0 END AS state, tid // 50 AS bin FROM {T}), q AS (SELECT k, bin, state, count(*) AS n FROM s GROUP BY ALL), w AS (SELECT k, bin, sum(n) AS w FROM q GROUP BY ALL)
SELECT id, round(n / w / CASE state WHEN 1 THEN 60.0 / 3600 ELSE 3540.0 / 3600 END, 6) AS rate FROM s JOIN q USING (k, bin, state) JOIN w USING (k, bin)""")
def data_quality_lookup(spark, d):
    """Each trigger with the rate of its bin in its state over the rate of all."""
    s = T.triggers(spark, d).withColumn("state", F.when(F.floor(C("t") / SEC) % 3600 < 60, 1).otherwise(0)).withColumn("bin", F.floor(C("tid") / 50))
    q = s.groupBy("k", "bin", "state").agg(F.count("*").alias("n"))
    share = C("n") / F.sum("n").over(Window.partitionBy("k", "bin"))  # a row for each state
    q = q.select("k", "bin", "state", (share / F.when(C("state") == 1, 60.0 / 3600).otherwise(3540.0 / 3600)).alias("rate"))
    return s.join(q, ["k", "bin", "state"]).select("id", r(C("rate")).alias("rate"))


@query("""SELECT i, x.id AS best, x.stat, apart FROM (SELECT a.id AS i, b.id, b.stat, b.t - a.t AS apart, row_number() OVER (PARTITION BY a.id ORDER BY b.stat DESC, b.id) AS rn FROM {T} a JOIN {T} b ON a.k = 'purchase' AND a.stat > 100 AND b.k = 'view' AND b.t BETWEEN a.t - 900000000 AND a.t + 900000000) x WHERE rn = 1""")
def injection_followup(spark, d):
    """The loudest trigger near each loud injection."""
    a = _side(spark, d, "purchase").where("stat > 100")
    return coincidence.loudest_near(a, _side(spark, d, "view"), 900 * SEC).withColumnRenamed("id", "i")


# --- views ---------------------------------------------------------------------------------------
_CX = f"(SELECT a_id * 1000000000 + b_id AS id, sqrt(a_stat * a_stat + b_stat * b_stat) AS stat, a_id, a_t, b_id, b_t FROM ({_PAIR}))"


def _view(spark, d):
    p = time_coincidence(spark, d)
    return views.Coincidences(p.select((C("a_id") * 1_000_000_000 + C("b_id")).alias("id"), L.quadrature(C("a_stat"), C("b_stat")).alias("stat"), "a_id", "a_t", "b_id", "b_t"), ["a", "b"])


@query(f"""WITH x AS (SELECT id, stat, (a_t + b_t) // 2 AS t, a_id, b_id, NULL::BIGINT AS c_id FROM {_CX} UNION ALL SELECT id, stat, t, NULL, NULL, id FROM {{T}} WHERE k = 'purchase' AND stat > 30), y AS (SELECT * FROM x WHERE stat > 40 AND id % 10 <> 3)
SELECT id, round(stat, 6) AS stat, t, a_id IS NOT NULL AND b_id IS NOT NULL AND c_id IS NULL AS pair FROM y a WHERE NOT EXISTS (SELECT 1 FROM y b WHERE b.t >= a.t - 600000000 AND b.t < a.t + 600000000 AND (b.stat > a.stat OR (b.stat = a.stat AND (b.t < a.t OR (b.t = a.t AND b.id < a.id)))))""")
def coincidence_table(spark, d):
    """Coincidences and singles put together, cut, some removed, clustered by mean time; and which are pairs."""
    one = _side(spark, d, "purchase").where("stat > 30")
    singles = views.Coincidences(one.select("id", "stat", C("id").alias("c_id"), C("t").alias("c_t")), ["c"])
    gone = T.triggers(spark, d).where("id % 10 = 3").select("id").union(_view(spark, d).rows.where("id % 10 = 3").select("id"))
    left = (_view(spark, d) + singles).select("stat > 40").remove(gone).cluster(600 * SEC)
    pair = left.of(["a", "b"]).rows.select("id", F.lit(True).alias("pair"))
    return left.rows.join(pair, "id", "left").select("id", r(C("stat")).alias("stat"), "t", F.coalesce("pair", F.lit(False)).alias("pair"))


@query("""WITH x AS (SELECT * FROM {T} WHERE k = 'click' AND stat > 50), c AS (SELECT * FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.t >= a.t - 3600000000 AND b.t < a.t + 3600000000 AND (b.stat > a.stat OR (b.stat = a.stat AND (b.t < a.t OR (b.t = a.t AND b.id < a.id))))))
SELECT id, stat, round(p_size + 1 + p_retailprice / 100, 6) AS total FROM (SELECT * FROM c ORDER BY stat DESC, id LIMIT 20) LEFT JOIN part ON p_partkey = tid""")
def detector_view(spark, d):
    """The twenty loudest clustered triggers of one detector with their templates' total mass."""
    bank = T.read(spark, d, "part").select(C("p_partkey").alias("template_id"), (C("p_size") + 1.0).alias("mass1"), (C("p_retailprice") / 100).alias("mass2"))
    v = views.Triggers.of(T.triggers(spark, d), "click", bank).cut(["stat:50:lower"]).loudest(20, 3600 * SEC)
    return v.with_parameters(["round(mtotal, 6) AS total"]).select("id", "stat", "total")


@query("SELECT id, round(stat, 2) AS stat, k FROM {T} WHERE stat > 300")
def candidate_files(spark, d):
    """Loud candidates written as lines of JSON and read back."""
    path = T.new_path(spark, "candidates")
    T.triggers(spark, d).where("stat > 300").select("id", r(C("stat"), 2).alias("stat"), "k").write.json(path)
    return spark.read.schema("id long, stat double, k string").json(path)


# --- the SQL interface ----------------------------------------------------------------------------
_CUBE = "SELECT event_type, user_id % 3 AS part, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY {} (event_type, user_id % 3)"


@query(_CUBE.format("CUBE"))
def cube(spark, d):
    T.read(spark, d, "events").createOrReplaceTempView("lodestrum_events")
    return spark.sql(_CUBE.format("CUBE").replace("FROM events", "FROM lodestrum_events"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, d):
    T.read(spark, d, "orders").createOrReplaceTempView("lodestrum_orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM lodestrum_orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


_SUB = "WITH loud AS (SELECT user_id, max(value) AS top FROM {e} GROUP BY user_id) SELECT e.event_id, e.value FROM {e} e JOIN loud ON loud.user_id = e.user_id WHERE e.value = loud.top AND EXISTS (SELECT 1 FROM {e} x WHERE x.user_id = e.user_id AND x.event_type = 'error')"


@query(_SUB.replace("{e}", "events"))
def subqueries(spark, d):
    """A common table expression, a join on it and a correlated subquery."""
    T.read(spark, d, "events").createOrReplaceTempView("lodestrum_events")
    return spark.sql(_SUB.replace("{e}", "lodestrum_events"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, regexp_extract(event_type, '^([a-z])', 1) AS first, regexp_matches(props, '\"k\": [0-9]$|[05]}') AS fives FROM events")
def json_and_patterns(spark, d):
    e = T.read(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.regexp_extract("event_type", "^([a-z])", 1).alias("first"), C("props").rlike('"k": [0-9]$|[05]}').alias("fives"))
