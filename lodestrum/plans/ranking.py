"""Queries of ranking statistics, flags, spectra, noise and banks over the driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as L
from ..functions import physics as P
from ..functions import series as S
from ..operators import intervals, signal, statistics, transforms
from ..sources import tables as T
from .catalog import _CHIRP, _FT, _PAIR, _XS, SEC, query, r, time_coincidence

C = F.col


# --- ranking statistics ----------------------------------------------------------------------
_FIT = "(SELECT k, tid, count(*) / sum(stat - 10) * 1.0::DOUBLE AS alpha, count(*) / 2592000.0::DOUBLE AS rate FROM {T} WHERE stat > 10 GROUP BY k, tid)"
_LN = "CASE WHEN x.stat < 30 THEN -0.05 * (x.stat - 30) + ln(0.05) + ln(rate) ELSE -alpha * (x.stat - 30) + ln(alpha) + ln(rate) END"


def _noise(spark, d):
    t = T.triggers(spark, d)
    fit = t.where("stat > 10").groupBy("k", "tid").agg((F.count("*") / F.sum(C("stat") - 10)).alias("alpha"), (F.count("*") / 2592000.0).alias("rate"))
    return t.join(fit, ["k", "tid"])


@query(f"SELECT x.id, round({_LN}, 6) AS log_noise FROM {{T}} x JOIN {_FIT} f ON f.k = x.k AND f.tid = x.tid")
def log_noise_rates(spark, d):
    """Singles by the tail of their template and detector; below the threshold by a slope of its own."""
    s = statistics.named("exp_fit", threshold=30.0, alpha_below=0.05)
    x = _noise(spark, d)
    return x.select("id", r(s.single({"stat": C("stat"), "alpha": C("alpha"), "rate": C("rate")})).alias("log_noise"))


@query(f"""WITH n AS (SELECT x.id, {_LN} AS ln FROM {{T}} x JOIN {_FIT} f ON f.k = x.k AND f.tid = x.tid), p AS ({_PAIR}), a AS (SELECT ln({P.noise_area(('H1', 'L1'), 0.002)!r}::DOUBLE) AS area)
SELECT a_id, b_id, round(greatest(-(x.ln + y.ln + area) - 14.6, -30), 6) AS rank, round(-14.6 - 20 - area - x.ln, 6) AS needed FROM p JOIN n x ON x.id = a_id JOIN n y ON y.id = b_id, a""")
def fitted_ranks(spark, d):
    """Coincidences by likelihood ratio, and the log noise rate that a partner must not pass for a rank of 20."""
    s = statistics.named("exp_fit", threshold=30.0, alpha_below=0.05)
    n = _noise(spark, d).select("id", s.single({"stat": C("stat"), "alpha": C("alpha"), "rate": C("rate")}).alias("ln"))
    p = time_coincidence(spark, d).select("a_id", "b_id")
    j = p.join(n.select(C("id").alias("a_id"), C("ln").alias("x")), "a_id").join(n.select(C("id").alias("b_id"), C("ln").alias("y")), "b_id")
    return statistics.ranked(j, s, ["x", "y"]).select("a_id", "b_id", r(C("rank")).alias("rank"), r(s.bound([C("x")], 20.0)).alias("needed"))


@query(f"SELECT a_id, b_id, round(sqrt(a_stat * a_stat + b_stat * b_stat), 6) AS rank, round(sqrt(greatest(40000 - a_stat * a_stat, 0)), 6) AS needed FROM ({_PAIR})")
def quadrature_ranks(spark, d):
    """Coincidences by the root of the sum of squares, and what a partner needs for 200."""
    s = statistics.named("quadsum")
    return statistics.ranked(time_coincidence(spark, d), s, ["a_stat", "b_stat"]).select("a_id", "b_id", r(C("rank")).alias("rank"), r(s.bound([C("a_stat")], F.lit(200.0))).alias("needed"))


# --- flags --------------------------------------------------------------------------------------
_IV = "(SELECT k, t - 600000000 AS s, t + 600000000 AS e FROM {T} WHERE stat > 60)"


@query(f"""WITH p AS (SELECT s, e FROM {_IV} WHERE k = 'click' UNION ALL SELECT s - 60000000, e + 120000000 FROM {_IV} WHERE k = 'view'), v AS (SELECT greatest(s, 1704500000000000) AS s, least(e, 1705500000000000) AS e FROM {_IV} WHERE k = 'purchase' AND s < 1705500000000000 AND e > 1704500000000000),
x AS (SELECT s AS x FROM p UNION SELECT e FROM p UNION SELECT s FROM v UNION SELECT e FROM v), c AS (SELECT x AS a, lead(x) OVER (ORDER BY x) AS b FROM x), g AS (SELECT a, b FROM c WHERE EXISTS (SELECT 1 FROM p WHERE s <= a AND e >= b) AND NOT EXISTS (SELECT 1 FROM v WHERE s <= a AND e >= b)),
n AS (SELECT *, CASE WHEN a = lag(b) OVER (ORDER BY a) THEN 0 ELSE 1 END AS new FROM g), m AS (SELECT *, sum(new) OVER (ORDER BY a) AS i FROM n) SELECT min(a) AS "start", max(b) AS "end" FROM m GROUP BY i""")
def flag_query(spark, d):
    """Two flags added, one of them padded, and a third taken away within bounds."""
    e = T.triggers(spark, d).where("stat > 60")
    s = e.select(F.lit("H1").alias("detector"), C("k").alias("name"), (C("t") - 600 * SEC).alias("start"), (C("t") + 600 * SEC).alias("end"))
    return intervals.flagged(s, "+click, +H1:view<-60:120>, -purchase[1704500000:1705500000]", "H1", SEC)


# --- spectra ---------------------------------------------------------------------------------------
@query(f"WITH {_XS}, {_FT} SELECT vec_id, f, round(re / 4, 6) AS re, round(im / 4, 6) AS im FROM f")
def series_spectrum(spark, d):
    """Fourier transform of quarter-second samples."""
    s = signal.spectrum(T.read(spark, d, "embeddings"), "embedding", ["vec_id"], 0.25)
    s = s.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("f", "z"))
    return s.select("vec_id", C("f").cast("long").alias("f"), r(C("z.re")).alias("re"), r(C("z.im")).alias("im"))


@query(f"WITH {_XS} SELECT vec_id, i, round(v, 6) AS v FROM x")
def series_there_and_back(spark, d):
    s = signal.back_to_time(signal.spectrum(T.read(spark, d, "embeddings"), "embedding", ["vec_id"], 0.25), ["vec_id"], 0.25)
    return s.select("vec_id", F.posexplode("x").alias("i", "v")).select("vec_id", C("i").cast("long").alias("i"), r(C("v")).alias("v"))


_TF = f"t AS (SELECT f, sum(s * cos(2 * pi() * f * i / 64)) AS tr, -sum(s * sin(2 * pi() * f * i / 64)) AS ti FROM (SELECT i, {_CHIRP} AS s FROM range(0, 64) g(i)), range(0, 33) h(f) GROUP BY f)"


@query(f"WITH {_XS}, {_FT}, {_TF} SELECT vec_id, f, round(re * tr + im * ti, 5) AS re, round(im * tr - re * ti, 5) AS im FROM f JOIN t USING (f) WHERE f >= 3 AND f < 20")
def correlated_series(spark, d):
    """Spectra times the conjugate of a template's, within a band."""
    s = signal.correlated(T.read(spark, d, "embeddings"), "embedding", np.cos(0.02 * np.arange(64) ** 2), ["vec_id"], 3, 20)
    s = s.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("f", "z")).where("f >= 3 and f < 20")
    return s.select("vec_id", C("f").cast("long").alias("f"), r(C("z.re"), 5).alias("re"), r(C("z.im"), 5).alias("im"))


@query(f"WITH {_TF} SELECT f, round(CASE WHEN f >= 2 AND f < 25 THEN 4 / 64.0 * sum(CASE WHEN f >= 2 THEN (tr * tr + ti * ti) / (1 + f) ELSE 0 END) OVER (ORDER BY f) ELSE 0 END, 6) AS sigmasq FROM t")
def sigmasq_by_bin(spark, d):
    """Power of a template over a rising spectrum, up to each bin of a band."""
    s = signal.sigmasq_series(np.cos(0.02 * np.arange(64) ** 2), 1.0 + np.arange(33), 2 / 64, 25 / 64)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(s)], "f long, sigmasq double")


@query(f"WITH {_XS} SELECT a.vec_id, a.i, round(abs(a.v), 6) AS v, greatest(a.i - 6, 0) AS gate_start, least(a.i + 7, 64) AS gate_end FROM x a WHERE abs(a.v) > 0.15 AND NOT EXISTS (SELECT 1 FROM x b WHERE b.vec_id = a.vec_id AND b.i <> a.i AND abs(b.i - a.i) <= 6 AND (abs(b.v) > abs(a.v) OR (abs(b.v) = abs(a.v) AND b.i < a.i)))")
def series_tops(spark, d):
    """Samples above a threshold that are the largest within six on both sides, and the gates about them."""
    e = T.read(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    both = F.arrays_zip(S.window_tops("x", 6, 0.15).alias("top"), S.autogates("x", 0.15, 6).alias("gate"))
    return e.select("vec_id", F.explode(both).alias("z")).select("vec_id", C("z.top.i").alias("i"), r(C("z.top.v")).alias("v"), C("z.gate.start").alias("gate_start"), C("z.gate.end").cast("long").alias("gate_end"))


@query("SELECT tid, list_sort(list_distinct(flatten(list(list_value(m - 2, m - 1, m, m + 1, m + 2))))) AS minutes FROM (SELECT DISTINCT tid, t // 60000000 % 1440 AS m FROM {T} WHERE stat > 200) GROUP BY tid")
def smeared_minutes(spark, d):
    e = T.triggers(spark, d).where("stat > 200").groupBy("tid").agg(F.collect_set(F.floor(C("t") / (60 * SEC)) % 1440).alias("m"))
    return e.select("tid", S.smeared("m", 2).alias("minutes"))


@query("SELECT true AS white, true AS plain, true AS rising")
def noise_of_a_spectrum(spark, d):
    """White noise of unit variance, and coloured noise whose periodogram has the spectrum asked for."""
    psd = 1.0 + np.arange(65)
    w = signal.white_noise(spark, 400, 128, 3)
    x = signal.coloured(w, "x", psd, ["block"])
    p = signal.power_spectrum(x, "noise", ["block"]).agg(F.avg(F.get("psd", 10)).alias("a"), F.avg(F.get("psd", 50)).alias("b"))
    v = w.select(F.explode("x").alias("v")).agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    return v.select((F.abs(C("s") - 1) < 0.02).alias("white"), (F.abs("m") < 0.02).alias("plain")).join(F.broadcast(p.select(((F.abs(C("a") / 11 - 1) < 0.25) & (F.abs(C("b") / 51 - 1) < 0.25)).alias("rising"))), F.lit(True))


# --- samples and banks ----------------------------------------------------------------------------
@query("""SELECT id, round(1 - pow(1 - u, 1.0/3), 6) AS a, round(1 - pow(1 - u, 1.0/3) * sqrt(1 - v), 6) AS b, round(1 - pow(1 - u, 1.0/3) * sqrt(1 - v) * (1 - w), 6) AS c FROM (SELECT id, stat / 500 AS u, tid % 100 / 100.0::DOUBLE AS v, id % 10 / 10.0::DOUBLE AS w FROM {T})""")
def ordered_samples(spark, d):
    """Three independent values as an ascending triple."""
    a, b, c = L.hypertriangle([C("stat") / 500, C("tid") % 100 / 100.0, C("id") % 10 / 10.0])
    return T.triggers(spark, d).select("id", r(a).alias("a"), r(b).alias("b"), r(c).alias("c"))


@query("SELECT count(*) AS templates, count(DISTINCT (p_size, p_retailprice)) AS hashes FROM part")
def template_hashes(spark, d):
    """As many numbers as there are different templates, and each template one."""
    return T.read(spark, d, "part").agg(F.count("*").alias("templates"), F.count_distinct(L.template_hash(C("p_size"), C("p_retailprice"))).alias("hashes"))


@query("SELECT vec_id, label, round(list_sum(list_transform(range(1, 5), lambda i: pow(embedding[i]::DOUBLE - m[i]::DOUBLE, 2))), 6) AS mismatch FROM embeddings JOIN (SELECT label, min_by(embedding, vec_id) AS m FROM embeddings GROUP BY label) USING (label)")
def metric_mismatches(spark, d):
    """Squared distance, in four coordinates, of each point from its cell's template."""
    e = T.read(spark, d, "embeddings")
    m = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("m"))
    at = lambda c: [F.get(c, i).cast("double") for i in range(4)]
    return e.join(m, "label").select("vec_id", "label", r(L.metric_mismatch(at("embedding"), at("m"))).alias("mismatch"))


@query("SELECT true AS covered, true AS sparse")
def hexagonal_bank(spark, d):
    """A hexagonal bank leaves no point of the box farther than its distance, with no more points than that needs."""
    b = transforms.hexagonal(spark, (0.0, 0.0), (10.0, 6.0), 0.5)
    # Each point is looked at against the templates of its own and the neighbouring cells of a grid.
    cell = lambda x, k=0: F.floor(x / 1.0) + k
    near = F.explode(F.array(*[F.struct(cell(C("x"), i).alias("i"), cell(C("y"), j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    t = b.select("x", "y", near.alias("c")).select(C("x").alias("a"), C("y").alias("b"), "c.i", "c.j")
    p = T.triggers(spark, d).select("id", (C("stat") % 10).alias("x"), (C("tid") % 60 / 10.0).alias("y"))
    j = p.withColumns({"i": cell(C("x")), "j": cell(C("y"))}).join(t, ["i", "j"]).groupBy("id").agg(F.min(L.metric_mismatch([C("x"), C("y")], [C("a"), C("b")])).alias("d"))
    far = p.join(j, "id", "left").agg(F.max(F.coalesce("d", F.lit(9.0))).alias("far"))
    return far.select((C("far") <= 0.25 + 1e-9).alias("covered")).join(F.broadcast(b.agg((F.count("*") < 150).alias("sparse"))), F.lit(True))


@query("""WITH n AS (SELECT avg(pow((1 + q) / pow(q, 3), 0.4)) * 7 AS total FROM (SELECT 1 + 7 * (i + 0.5) / 20000 AS q FROM range(0, 20000) g(i)))
SELECT p_partkey, round(0.4 * ln((1 + q) / pow(q, 3)) - ln(total), 5) AS logp, true AS drawn FROM (SELECT p_partkey, 1 + p_size * 0.13::DOUBLE AS q FROM part), n WHERE q < 8""")
def mass_ratio_prior(spark, d):
    """Density of the mass ratio of uniform masses, and draws within its bounds."""
    p = transforms.mass_ratio_prior("q", 1.0, 8.0)
    q = 1 + C("p_size") * 0.13
    x = T.read(spark, d, "part").where(q < 8).select("p_partkey", q.alias("q"), p.draw(C("p_partkey") % 100 / 100.0).alias("v"))
    return x.select("p_partkey", r(p.log_density(C("q")), 5).alias("logp"), ((C("v") >= 1) & (C("v") <= 8)).alias("drawn"))
