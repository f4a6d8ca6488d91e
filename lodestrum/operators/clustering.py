"""Clustering, top-k and decimation of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BLOCK, block_of, runs


def cluster_over_time(d: DataFrame, w: int, *keys: str, block: int = BLOCK) -> DataFrame:
    """Rows that are the first maximum of stat in their own [t - w, t + w); ties go to the earlier (t, id).

    Rows are dealt to blocks of time, those within w of a border to the next block too, as guests.
    """
    block = max(block, 2 * w)
    own = block_of(F.col("t"), block)
    near = F.array(own, block_of(F.col("t") - w, block), block_of(F.col("t") + w, block))
    rows = d.withColumn("_b", F.explode(F.array_distinct(near)))
    by = Window.partitionBy(*keys, "_b").orderBy("t").rangeBetween(-w, w - 1)
    best = F.max(F.struct("stat", (-F.col("t")).alias("t"), (-F.col("id")).alias("id"))).over(by)
    return rows.withColumn("_m", best).where((F.col("_b") == own) & (F.col("_m.t") == -F.col("t")) & (F.col("_m.id") == -F.col("id"))).drop("_b", "_m")


def mean_time(*times):
    """Mean of the times that are not null, in whole units."""
    n = sum((t.isNotNull().cast("int") for t in times[1:]), times[0].isNotNull().cast("int"))
    return F.floor(sum((F.coalesce(t, F.lit(0)) for t in times[1:]), F.coalesce(times[0], F.lit(0))) / n)


def findchirp(d: DataFrame, w: int, *keys: str) -> DataFrame:
    """Sequential clustering by the size of stat: a row over w after the one now kept starts a cluster, else it replaces a lesser one.

    Rows of a key are cut where none follows within w, which no cluster spans; each
    run of rows is a fold whose state is one row.
    """
    d = runs(d, w, *keys)
    s = F.sort_array(F.collect_list(F.struct("t", "id", "stat")))
    g = d.groupBy(*keys, "_run").agg(s.alias("s"))
    start = F.expr("named_struct('out', cast(array() as array<struct<t:bigint,id:bigint,stat:double>>), 'cur', cast(null as struct<t:bigint,id:bigint,stat:double>))")

    def step(acc, x):
        new = acc["cur"].isNotNull() & (x["t"] - acc["cur"]["t"] > w)
        louder = acc["cur"].isNull() | new | (F.abs(x["stat"]) > F.abs(acc["cur"]["stat"]))
        return F.struct(F.when(new, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]).alias("out"), F.when(louder, x).otherwise(acc["cur"]).alias("cur"))

    out = F.aggregate("s", start, step, lambda a: F.concat(a["out"], F.filter(F.array(a["cur"]), lambda x: x.isNotNull())))
    return g.select(*keys, F.explode(out).alias("x")).select(*keys, "x.*")


def loudest_per_bin(d: DataFrame, width: int, n: int, *keys: str) -> DataFrame:
    """The n loudest of each time bin; ties go to the smaller id."""
    d = d.withColumn("bin", F.floor(F.col("t") / width))
    by = Window.partitionBy(*keys, "bin").orderBy(F.desc("stat"), "id")
    return d.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def decimate(d: DataFrame, steps: list[tuple[float, int]]) -> DataFrame:
    """Keep what is at or above a threshold, or a row in so many (by id) below it; weight carries the factor.

    steps: thresholds falling, factors rising; a row meets the first threshold above it.
    """
    factor = F.lit(1)
    for t, f in sorted(steps, reverse=True):
        factor = F.when(F.col("stat") < t, f).otherwise(factor)
    d = d.withColumn("weight", factor)
    return d.where((F.col("weight") == 1) | (F.col("id") % F.col("weight") == 0))


def separated_loudest(d: DataFrame, w: int, *keys: str) -> DataFrame:
    """Greedy: loudest first, each kept row suppresses what lies strictly within w of it.

    Rows of a key are cut where none follows within w, so that the pieces do not see each other; a fold for each.
    """
    d = runs(d, w - 1, *keys)
    s = F.sort_array(F.collect_list(F.struct((-F.col("stat")).alias("neg"), "t", "id", "stat")))
    g = d.groupBy(*keys, "_run").agg(s.alias("s"))
    start = F.expr("cast(array() as array<struct<t:bigint,id:bigint,stat:double>>)")
    step = lambda out, x: F.when(F.exists(out, lambda y: F.abs(y["t"] - x["t"]) < w), out).otherwise(F.concat(out, F.array(F.struct(x["t"].alias("t"), x["id"].alias("id"), x["stat"].alias("stat")))))
    return g.select(*keys, F.explode(F.aggregate("s", start, step)).alias("x")).select(*keys, "x.*")
