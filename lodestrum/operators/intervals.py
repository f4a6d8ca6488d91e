"""Algebra of half-open intervals [start, end) and membership of points in them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BLOCK, block_of


def _clipped(iv: DataFrame, block: int) -> DataFrame:
    """The parts of non-empty intervals in each block of time they touch, with the block _b."""
    d = iv.where(F.col("start") < F.col("end"))
    d = d.withColumn("_b", F.explode(F.sequence(block_of(F.col("start"), block), block_of(F.col("end") - 1, block))))
    return d.withColumns({"start": F.greatest(F.col("start"), F.col("_b") * block), "end": F.least(F.col("end"), (F.col("_b") + 1) * block)})


def _merged(d: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy("start", "end")
    d = d.withColumn("reach", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("run", F.sum((F.coalesce(F.col("start") > F.col("reach"), F.lit(True))).cast("int")).over(by))
    return d.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _across(pieces: DataFrame, keys: tuple[str, ...], block: int) -> DataFrame:
    """Pieces (keys, _b, start, end) maximal within their blocks, put together where they touch across a border.

    Two pieces of a block at most lie at its borders; only those are looked at beyond it.
    """
    border = (F.col("start") == F.col("_b") * block) | (F.col("end") == (F.col("_b") + 1) * block)
    at = pieces.where(border).drop("_b").withColumn("_all", F.lit(0))
    return pieces.where(~border).select(*keys, "start", "end").union(_merged(at, (*keys, "_all")).select(*keys, "start", "end"))


def coalesce(iv: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    """Union of overlapping or touching intervals of each key, as maximal intervals; empty ones vanish."""
    return _across(_merged(_clipped(iv.select(*keys, "start", "end"), block), (*keys, "_b")), keys, block)


def _swept(a: DataFrame, b: DataFrame, keys: tuple[str, ...], block: int) -> DataFrame:
    """Elementary pieces between borders, with how many intervals of a and b cover each: a window for each block, no pairs."""

    def borders(d, side):
        step = lambda at, v: F.struct(F.col(at).alias("at"), F.lit(v if side == "a" else 0).alias("a"), F.lit(v if side == "b" else 0).alias("b"))
        d = _merged(_clipped(d.select(*keys, "start", "end"), block), (*keys, "_b"))
        return d.select(*keys, "_b", F.explode(F.array(step("start", 1), step("end", -1))).alias("x")).select(*keys, "_b", "x.*")

    s = borders(a, "a").union(borders(b, "b")).groupBy(*keys, "_b", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    by = Window.partitionBy(*keys, "_b").orderBy("at")
    return s.select(*keys, "_b", F.col("at").alias("start"), F.lead("at").over(by).alias("end"), F.sum("a").over(by).alias("a"), F.sum("b").over(by).alias("b"))


def intersect(a: DataFrame, b: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    both = _swept(a, b, keys, block).where("a > 0 and b > 0").select(*keys, "_b", "start", "end")
    return _across(_merged(both, (*keys, "_b")), keys, block)


def subtract(a: DataFrame, b: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    left = _swept(a, b, keys, block).where("a > 0 and b = 0").select(*keys, "_b", "start", "end")
    return _across(_merged(left, (*keys, "_b")), keys, block)


def live_time(iv: DataFrame, *keys: str) -> DataFrame:
    return coalesce(iv, *keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("live"))


def mark(points: DataFrame, iv: DataFrame, bucket: int, *keys: str) -> DataFrame:
    """points with `inside`: whether start <= t < end of some interval of the same key.

    Points and the coalesced intervals meet by (keys, bucket of time), an equi-join;
    a point has at most one coalesced interval, so no rows multiply.
    """
    u = coalesce(iv, *keys).select(*keys, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))).alias("_b"))
    d = points.withColumn("_b", F.floor(F.col("t") / bucket))
    # Within a bucket the interval that could hold t is the last that starts at or before it.
    both = d.select("*", F.lit(None).cast("bigint").alias("_end"), F.col("t").alias("_at"), F.lit(1).alias("_p"))
    marks = u.select(*keys, "_b", F.col("end").alias("_end"), F.col("start").alias("_at"), F.lit(0).alias("_p"))
    by = Window.partitionBy(*keys, "_b").orderBy("_at", "_p").rowsBetween(Window.unboundedPreceding, 0)
    both = both.unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("inside", F.coalesce(F.max("_end").over(by) > F.col("t"), F.lit(False)))
    return both.where("_p = 1").drop("_b", "_end", "_at", "_p")


def _best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """Intervals of x with the interval of y that shares most time, by search in order: _id, _start and _shared.

    Of y those are looked at that no interval before them reaches beyond; both their borders
    rise. For each of x that is the last to start before it, the first to end after it, or
    the longest between these, which lie inside it.
    """
    y = y.sort_values(["start", "end", "id"], ascending=[True, False, True], ignore_index=True)
    start, end = y["start"].to_numpy(), y["end"].to_numpy()
    top = np.flatnonzero(np.concatenate([[True], end[1:] > np.maximum.accumulate(end)[:-1]]))
    s, e, lo, hi = start[top], end[top], x["start"].to_numpy(), x["end"].to_numpy()
    before, after = np.searchsorted(s, lo, "right") - 1, np.searchsorted(e, hi, "left")
    shared = lambda n: np.minimum(hi, e[n]) - np.maximum(lo, s[n])
    # One that holds all of x is the first to end after it; else the earliest of equals.
    best = np.where(after <= before, np.minimum(after, len(s) - 1), np.maximum(before, 0))
    most = shared(best)

    def better(n: np.ndarray, where: np.ndarray) -> None:
        v = shared(n)
        where = where & (v > most)
        best[where], most[where] = n[where], v[where]

    many = np.where(after > before, after - before - 1, 0)
    # Longest of 1, 2, 4 and so on from each place; two of them cover any run.
    level, span, long = np.arange(len(s)), 1, e - s
    while (many >= span).any():
        now = np.flatnonzero((many >= span) & (many < 2 * span))
        a, b = level[before[now] + 1], level[after[now] - span]
        n = np.zeros(len(lo), int)
        n[now] = np.where(long[b] > long[a], b, a)
        better(n, (many >= span) & (many < 2 * span))
        a, b = level[:-span], level[span:]
        level, span = np.where(long[b] > long[a], b, a), 2 * span
    better(np.minimum(after, len(s) - 1), (after > before) & (after < len(s)))
    # Of those that start together and reach the end of x, the least id.
    first = top[best]
    least = y.groupby("start")["id"].cummin().to_numpy()
    low, high = first.copy(), np.searchsorted(start, start[first], "right")
    while (low < high).any():
        mid = (low + high) // 2
        reach = (low < high) & (end[np.minimum(mid, len(end) - 1)] >= np.minimum(hi, end[first]))
        low, high = np.where(reach, mid + 1, low), np.where(reach, high, mid)
    x = x.assign(_id=least[low - 1], _start=start[first], _shared=most)
    return x[most > 0]


def most_shared(a: DataFrame, b: DataFrame, *keys: str, block: int = 3600 * 1_000_000) -> DataFrame:
    """Intervals of a (id, start, end) with the interval of b that shares most time: other (its id) and shared; the first in time of equals.

    Both are dealt to the blocks they touch, and the best is found in each without pairs. Intervals of a without one have no row.
    """
    blocks = F.explode(F.sequence(block_of(F.col("start"), block), block_of(F.col("end") - 1, block)))
    deal = lambda d: d.where("start < end").select(*keys, *[F.col(c).cast("long").alias(c) for c in ("id", "start", "end")], blocks.alias("_b")).groupBy(*keys, "_b")
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in a.select(*keys).schema)
    names = [*keys, "id", "start", "end", "_id", "_start", "_shared"]
    empty = pd.DataFrame({n: [] for n in names})
    best = lambda x, y: _best(x, y)[names] if len(x) and len(y) else empty
    j = deal(a).cogroup(deal(b)).applyInPandas(best, kept + ", ".join(f"{n} long" for n in names[len(keys) :]))
    top = F.max_by(F.struct("_id", "_shared"), F.struct("_shared", -F.col("_start"), -F.col("_id")))
    return j.groupBy(*keys, "id", "start", "end").agg(top.alias("x")).select(*keys, "id", F.col("x._id").alias("other"), F.col("x._shared").alias("shared"))


def parse_flags(text: str) -> list[dict]:
    """'+H1:DATA:1<-8:8>[0:100],-VETO' as sign, detector, name, pad and bound of each flag, in order."""
    out = []
    for flag in text.replace(" ", "").split(","):
        m = FLAG.fullmatch(flag)
        if not m:
            raise ValueError(f"a flag is +NAME or -NAME, with an optional detector, <before:after> and [start:end], not {flag}")
        pair = lambda x, kind: tuple(kind(v) for v in x.split(":")) if x else None
        out.append({"add": m[1] == "+", "detector": m[2], "name": m[3], "pad": pair(m[4] or m[6], float), "bound": pair(m[5], int)})
    return out


FLAG = re.compile(r"([+-])(?:(\w{2}):)?([^<>\[\]]+)(?:<([^>]+)>)?(?:\[([^\]]+)\])?(?:<([^>]+)>)?")


def flagged(segments: DataFrame, text: str, detector: str, unit: int = 1, block: int = BLOCK) -> DataFrame:
    """Time that the flags leave: segments (detector, name, start, end) added and taken away in order.

    A flag's segments are moved by its pad and cut to its bound (both in units of so many steps of time).
    """
    out = None
    for f in parse_flags(text):
        s = segments.where((F.col("detector") == (f["detector"] or detector)) & (F.col("name") == f["name"])).select("start", "end")
        if f["pad"]:
            s = s.select((F.col("start") + int(f["pad"][0] * unit)).alias("start"), (F.col("end") + int(f["pad"][1] * unit)).alias("end"))
        if f["bound"]:
            s = s.select(F.greatest(F.col("start"), F.lit(f["bound"][0] * unit)).alias("start"), F.least(F.col("end"), F.lit(f["bound"][1] * unit)).alias("end")).where("start < end")
        if out is None:
            out = coalesce(s, block=block) if f["add"] else s.limit(0)
        else:
            out = coalesce(out.union(s), block=block) if f["add"] else subtract(out, s, block=block)
    return out
