"""Quality rules with thresholds read from mergeable quantile sketches.

Everything here is a DataFrame expression. The sketch is a relative-error
histogram: a value v > 0 falls into bin ceil(log(v) / log(GAMMA)), zero into
ZERO_BIN, so a sketch is a set of (bin, count) rows, merging two
is adding counts, and any quantile is right to within a factor of GAMMA. It is
deterministic, unlike sketches that compact at random.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Ratio between neighbouring bins of the sketch.
GAMMA = 1.005
ZERO_BIN = -1
#: A group's quantiles are weighed against its language's as its passing documents against so many, a language's
#: against those of all likewise: small groups lean on their parent, and no size switches from one to the other.
PRIOR_DOCS = 200
#: Per metric (all in thousandths): lower and upper quantile, and the spreads between them that a limit lies beyond the
#: upper one. Middle quartiles fence what is alike in most texts; repetition has a long tail, so there the tail is.
FENCES = {"symbols": (0.25, 0.75, 6.0), "dup_lines": (0.5, 0.99, 2.0), "repeats": (0.5, 0.99, 2.0), "word_len": (0.25, 0.75, 6.0)}
#: Least spread, in thousandths: differences below one in a hundred count as none.
LEAST_SPREAD = 10
#: The metric that also has a lower limit, as far below its lower quantile.
BOTH_SIDES = "word_len"
#: Threshold rows up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 20_000
METRICS = list(FENCES)


def features(docs: DataFrame, carry: list[str] = []) -> DataFrame:
    """One row per row of docs: doc_id, lang, source, the base counts, and the columns of docs named in carry.

    A null or empty text has zero counts and fails the base rule. Other columns
    of docs are not looked at, so their names cannot clash.
    """
    w, n = F.col("w"), F.col("n_words")
    d = docs.select(*carry, "doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", C.words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{C.SPACE}]"))
    d = d.select(
        *carry, "doc_id", "lang", "source", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    d = d.withColumn("n_lines", F.size("lines").cast("long"))
    d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines"))).drop("lines")
    window = F.transform(F.sequence(F.lit(0), (n - 3).cast("int")), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    d = d.withColumn("h", F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>"))).drop("w")
    # Only texts with a repeat are sorted: (hash, place), then neighbours are compared.
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("s")
    same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
    places = F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"])
    d = d.withColumn("p", F.sort_array(places)).drop("h", "s")
    p = F.col("p")
    new = F.transform(p, lambda v, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), v - F.get(p, i - 1))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("p")
    return d.withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))


def _per_mille(a: str, b: str):
    return F.coalesce(F.expr(f"try_divide({a} * 1000, {b})").cast("long"), F.lit(0).cast("long"))


def measures(f: DataFrame) -> DataFrame:
    """The features with the four measured ratios, whole thousandths."""
    return f.withColumns({
        "symbols": _per_mille("n_symbols", "word_chars"),
        "dup_lines": _per_mille("n_dup_lines", "n_lines"),
        "repeats": _per_mille("n_repeat_words", "n_words"),
        "word_len": _per_mille("word_chars", "n_words"),
    })


def sketch(m: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, metric, bin, n) of the sketch of every group: one partial aggregation."""
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in METRICS]))
    b = F.when(F.col("c.v") <= 0, F.lit(ZERO_BIN)).otherwise(F.ceil(F.log(F.col("c.v").cast("double")) / math.log(GAMMA)).cast("int"))
    return m.select(*keys, cell.alias("c")).groupBy(*keys, F.col("c.metric").alias("metric"), b.alias("bin")).agg(F.count("*").alias("n"))


def merge(s: DataFrame, *keys: str) -> DataFrame:
    """Merge sketches up to coarser groups by adding the counts of a bin."""
    return s.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def quantiles(s: DataFrame, *keys: str) -> DataFrame:
    """The lower and upper quantile of every metric (lo_, hi_) and the documents of each group of a sketch.

    A quantile is the upper edge of the bin that holds it, rounded down.
    """
    by = Window.partitionBy(*keys, "metric")
    d = s.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    edge = F.when(F.col("bin") == ZERO_BIN, F.lit(0)).otherwise(F.floor(F.pow(F.lit(GAMMA), F.col("bin")) + 1e-9)).cast("double")
    at = lambda k, q: F.min(F.when((F.col("metric") == k) & (F.col("upto") > F.floor(q * (F.col("all") - 1))), edge))
    return d.groupBy(*keys).agg(*[at(k, q[i]).alias(f"{c}_{k}") for k, q in FENCES.items() for i, c in enumerate(("lo", "hi"))], F.max("all").alias("docs"))


def _quantile_names() -> list[str]:
    return [f"{c}_{k}" for k in METRICS for c in ("lo", "hi")]


def limits(fine: DataFrame) -> DataFrame:
    """Limits of every (lang, source) of a sketch: max_ of each metric, min_word_len, docs, own_share.

    Each quantile is the mean of the group's own and its language's, weighed by the
    group's documents and PRIOR_DOCS; a language's leans on that of all in the same
    way. own_share is the weight of the group's own sketch.
    """
    lang = merge(fine, "lang")
    total = quantiles(merge(lang)).first()  # one row at most
    lean = lambda own, parent: (F.col("docs") * own + PRIOR_DOCS * parent) / (F.col("docs") + PRIOR_DOCS)
    per_lang = quantiles(lang, "lang").select(F.col("lang").alias("g_parent"), *[lean(F.col(c), F.lit(total[c] if total else None).cast("double")).alias(f"p_{c}") for c in _quantile_names()])
    own = quantiles(fine, "lang", "source").join(per_lang, F.col("lang").eqNullSafe(F.col("g_parent")))
    own = own.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "docs", *[lean(F.col(c), F.col(f"p_{c}")).alias(c) for c in _quantile_names()])
    spread = lambda k: F.greatest(F.col(f"hi_{k}") - F.col(f"lo_{k}"), F.lit(float(LEAST_SPREAD)))
    cols = [(F.col(f"hi_{k}") + q[2] * spread(k)).alias(f"max_{k}") for k, q in FENCES.items()]
    low = (F.col(f"lo_{BOTH_SIDES}") - FENCES[BOTH_SIDES][2] * spread(BOTH_SIDES)).alias(f"min_{BOTH_SIDES}")
    return own.select("g_lang", "g_source", "docs", (F.col("docs") / (F.col("docs") + PRIOR_DOCS)).alias("own_share"), *cols, low)


def quality_rules(docs: DataFrame, carry: list[str] = []) -> DataFrame:
    """Per row of docs: counts, base_failed, its group's limits, kept, and the columns of docs named in carry.

    Sketches are taken from the documents that pass the base rule, per
    (lang, source); those of a language and of the whole are merges of them.
    Null languages and sources are groups like any other. An empty table gives
    no rows; repeated rows count, and are judged, as often as they occur.
    """
    f = C.table(measures(features(docs, carry)), "quality")
    fine = C.table(sketch(f.where(~F.col("base_failed")), "lang", "source"), "quality-sketch")
    per = C.table(limits(fine), "quality-limits")
    right = F.broadcast(per) if per.count() <= BROADCAST_ROWS else per
    j = f.join(right, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    fine_text = F.col(BOTH_SIDES) >= F.col(f"min_{BOTH_SIDES}")
    for k in METRICS:
        fine_text = fine_text & (F.col(k) <= F.col(f"max_{k}"))
    return j.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine_text, F.lit(False))).drop("g_lang", "g_source")
