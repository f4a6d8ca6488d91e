"""Secrets in texts, weak candidates by the company they keep; DataFrame expressions only.

Strong kinds (assign, access, hex) are reported as they match. Weak ones are
parts of credentials: bare identifiers (id), bare 40-character strings
(secret), endpoints (endpoint). A part is reported only if parts of both other
roles stand within SCOPE characters of it: an interval join, done as two ordered
passes that carry the nearest part of each role, so no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Characters between a part and its complements.
SCOPE = 300
#: Kind, pattern, group whose length counts, least length; in the order spans of one start are listed.
STRONG = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
WEAK = [
    ("id", r"""(?i)\b(?:user(?:name)?|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", 0, 0),
    ("secret", r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=.-])", 0, 0),
    ("endpoint", r"""(?i)(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{3,}""", 0, 0),
]
#: The part that each kind plays in a credential.
ROLE = {"assign": "secret", "hex": "secret", "secret": "secret", "access": "id", "id": "id", "endpoint": "endpoint"}
ORDER = [k for k, *_ in (*STRONG, *WEAK)]
#: Spans gathered before they are put to the others.
FOLD = 256
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _spans(kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as (start, rank of kind, end), code points, end exclusive.

    Places come from the lengths of what lies between matches and of the matches.
    """
    text, rx = F.col("text"), F.lit(pattern)
    # Runs shorter than the least length hold no match, so a longer least pattern may stand in for +.
    if kind == "hex":
        rx = F.lit(r"[0-9a-f]{32,}")
    got = F.regexp_extract_all(text, rx, 0)
    part = F.regexp_extract_all(text, rx, group) if group else got
    gaps = F.split(text, rx, -1)
    zipped = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(got)), lambda x: F.length(x)).alias("gap"), F.transform(got, lambda x: F.length(x)).alias("len"), F.transform(part, lambda x: F.length(x)).alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + x["len"]
        one = F.array(F.struct(a.alias("start"), F.lit(ORDER.index(kind)).alias("rank"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(x["part"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def fold(acc: Column, block: Column) -> Column:
        # Spans are gathered in blocks, so that no long list is copied for each span.
        inner = F.aggregate(F.slice(zipped, block * FOLD + 1, F.lit(FOLD)), F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out")), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))[0]

    blocks = F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / FOLD).cast("int"))
    found = F.aggregate(blocks, start, fold, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, rx), found).otherwise(F.array().cast(SPAN))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def parts(docs: DataFrame) -> DataFrame:
    """row, doc_id and the spans of every row of docs: strong, weak, and the count of each strong kind."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("row", "doc_id", *[_spans(*k).alias(k[0]) for k in (*STRONG, *WEAK)])
    count = [F.size(k).cast("long").alias(f"n_{k}") for k, *_ in STRONG]
    return d.select("row", "doc_id", *count, F.concat(*[k for k, *_ in STRONG]).alias("strong"), F.concat(*[k for k, *_ in WEAK]).alias("weak"))


def link(p: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows (row, linked): the weak spans that have complements of both other roles within scope.

    p: row, strong, weak. A weak span that lies within a strong or an earlier weak
    one is that part again and is not reported.
    """
    role = F.array(*[F.lit(ROLE[k]) for k in ORDER])
    e = p.where("size(weak) > 0").select("row", F.explode(F.concat("strong", "weak")).alias("s"))
    e = e.select("row", "s", F.element_at(role, F.col("s.rank") + 1).alias("role"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    # The rows ahead, and those behind from the other end: frames that grow by a row at a time.
    ahead = Window.partitionBy("row").orderBy("start", "s.rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("s.rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    near = {}
    for r in ("id", "secret", "endpoint"):
        own = F.col("role") == r
        before = F.max(F.when(own, F.col("end"))).over(ahead)
        after = F.min(F.when(own, F.col("start"))).over(behind)
        near[r] = F.coalesce(F.col("start") - before <= scope, F.lit(False)) | F.coalesce(after - F.col("end") <= scope, F.lit(False))
    inside = F.coalesce(F.max("end").over(ahead) >= F.col("end"), F.lit(False)) | F.coalesce(F.min(F.when(F.col("s.rank") < len(STRONG), F.col("start"))).over(behind) < F.col("end"), F.lit(False))
    ok = F.lit(True)
    for r, there in near.items():
        ok = ok & ((F.col("role") == r) | there)
    marked = e.withColumn("ok", ok & ~inside & (F.col("s.rank") >= len(STRONG))).where("ok")
    return marked.groupBy("row").agg(F.collect_list("s").alias("linked"))  # spans of one text


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans.

    spans lists the strong spans and the linked weak ones as kind:start:end. A null
    or empty text has none and the digest of nothing. Repeated rows each get a
    row; other columns are not looked at.
    """
    p = C.table(parts(docs), "secrets")
    linked = link(p.select("row", "strong", "weak"), scope)
    d = p.drop("weak").join(linked, "row", "left").withColumn("linked", F.coalesce("linked", F.array().cast(SPAN)))
    return d.select("doc_id", "n_assign", "n_access", "n_hex", F.size("linked").cast("long").alias("n_linked"), F.sha2(_listed(F.col("strong")), 256).alias("base_sha256"), _listed(F.concat("strong", "linked")).alias("spans"))
