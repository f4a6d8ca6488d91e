"""Tables by expression: derived columns, cuts and assignments that a user gives as text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as L
from ..functions import physics as P

#: Derived columns by name, with the columns that each is made of; a name that a table has is the table's.
DERIVED: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "mtotal": (("mass1", "mass2"), L.mtotal),
    "mchirp": (("mass1", "mass2"), L.mchirp),
    "eta": (("mass1", "mass2"), L.eta),
    "q": (("mass1", "mass2"), L.q),
    "primary_mass": (("mass1", "mass2"), F.greatest),
    "secondary_mass": (("mass1", "mass2"), F.least),
    "tau0": (("mass1", "mass2"), L.tau0),
    "tau3": (("mass1", "mass2"), P.tau3),
    "chi_eff": (("mass1", "mass2", "spin1z", "spin2z"), L.chi_eff),
    "f_isco": (("mtotal",), P.f_isco),
    "newsnr": (("snr", "rchisq"), L.newsnr),
    "end_time": (("end_time_s", "end_time_ns"), lambda s, ns: s + ns * 1e-9),
}
NAME = re.compile(r"(?<![\w.`'])[A-Za-z_]\w*(?!\s*\(|\w)")


def with_names(d: DataFrame, texts: list[str], more: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] | None = None) -> DataFrame:
    """d with every derived column that the texts name, and those that these need in turn; names within quotes are none.

    more: derived columns, or functions of columns, of the user's own.
    """
    known = DERIVED | (more or {})

    def add(d: DataFrame, name: str, above: tuple[str, ...] = ()) -> DataFrame:
        if name in d.columns or name not in known:
            return d
        if name in above:
            raise ValueError(f"{name} is derived from itself")
        parts, make = known[name]
        for p in parts:
            d = add(d, p, (*above, name))
        return d.withColumn(name, make(*[F.col(p) for p in parts]))

    for t in texts:
        for name in NAME.findall(re.sub(r"'(?:[^'\\]|\\.)*'", "''", t)):
            d = add(d, name)
    return d


def select(d: DataFrame, fields: list[str], where: str | None = None, more=None) -> DataFrame:
    """Fields (SQL expressions, with or without AS) of the rows that meet where; both may name derived columns.

    Everything becomes one projection and filter, so Catalyst reads only the columns that are named.
    """
    d = with_names(d, [*fields, *([where] if where else [])], more)
    return (d.where(where) if where else d).selectExpr(*fields)


def constrained(d: DataFrame, constraints: list[str], more=None) -> DataFrame:
    """Rows that meet every constraint; an unknown (null) one is not met."""
    d = with_names(d, constraints, more)
    for c in constraints:
        d = d.where(c)
    return d


# --- cuts ---------------------------------------------------------------------------
#: Kinds of cut: whether the value may equal the threshold, and on which side it must lie.
KINDS: dict[str, Callable[[Column, float | Column], Column]] = {
    "upper": lambda v, t: v < t,
    "lower": lambda v, t: v > t,
    "upper_inc": lambda v, t: v <= t,
    "lower_inc": lambda v, t: v >= t,
}


def parse_cuts(texts: list[str]) -> dict[tuple[str, str], float]:
    """Cuts 'parameter:threshold:kind' as {(parameter, kind): threshold}; of two alike the stricter holds.

    An inclusive and an exclusive cut on one side of a parameter are reduced to the stricter as well.
    """
    out: dict[tuple[str, str], float] = {}
    for text in texts:
        parts = text.split(":")
        if len(parts) != 3 or parts[2] not in KINDS:
            raise ValueError(f"a cut is parameter:threshold:kind with a kind of {', '.join(KINDS)}, not {text}")
        name, threshold, kind = parts[0], float(parts[1]), parts[2]
        side = kind.removesuffix("_inc")
        rival = next((k for k in (side, f"{side}_inc") if (name, k) in out), None)
        if rival is not None:
            old = out[name, rival]
            stricter = threshold < old if side == "upper" else threshold > old
            if not (stricter or (threshold == old and kind == side)):
                continue
            del out[name, rival]
        out[name, kind] = threshold
    return out


def cut(d: DataFrame, cuts: dict[tuple[str, str], float], values: dict[str, Column] | None = None, medians: str | None = None) -> DataFrame:
    """Rows that meet every cut. values: Columns of parameters that are no columns.

    sigma_multiple compares sqrt(sigmasq) with so many times the column named by medians.
    A null value meets no cut.
    """
    values = values or {}
    d = with_names(d, [p for p, _ in cuts if p not in values])
    for (name, kind), threshold in cuts.items():
        if name == "sigma_multiple":
            if medians is None:
                raise ValueError("sigma_multiple needs the templates' median sigma")
            d = d.where(KINDS[kind](F.sqrt("sigmasq"), threshold * F.col(medians)))
        else:
            d = d.where(KINDS[kind](values.get(name, F.col(name)), threshold))
    return d


def templates_passing(fits: DataFrame, cuts: dict[tuple[str, str], float], detectors: list[str], template: str = "tid", detector: str = "k") -> DataFrame:
    """Templates whose fits meet the cuts in each of the detectors."""
    good = cut(fits.where(F.col(detector).isin(detectors)), cuts)
    return good.groupBy(template).agg(F.count_distinct(detector).alias("_n")).where(F.col("_n") == len(set(detectors))).select(template)


def reduced_chisq(choice: str, columns: list[str]) -> Column:
    """Reduced chi-square by choice: traditional, cont, bank, or their largest (max_...) or means weighted by degrees of freedom (bank_cont...)."""
    parts = {"traditional": ("chisq", "chisq_dof", True), "cont": ("cont_chisq", "cont_chisq_dof", False), "bank": ("bank_chisq", "bank_chisq_dof", False)}

    def one(name: str) -> tuple[Column, Column]:
        c, n, bins = parts[name]
        if c not in columns:
            raise ValueError(f"the table has no {c}")
        return F.col(c), (2 * F.col(n) - 2 if bins else F.col(n))

    if choice in parts:
        c, n = one(choice)
        return c / n
    if choice.startswith("max_"):
        return F.greatest(*[one(x)[0] / one(x)[1] for x in choice[4:].split("_")])
    if choice.startswith("mean_"):
        both = [one(x) for x in choice[5:].split("_")]
        return sum((c for c, _ in both[1:]), both[0][0]) / sum((n for _, n in both[1:]), both[0][1])
    raise ValueError(f"no choice of chi-square {choice}")


# --- shapes ----------------------------------------------------------------------------
def same_shape(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns of one name take the wider of their types, those a table lacks are null."""
    return tables[0] if len(tables) == 1 else tables[0].unionByName(same_shape(tables[1:]), allowMissingColumns=True)


def dense(d: DataFrame, columns: list[str], out: str = "row") -> DataFrame:
    """The columns as one array of doubles, in place of them."""
    rest = [c for c in d.columns if c not in columns]
    return d.select(*rest, F.array(*[F.col(c).cast("double") for c in columns]).alias(out))


def from_arrays(d: DataFrame, arrays: list[str]) -> DataFrame:
    """A row for each place of arrays that run alongside each other; shorter ones end in nulls."""
    rest = [c for c in d.columns if c not in arrays]
    return d.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("place", "x")).select(*rest, "place", "x.*")


# --- bins of a bank ------------------------------------------------------------------------
BIN_TEXT = re.compile(r"(\w+):(\w+):(lt|gt)([0-9.eE+-]+)$")


def bank_bins(texts: list[str]) -> Column:
    """Name of the first bin 'name:parameter:ltX' or 'name:parameter:gtX' that a template meets, else null."""
    cases = []
    for t in texts:
        m = BIN_TEXT.match(t)
        if not m:
            raise ValueError(f"a bin is name:parameter:ltX or :gtX, not {t}")
        value = F.col(m[2])
        cases.append((F.lit(m[1]), value < float(m[4]) if m[3] == "lt" else value > float(m[4])))
    return L.first_match(cases)
