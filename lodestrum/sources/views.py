"""Tables of coincidences and of one detector's triggers with their operations bound to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering, coincidence, tables


@dataclass
class Coincidences:
    """Coincidences with a statistic stat, an id, and for each detector <detector>_id and <detector>_t (null where it took no part)."""

    rows: DataFrame
    detectors: list[str]

    def __add__(self, other: Coincidences) -> Coincidences:
        """Both tables' rows; a detector that one lacks has nulls there."""
        rows = tables.same_shape([self.rows, other.rows])
        return Coincidences(rows, list(dict.fromkeys([*self.detectors, *other.detectors])))

    def select(self, where: str) -> Coincidences:
        return Coincidences(tables.with_names(self.rows, [where]).where(where), self.detectors)

    def remove(self, ids: DataFrame) -> Coincidences:
        """Without the rows whose id is in ids (id)."""
        return Coincidences(self.rows.join(ids.select("id").distinct(), "id", "left_anti"), self.detectors)

    def with_time(self) -> Coincidences:
        """With t, the mean of the detectors' times that are there."""
        return Coincidences(self.rows.withColumn("t", clustering.mean_time(*[F.col(f"{x}_t") for x in self.detectors])), self.detectors)

    def cluster(self, w: int, *keys: str) -> Coincidences:
        """The loudest in each window of w to both sides, by mean time."""
        return Coincidences(clustering.cluster_over_time(self.with_time().rows, w, *keys), self.detectors)

    def of(self, detectors: list[str]) -> Coincidences:
        """Those in which just these detectors took part."""
        d = self.rows
        for x in self.detectors:
            d = d.where(F.col(f"{x}_id").isNotNull() if x in detectors else F.col(f"{x}_id").isNull())
        return Coincidences(d, self.detectors)

    def triggers(self, events: dict[str, DataFrame], columns: list[str]) -> DataFrame:
        """Rows with the columns of each detector's trigger."""
        return coincidence.members(self.rows, events, columns)


@dataclass
class Triggers:
    """Triggers (id, k, tid, t, stat) of one detector, with its templates' parameters at hand."""

    rows: DataFrame
    bank: DataFrame

    @classmethod
    def of(cls, events: DataFrame, detector: str, bank: DataFrame) -> Triggers:
        return cls(events.where(F.col("k") == detector), bank)

    def cut(self, texts: list[str], values=None) -> Triggers:
        return Triggers(tables.cut(self.rows, tables.parse_cuts(texts), values), self.bank)

    def loudest(self, n: int, w: int) -> Triggers:
        """The n loudest that are first in their own window."""
        top = clustering.cluster_over_time(self.rows, w).orderBy(F.desc("stat"), "id").limit(n)
        return Triggers(top, self.bank)

    def with_parameters(self, fields: list[str]) -> DataFrame:
        """Triggers with expressions over their template's columns, derived names allowed."""
        b = tables.with_names(self.bank, fields).selectExpr("template_id AS tid", *fields)
        return self.rows.join(b, "tid", "left")
