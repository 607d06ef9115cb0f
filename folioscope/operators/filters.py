"""Optional metadata predicates, ANDed and left to the optimizer to push down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.like import contains_like


@dataclass(frozen=True)
class Filters:
    date_from: str | None = None
    date_to: str | None = None
    institution: str | None = None
    category: str | None = None
    stock_code: str | None = None
    lang: str | None = None

    def condition(self) -> Column | None:
        parts: list[Column] = []
        if self.date_from:
            parts.append(F.col("report_date") >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            parts.append(F.col("report_date") <= F.lit(self.date_to).cast("date"))
        if self.institution:
            parts.append(contains_like(F.col("institution"), self.institution))
        for name in ("category", "stock_code", "lang"):
            wanted = getattr(self, name)
            if wanted:
                parts.append(F.col(name) == wanted)
        condition = None
        for part in parts:
            condition = part if condition is None else condition & part
        return condition

    def apply(self, documents: DataFrame) -> DataFrame:
        condition = self.condition()
        return documents if condition is None else documents.where(condition)
