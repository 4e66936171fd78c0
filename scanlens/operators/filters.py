"""Filters on observations."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import DatasetSpec


@dataclass(frozen=True)
class ObservationFilters:
    """Which rows a question is about; empty members don't filter. Bounds are inclusive, and rows without a time are outside any."""

    manufacturers: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    tasks: tuple[str, ...] = ()
    created_from: datetime | None = None
    created_to: datetime | None = None

    def echo(self) -> dict:
        """The filters as they are repeated in every answer."""
        return {
            **{k: list(getattr(self, k)) for k in ("manufacturers", "versions", "tasks")},
            **{k: v.isoformat() if (v := getattr(self, k)) else None for k in ("created_from", "created_to")},
        }

    def predicates(self, spec: DatasetSpec, columns: list[str]) -> list[Column]:
        out = [F.col(name).isin(*values) for key, name in spec.filters.items() if (values := getattr(self, key, ())) and name in columns]
        if self.created_from is not None:
            out.append(F.col(spec.time_col) >= F.lit(self.created_from))
        if self.created_to is not None:
            out.append(F.col(spec.time_col) <= F.lit(self.created_to))
        return out


def apply_filters(df: DataFrame, spec: DatasetSpec, filters: ObservationFilters | None) -> DataFrame:
    found = filters.predicates(spec, df.columns) if filters else []
    return df.where(reduce(Column.__and__, found)) if found else df
