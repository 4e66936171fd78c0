"""Views: all rows, or one row for each exact or series duplicate group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import DatasetSpec
from .filters import ObservationFilters, apply_filters

VIEWS = ("raw", "exact", "series")


def group_key(spec: DatasetSpec, kind: str) -> Column:
    """The key of a duplicate group; rows without one are groups of their own."""
    if kind not in ("exact", "series"):
        raise ValueError(f"unknown duplicate kind {kind!r}")
    return F.coalesce(F.col(spec.exact_key if kind == "exact" else spec.series_key), F.col(spec.id_col).cast("string"))


def newest_first(spec: DatasetSpec) -> list[Column]:
    return [F.col(spec.time_col).desc_nulls_last(), F.col(spec.tie_col).desc()]


def representatives(df: DataFrame, spec: DatasetSpec, kind: str) -> DataFrame:
    """The newest row of each group (equal times: the larger tie column). The rank's limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group_key(spec, kind)).orderBy(*newest_first(spec)))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def view(df: DataFrame, spec: DatasetSpec, name: str = "raw", filters: ObservationFilters | None = None, *, filter_first: bool = False, snapshot: DataFrame | None = None) -> DataFrame:
    """A view of the rows. Representatives are chosen among all rows and then filtered, so a group whose representative fails is not in the view; with filter_first they are chosen among the rows that pass. snapshot: representatives that were stored before."""
    if name not in VIEWS:
        raise ValueError(f"unknown view {name!r}")
    if name == "raw":
        return apply_filters(df, spec, filters)
    if filter_first:
        return representatives(apply_filters(df, spec, filters), spec, name)
    return apply_filters(snapshot if snapshot is not None else representatives(df, spec, name), spec, filters)
