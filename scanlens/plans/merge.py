"""Bringing new rows into a table: last wins (upsert), first wins (insert or skip), resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import item_number


def one_per_key(rows: DataFrame, key: str, order: list[str], last: bool) -> DataFrame:
    """The last (or first) row of each key in the order of the given columns."""
    by = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    return rows.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def existing(rows: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target has."""
    return rows.join(target.select(key), key, "left_semi")


def absent(rows: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target lacks."""
    return rows.join(target.select(key), key, "left_anti")


def conform(rows: DataFrame, schema) -> DataFrame:
    """The schema's columns in its order: those that rows lack are null, others are dropped."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def upsert(target: DataFrame, rows: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """The target with rows in it: a row of a known key takes the old one's place, but for the columns in keep, which the old row has for good."""
    old = target.select(key, *[F.col(c).alias(f"__{c}") for c in keep])
    new = rows.join(old, key, "left")
    for c in keep:
        new = new.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)) if c in rows.columns else F.col(f"__{c}")).drop(f"__{c}")
    return absent(target, rows, key).unionByName(new.select(*target.columns))


def insert_or_skip(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The target and the rows of unknown keys."""
    return target.unionByName(absent(rows, target, key).select(*target.columns))


def resume_index(target: DataFrame, path: str, column: str = "raw_payload_path") -> DataFrame:
    """(last_item): the largest N of <path>#item=N in the target, 0 without any."""
    of_file: Column = F.col(column).startswith(f"{path}#item=")
    return target.where(of_file).agg(F.coalesce(F.max(item_number(F.col(column))), F.lit(0)).alias("last_item"))


def numbered(rows: DataFrame, order: list[str], first: int, name: str = "id") -> DataFrame:
    """rows with increasing numbers from `first` in the order of the given columns (with gaps, so that no task sees all rows)."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id() + first)
