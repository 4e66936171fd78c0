"""Duplicate groups. They are found among all (filtered) rows, whatever the view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import DatasetSpec
from .views import group_key, newest_first


def groups(df: DataFrame, spec: DatasetSpec, kind: str) -> DataFrame:
    """group_key, group_size, first_created_at and last_created_at of groups of more than one row."""
    found = df.groupBy(group_key(spec, kind).alias("group_key")).agg(F.count(F.lit(1)).alias("group_size"), F.min(spec.time_col).alias("first_created_at"), F.max(spec.time_col).alias("last_created_at"))
    return found.where("group_size > 1")


def size_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("group_size").agg(F.count(F.lit(1)).alias("group_count")).orderBy(F.col("group_size").desc())


def totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("duplicate_group_count"), F.coalesce(F.sum("group_size"), F.lit(0)).alias("duplicate_row_count"))


def top_groups(found: DataFrame, limit: int = 10) -> DataFrame:
    return found.orderBy(F.col("group_size").desc(), "group_key").limit(limit)


def samples(df: DataFrame, spec: DatasetSpec, kind: str, group_limit: int = 10, member_limit: int = 5) -> DataFrame:
    """The newest members of the largest groups, by one join: group_key, group_size, member (1, 2, ...) and the spec's sample fields that there are."""
    top = top_groups(groups(df, spec, kind), group_limit).select("group_key", "group_size")
    rows = df.withColumn("group_key", group_key(spec, kind)).join(F.broadcast(top), "group_key")  # group_limit rows
    rank = F.row_number().over(Window.partitionBy("group_key").orderBy(*newest_first(spec)))
    fields = [c for c in spec.sample_fields if c in df.columns]
    return rows.withColumn("member", rank).where(F.col("member") <= member_limit).select("group_key", "group_size", "member", *fields)


def bundle(df: DataFrame, spec: DatasetSpec, kinds: tuple[str, ...] = ("exact", "series"), group_limit: int = 10) -> DataFrame:
    """Sizes and largest groups of several kinds, by one scan and one aggregate.

    Rows of part `size`: group_size, group_count (groups of one row too), the first and last time in any. Rows of part `group`: rank (1, 2, ...
    by falling size, then key), group_key, group_size, first_created_at and last_created_at of the group_limit
    largest groups of more than one row. No rows give no rows.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), group_key(spec, k).alias("group_key")) for k in kinds]))
    rows = df.select(F.col(spec.time_col).alias("at"), keys.alias("k")).select("at", "k.*")
    found = rows.groupBy("kind", "group_key").agg(F.count(F.lit(1)).alias("group_size"), F.min("at").alias("first_created_at"), F.max("at").alias("last_created_at"))
    null = F.lit(None)
    sizes = found.groupBy("kind", "group_size").agg(F.count(F.lit(1)).alias("group_count"), F.min("first_created_at").alias("first_created_at"), F.max("last_created_at").alias("last_created_at"))
    sizes = sizes.select("kind", F.lit("size").alias("part"), null.cast("int").alias("rank"), null.cast("string").alias("group_key"), "group_size", "group_count", "first_created_at", "last_created_at")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("group_size").desc(), "group_key"))
    top = found.where("group_size > 1").withColumn("rank", place).where(F.col("rank") <= group_limit)
    top = top.select("kind", F.lit("group").alias("part"), "rank", "group_key", "group_size", null.cast("long").alias("group_count"), "first_created_at", "last_created_at")
    return sizes.unionByName(top)


def samples_of(df: DataFrame, spec: DatasetSpec, top: DataFrame, kinds: tuple[str, ...] = ("exact", "series"), member_limit: int = 5) -> DataFrame:
    """The newest members of groups of several kinds (kind, group_key: as few as bundle() gives), by one scan: kind, group_key, member and the sample fields."""
    fields = [c for c in spec.sample_fields if c in df.columns]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), group_key(spec, k).alias("group_key")) for k in kinds]))
    rows = df.withColumn("__k", keys).withColumn("kind", F.col("__k.kind")).withColumn("group_key", F.col("__k.group_key")).join(F.broadcast(top), ["kind", "group_key"])
    rank = F.row_number().over(Window.partitionBy("kind", "group_key").orderBy(*newest_first(spec)))
    return rows.withColumn("member", rank).where(F.col("member") <= member_limit).select("kind", "group_key", "member", *fields)
