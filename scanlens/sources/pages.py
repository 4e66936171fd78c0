"""Pages of a web API that were stored as files: <run>/raw/<modality>/page-000123.json, each with an array `_items`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import page_number
from .folders import exists, subfolders


def page_items(value: Column) -> Column:
    """The items of a page as JSON texts; none without `_items`, an error if that is not an array."""
    raw = F.get_json_object(value, "$._items")
    items = F.from_json(value, "_items array<string>")["_items"]
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(~F.ltrim(raw).startswith("["), F.raise_error(F.lit("_items is not a list")).cast("array<string>")).otherwise(items)


def read_pages(spark: SparkSession, run_root: str, modality: str) -> DataFrame | None:
    """(path, page, value) of a modality's pages, None if the run has no folder for it."""
    folder = f"{run_root.rstrip('/')}/raw/{modality}"
    if not exists(spark, folder):
        return None
    files = spark.read.text(f"{folder}/page-*.json", wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return files.select("path", page_number(F.col("path")).alias("page"), "value")


def read_items(spark: SparkSession, run_root: str, modality: str) -> DataFrame | None:
    """(value, raw_payload_path, source_page, item_index) of all items, item_index from 1 in the page's order."""
    pages = read_pages(spark, run_root, modality)
    if pages is None:
        return None
    items = pages.select("path", "page", F.posexplode(page_items(F.col("value"))).alias("i", "value"))
    return items.select("value", F.col("path").alias("raw_payload_path"), F.col("page").alias("source_page"), (F.col("i") + 1).cast("long").alias("item_index"))


def resolve_run_root(spark: SparkSession, *, run_root: str | None = None, data_root: str | None = None, run_id: str | None = None) -> str:
    """The folder of a run: given, by id, or the last by name under <data_root>/runs. It must hold raw/."""
    if run_root is not None and run_id is not None:
        raise ValueError("give run_root or run_id, not both")
    if run_root is None:
        if data_root is None:
            raise ValueError("a data_root is needed to find a run")
        found = [run_id] if run_id else subfolders(spark, f"{data_root}/runs")
        if not found:
            raise FileNotFoundError(f"no runs in {data_root}")
        run_root = f"{data_root}/runs/{max(found)}"
    if not exists(spark, f"{run_root}/raw"):
        raise FileNotFoundError(f"{run_root} has no raw/")
    return run_root


def page_summary(pages: DataFrame) -> DataFrame:
    """Per page (page, value): item_count, distinct ids and subjects that occur more than once, first and last creation text, bytes."""
    items = pages.select("page", F.octet_length("value").alias("raw_bytes"), F.explode_outer(page_items(F.col("value"))).alias("item"))
    fields = items.select(
        "page", "raw_bytes", "item", F.get_json_object("item", "$._created").alias("created"), F.get_json_object("item", "$.provenance.md5sum").alias("md5"), F.get_json_object("item", "$.bids_meta.subject_id").alias("subject")
    )

    def repeated(name: str) -> DataFrame:
        return fields.where(F.col(name).isNotNull()).groupBy("page", name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("page").agg(F.count(F.lit(1)).alias(f"{name}_groups"))

    base = fields.groupBy("page").agg(F.count("item").alias("item_count"), F.min("created").alias("first_created"), F.max("created").alias("last_created"), F.max("raw_bytes").cast("long").alias("raw_bytes"))
    out = base.join(repeated("md5"), "page", "left").join(repeated("subject"), "page", "left")
    return out.fillna(0, ["md5_groups", "subject_groups"])


def missing_of(item: Column, keys: list[str]) -> Column:
    """Those of the keys (paths as a.b) whose value is null or empty in an item's JSON."""
    value = lambda k: F.get_json_object(item, f"$.{k}")
    return F.array_compact(F.array(*[F.when(value(k).isNull() | (value(k) == ""), F.lit(k)) for k in keys]))


def item_manifest(items: DataFrame, important: list[str]) -> DataFrame:
    """A row for each item: page, item_index, id, creation text, md5, subject, number of keys and the important keys that it lacks."""
    v = F.col("value")
    return items.select(
        F.col("source_page").alias("page"), "item_index", F.get_json_object(v, "$._id").alias("item_id"), F.get_json_object(v, "$._created").alias("created"), F.get_json_object(v, "$.provenance.md5sum").alias("md5"),
        F.get_json_object(v, "$.bids_meta.subject_id").alias("subject_id"), F.size(F.json_object_keys(v)).alias("key_count"), missing_of(v, important).alias("missing"),
    )


def sample_summary(items: DataFrame, important: list[str], limit: int = 10) -> dict[str, DataFrame]:
    """Totals of a sample, its most frequent versions, manufacturers and tasks, and how often each important key lacks."""
    v = F.col("value")

    def top(path: str) -> DataFrame:
        value = items.select(F.get_json_object(v, path).alias("value")).where("value is not null and value <> ''")
        return value.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "value").limit(limit)

    gone = items.select(F.explode(missing_of(v, important)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "key")
    totals = items.agg(F.countDistinct("source_page").alias("page_count"), F.count(F.lit(1)).alias("item_count"))
    return {"totals": totals, "versions": top("$.provenance.version"), "manufacturers": top("$.bids_meta.Manufacturer"), "tasks": top("$.bids_meta.task_id"), "missing": gone}
