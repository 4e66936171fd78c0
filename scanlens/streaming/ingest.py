"""Page files as a stream: each batch of new files is brought into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import page_number
from ..plans.parse import parse, validated
from ..plans.store import Store
from ..sources.pages import page_items
from ..spec import modality


def ingest(store: Store, run_root: str, name: str, checkpoint: str) -> StreamingQuery:
    """Take every page file of a run's modality once, as it appears; a known observation is replaced. A batch that is done again brings the same rows in again, which changes nothing but the version. Only buckets and groups that a batch touches are written again."""
    spark = store.spark
    files = spark.readStream.schema("value string").option("wholetext", True).text(f"{run_root}/raw/{name}")

    def bring(batch: DataFrame, _: int) -> None:
        pages = batch.select("value", F.col("path"))
        items = pages.select("path", F.posexplode(page_items(F.col("value"))).alias("i", "item"))
        items = items.select(F.col("item").alias("value"), F.col("path").alias("raw_payload_path"), page_number(F.col("path")).alias("source_page"), (F.col("i") + 1).cast("long").alias("item_index"))
        rows, _bad = validated(store.staged(name, parse(items, name)), modality(name))
        if not rows.isEmpty():
            store.merge_rows(name, rows, last_wins=True)

    return files.withColumn("path", F.col("_metadata.file_path")).writeStream.foreachBatch(bring).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
