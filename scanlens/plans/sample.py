"""Taking a sample of a source: find its frontier, plan pages, fetch them, write pages and manifests."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.api import fetch_page, read_api
from ..sources.pages import item_manifest, page_items, page_summary
from ..spec import MODALITIES
from .files import Folder, new_run
from .paging import average_page_bytes, discover_frontier, pages_wanted, plan_pages

#: Keys of an item whose lack is reported (fixed values).
IMPORTANT = ["bids_meta.subject_id", "bids_meta.session_id", "bids_meta.Manufacturer", "bids_meta.ManufacturersModelName", "bids_meta.MagneticFieldStrength", "bids_meta.EchoTime", "bids_meta.RepetitionTime", "provenance.md5sum", "provenance.version"]


def saver(folder: str):
    """Pages to files page-N.json of a folder, written where the pages are; a row (page, error) for each."""

    def run(batches):
        for batch in batches:
            for page, value, error in zip(batch["page"], batch["value"], batch["error"], strict=True):
                if error is None:
                    Folder(folder).put(f"page-{page:06d}.json", value)
            yield batch[["page", "error"]]

    return run


def pull(spark: SparkSession, base: str, data_root: str, *, modalities: list[str] | None = None, count: int | None = None, gigabytes: float | None = None, cap: int | None = None, name: str | None = None, **fetching) -> dict:
    """Sample every modality into <data_root>/runs/<id> (a folder that the executors see, too).

    Pages are fetched and written by the executors, the manifests are Spark's JSON folders; a page that fails
    is noted and left out.
    """
    run, names = new_run(data_root, name), modalities or list(MODALITIES)
    out: dict = {"run": run.name.rpartition("/")[2], "modalities": {}}
    for m in names:
        one = lambda page, m=m: fetch_page(base, m, page, **fetching)
        frontier = discover_frontier(one)
        (run / "frontier").put_json(f"{m}.json", frontier.to_dict())
        size = average_page_bytes(one, frontier.last) if frontier.last else 1
        wanted = pages_wanted(len(names), size, count=count, gigabytes=gigabytes, cap=cap)
        plan = [r.asDict() for r in plan_pages(spark, frontier, wanted).collect()]
        (run / "plans").put_json(f"{m}.json", plan)
        got = read_api(spark, base, m, [p["page"] for p in plan], on_error="keep", **fetching).cache()
        raw = (run / "raw" / m).name
        said = got.select("page", "value", "error").mapInPandas(saver(raw), "page int, error string").collect()  # a row for each planned page
        good = got.where("error is null")
        items = good.select(F.col("page").alias("source_page"), F.posexplode(page_items(F.col("value"))).alias("i", "value")).withColumn("item_index", F.col("i") + 1)
        page_summary(good).write.json(f"{run.name}/manifest/{m}-pages.jsonl")
        item_manifest(items, IMPORTANT).write.json(f"{run.name}/manifest/{m}-items.jsonl")
        errors = [{"page": r.page, "error": r.error} for r in sorted(said, key=lambda r: r.page) if r.error]
        out["modalities"][m] = {"pages": len(said) - len(errors), "items": items.count(), "errors": errors[:10]}
        got.unpersist()
    run.put_json("summary.json", out)
    return out
