"""The paginated JSON API as a Spark data source: a partition for each page."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Items of a page at most, tries, and seconds to wait between them for each try so far (fixed values).
MOST_ITEMS, TRIES, WAIT = 50, 3, 0.5


class ApiError(RuntimeError):
    """A page could not be had."""


@dataclass
class Page:
    page: int
    url: str
    text: str
    seconds: float

    @property
    def payload(self) -> dict:
        return json.loads(self.text)


def page_url(base: str, modality: str, page: int, max_results: int = MOST_ITEMS, projection: dict | None = None) -> str:
    query = {"page": page, "max_results": min(max_results, MOST_ITEMS)}
    if projection:
        query["projection"] = json.dumps(projection, sort_keys=True, separators=(",", ":"))
    return f"{base.rstrip('/')}/{modality}?{urllib.parse.urlencode(query)}"


def fetch_page(base: str, modality: str, page: int, *, max_results: int = MOST_ITEMS, projection: dict | None = None, timeout: float = 30, wait: float = WAIT) -> Page:
    """One page. HTTP errors and texts that aren't JSON are tried again."""
    url, why = page_url(base, modality, page, max_results, projection), ""
    for turn in range(1, TRIES + 1):
        began = time.monotonic()
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                text = answer.read().decode()
            json.loads(text)
            return Page(page, url, text, time.monotonic() - began)
        except (urllib.error.URLError, OSError, ValueError) as e:
            why = str(e)
            if turn < TRIES:
                time.sleep(wait * turn)
    raise ApiError(f"{url}: {why}")


@dataclass
class PagePartition(InputPartition):
    page: int


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [PagePartition(int(p)) for p in self.options["pages"].split(",") if p]

    def read(self, partition: PagePartition):
        o = self.options
        projection = json.loads(o["projection"]) if o.get("projection") else None
        try:
            got = fetch_page(o["base"], o["modality"], partition.page, max_results=int(o.get("max_results", MOST_ITEMS)), projection=projection, wait=float(o.get("wait", WAIT)))
            yield partition.page, got.url, got.text, got.seconds, None
        except ApiError as e:
            if o.get("on_error") != "keep":
                raise
            yield partition.page, page_url(o["base"], o["modality"], partition.page), None, None, str(e)


class PagesSource(DataSource):
    """Options: base, modality, pages (1,2,5), max_results, projection (JSON), wait, on_error (raise, or keep: a row with the error)."""

    @classmethod
    def name(cls) -> str:
        return "observation_pages"

    def schema(self) -> str:
        return "page int, url string, value string, seconds double, error string"

    def reader(self, schema):
        return PagesReader(dict(self.options))


def read_api(spark: SparkSession, base: str, modality: str, pages: list[int], **options):
    """(page, url, value, seconds, error) of the pages, fetched by the executors."""
    spark.dataSource.register(PagesSource)
    reader = spark.read.format("observation_pages").option("base", base).option("modality", modality).option("pages", ",".join(map(str, pages)))
    for k, v in options.items():
        reader = reader.option(k, json.dumps(v) if isinstance(v, dict) else str(v))
    return reader.load()
