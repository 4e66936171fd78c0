"""Which pages of a source to sample: the frontier, the budget and the plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.api import ApiError, Page

#: Probes, seconds of a slow page, pages taken at the start and the end, GB and pages of a sample.
MOST_PROBES, SLOW, EARLY, TAIL, DEFAULT_GB, DEFAULT_CAP = 12, 6.0, 5, 3, 0.25, 128


@dataclass
class Probe:
    page: int
    items: int = 0
    has_next: bool = False
    seconds: float = 0.0
    error: str | None = None


@dataclass
class Frontier:
    """The last page known to have items, and what was asked to know it."""

    last: int
    probes: list[Probe] = field(default_factory=list)
    stopped_by: str = ""

    def to_dict(self) -> dict:
        return asdict(self)


def discover_frontier(fetch: Callable[[int], Page], rounds: int = MOST_PROBES, slow: float = SLOW) -> Frontier:
    """Ask for pages 1, 2, 4, ... until one fails, is empty, is the last or (beyond the first) slow. One asks after the other: each answer says whether to go on."""
    out, page = Frontier(0), 1
    for _ in range(rounds):
        try:
            got = fetch(page)
        except ApiError as e:
            out.probes.append(Probe(page, error=str(e)))
            out.stopped_by = "error"
            return out
        payload = got.payload
        one = Probe(page, len(payload.get("_items") or []), "next" in (payload.get("_links") or {}), got.seconds)
        out.probes.append(one)
        if not one.items:
            out.stopped_by = "empty"
            return out
        out.last = page
        if not one.has_next:
            out.stopped_by = "last"
            return out
        if page > 1 and one.seconds >= slow:
            out.stopped_by = "slow"
            return out
        page *= 2
    out.stopped_by = "rounds"
    return out


def average_page_bytes(fetch: Callable[[int], Page], last: int) -> int:
    """The mean size of the first page, the middle one and the last."""
    pages = sorted({1, max(1, last // 2), max(1, last)})
    return int(sum(len(fetch(p).text.encode()) for p in pages) / len(pages))


def pages_wanted(modalities: int, page_bytes: float, *, count: int | None = None, gigabytes: float | None = None, cap: int | None = None) -> int:
    """Pages of each modality: a count that is asked for (within a given cap), else what the bytes allow, within 1 and the cap."""
    if count is not None:
        return min(count, cap) if cap else count
    share = (DEFAULT_GB if gigabytes is None else gigabytes) * 1024**3 / max(1, modalities) / max(1, page_bytes)
    return max(1, min(int(share), cap or DEFAULT_CAP))


def evenly_spaced(spark: SparkSession, start: int, stop: int, count: int) -> DataFrame:
    """(page): count pages from start to stop at equal distances, halves rounded to even, each once."""
    if count <= 0 or stop < start:
        return spark.createDataFrame([], "page int")
    if count == 1 or stop == start:
        return spark.range(1).select(F.lit(start).alias("page"))
    place = F.bround(F.lit(float(stop - start)) * F.col("id") / F.lit(float(count - 1)))
    return spark.range(count).select((F.lit(start) + place).cast("int").alias("page")).distinct()


def plan_pages(spark: SparkSession, frontier: Frontier, count: int, early: int = EARLY, tail: int = TAIL) -> DataFrame:
    """(page, reasons): pages at the start and the end, those that were probed, and evenly spaced ones; reasons sorted."""
    last = frontier.last
    if last < 1:
        return spark.createDataFrame([], "page int, reasons array<string>")
    span = lambda a, b, why: spark.range(a, b + 1).select(F.col("id").cast("int").alias("page"), F.lit(why).alias("reason"))
    rows = span(1, min(early, last), "early").unionByName(span(max(1, last - tail + 1), last, "tail")).unionByName(evenly_spaced(spark, 1, last, count).withColumn("reason", F.lit("linear")))
    probed = [(p.page,) for p in frontier.probes if p.items and p.page <= last]
    if probed:
        rows = rows.unionByName(spark.createDataFrame(probed, "page int").withColumn("reason", F.lit("probe")))
    return rows.groupBy("page").agg(F.array_sort(F.collect_set("reason")).alias("reasons")).orderBy("page")
