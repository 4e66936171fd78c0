"""A study's own report beside the reference population: reports from CSV, common bins, probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import fraction, strict_number
from . import profile

RANGES = ("full", "p01_p99", "p05_p95")
#: Metrics that are shown at once, values offered for each filter, and most bins of a report's histogram (fixed values).
MOST_METRICS, FILTER_OPTIONS, REPORT_BINS = 12, 24, 24


def compared_view(view: str, uploaded: bool) -> str:
    """An uploaded report is compared with raw observations, whatever view was asked for."""
    return "raw" if uploaded else view


def chosen_metrics(wanted: list[str]) -> list[str]:
    """The metrics of a comparison, each once, MOST_METRICS at most."""
    return list(dict.fromkeys(wanted))[:MOST_METRICS]


def numbers(report: DataFrame, fields: list[str]) -> DataFrame:
    """A report (all texts) as numbers; columns that it lacks are null."""
    return report.select(*[strict_number(F.col(f"`{c}`")).alias(c) if c in report.columns else F.lit(None).cast("double").alias(c) for c in fields])


def report_summary(report: DataFrame, fields: list[str]) -> DataFrame:
    """metric_summaries of a report for all fields of the catalogue."""
    return profile.metric_summaries(numbers(report, fields), fields)


def report_bins(values: int) -> int:
    """Bins for so many values: the root, rounded half up, within 1 and REPORT_BINS."""
    return min(REPORT_BINS, max(1, int(values**0.5 + 0.5)))


def report_histogram(report: DataFrame, metric: str) -> DataFrame:
    """The histogram of a report's metric, with as many bins as its number of values asks for (report_bins, as a column)."""
    bins = lambda values: F.least(F.lit(REPORT_BINS), F.greatest(F.lit(1), F.floor(F.sqrt(values) + 0.5)))
    return profile.histogram(numbers(report, [metric]), metric, bins)


def display_range(distributions: list[dict], choice: str = "full") -> tuple[float, float] | None:
    """The range that all distributions (dicts of min, max and percentiles) are shown in, None if it's empty. A percentile that lacks is replaced by the next one outwards."""
    if choice not in RANGES:
        raise ValueError(f"unknown range {choice!r}")
    outer = {"full": ["min"], "p01_p99": ["p01", "p05", "min"], "p05_p95": ["p05", "p01", "min"]}[choice]
    upper = {"min": "max", "p01": "p99", "p05": "p95"}
    first = lambda d, names: next((d[n] for n in names if d.get(n) is not None), None)
    lows = [x for d in distributions if (x := first(d, outer)) is not None]
    highs = [x for d in distributions if (x := first(d, [upper[n] for n in outer])) is not None]
    if not lows or not highs or not max(highs) > min(lows):
        return None
    return min(lows), max(highs)


def bucket_edges(low: float, high: float, bins: int) -> list[float]:
    """bins + 1 edges of equal distance, the last one exactly high; a range of one point has edges 1 apart."""
    if low == high:
        return [low + i for i in range(bins + 1)]
    return [low + (high - low) / bins * i for i in range(bins)] + [high]


def rebinned(histogram: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of a histogram (start, end, count) on other bins (bin, start, end): each old bin is spread evenly over its width; one without width goes to the first new bin that holds it. Both sides have as many rows as a chart has bars."""
    old = histogram.select(F.col("start").alias("s"), F.col("end").alias("e"), "count")
    new = edges.select("bin", "start", "end")
    overlap = F.least("e", "end") - F.greatest("s", "start")
    wide = old.where("e > s").join(F.broadcast(new), (F.least("e", "end") > F.greatest("s", "start"))).select("bin", (F.col("count") * overlap / (F.col("e") - F.col("s"))).alias("n"))
    point = old.where("e = s").join(F.broadcast(new), (F.col("s") >= F.col("start")) & (F.col("s") <= F.col("end"))).groupBy("s", "count").agg(F.min("bin").alias("bin")).select("bin", F.col("count").cast("double").alias("n"))
    counts = wide.unionByName(point).groupBy("bin").agg(F.sum("n").alias("n"))
    return new.join(F.broadcast(counts), "bin", "left").select("bin", "start", "end", F.coalesce("n", F.lit(0.0)).alias("count"))


def probabilities(histogram: DataFrame, value_count: int) -> DataFrame:
    """probability of each bin, and the count that is shown with it."""
    return histogram.withColumn("probability", F.col("count") / float(max(value_count, 1))).withColumn("shown_count", F.round("count").cast("long"))


def merged(series: dict[str, DataFrame]) -> DataFrame:
    """Histograms on the same edges side by side: bin, then a probability for each name; a series without a bin has 0 there."""
    out = None
    for name, one in series.items():
        one = one.select("bin", F.col("probability").alias(name))
        out = one if out is None else out.join(one, "bin", "full")
    return out.select("bin", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in series])


def by_category(catalog: DataFrame) -> DataFrame:
    """family, subfamily and their metrics, all in the order of their names."""
    inner = catalog.groupBy("family", "subfamily").agg(F.array_sort(F.collect_list(F.struct("label", "field"))).alias("metrics"))
    return inner.select("family", "subfamily", F.col("metrics.field").alias("fields")).orderBy("family", "subfamily")


def badges(catalog: DataFrame, summaries: DataFrame) -> DataFrame:
    """The catalogue with each metric's value_count and missing share, null where it has no summary."""
    kept = summaries.select("field", "value_count", fraction(F.col("missing_count"), F.col("missing_count") + F.col("value_count")).alias("missing_share"))
    return catalog.join(F.broadcast(kept), "field", "left")
