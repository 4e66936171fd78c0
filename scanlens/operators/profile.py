"""Profiles of a view: counts, missingness, metric summaries and distributions, top values, keys of JSON columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import finite_or_null, fraction, missing, present
from ..spec import DatasetSpec
from .views import group_key

#: Accuracy of a sketch of a group's values: ranks are off by 1 / SKETCH of its size at most.
SKETCH = 20_000
QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def view_summary(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """row_count, first_created_at and last_created_at in one pass."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(spec.time_col).alias("first_created_at"), F.max(spec.time_col).alias("last_created_at"))


def overview(df: DataFrame, spec: DatasetSpec, snapshots: dict[str, DataFrame] | None = None) -> DataFrame:
    """dataset, view, row_count for the three views. A group has one representative, so groups are counted, not representatives chosen; with snapshots (filtered as df is) their rows are."""
    counts = [("raw", df.agg(F.count(F.lit(1)).alias("row_count")))]
    for kind in ("exact", "series"):
        if snapshots and kind in snapshots:
            counts.append((kind, row_count(snapshots[kind])))
        else:
            counts.append((kind, df.select(group_key(spec, kind).alias("k")).distinct().agg(F.count(F.lit(1)).alias("row_count"))))
    out = None
    for name, one in counts:
        one = one.select(F.lit(spec.name).alias("dataset"), F.lit(name).alias("view"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def long_form(df: DataFrame, fields: list[str], value) -> DataFrame:
    """(position, field, value): a row for each field of each row; value(name) is the Column. Narrow aggregates over this beat one aggregate with hundreds of columns."""
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("field"), value(n).alias("value")) for i, n in enumerate(fields)])
    return df.select(F.explode(cells).alias("c")).select("c.position", "c.field", "c.value")


def with_all_fields(found: DataFrame, df: DataFrame, fields: list[str], zeros: dict[str, Column]) -> DataFrame:
    """A row for every field, even for no input row, in the order of fields."""
    every = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(fields)], "position int, field string")
    return F.broadcast(every).join(found.drop("position"), "field", "left").select("position", "field", *[F.coalesce(F.col(c), z).alias(c) if z is not None else F.col(c) for c, z in zeros.items()])


def missingness(df: DataFrame, fields: list[str]) -> DataFrame:
    """position, field, missing_count and missing_fraction: nulls, and empty texts."""
    kinds = dict(df.dtypes)
    gone = long_form(df, fields, lambda n: missing(F.col(n), kinds[n]).cast("long"))
    found = gone.groupBy("field", "position").agg(F.sum("value").alias("missing_count"), F.count(F.lit(1)).alias("n"))
    found = found.select("position", "field", "missing_count", fraction(F.col("missing_count"), F.col("n")).alias("missing_fraction"))
    return with_all_fields(found, df, fields, {"missing_count": F.lit(0).cast("long"), "missing_fraction": F.lit(0.0)})


def metric_summaries(df: DataFrame, fields: list[str]) -> DataFrame:
    """position, field, value_count, missing_count, missing_fraction, min, max and mean of the finite values; values that aren't finite are missing."""
    cells = long_form(df, fields, lambda n: finite_or_null(F.col(n)))
    found = cells.groupBy("field", "position").agg(F.count("value").alias("value_count"), F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    gone = F.col("n") - F.col("value_count")
    found = found.select("position", "field", "value_count", gone.alias("missing_count"), fraction(gone, F.col("n")).alias("missing_fraction"), "min", "max", "mean")
    zero = F.lit(0).cast("long")
    return with_all_fields(found, df, fields, {"value_count": zero, "missing_count": zero, "missing_fraction": F.lit(0.0), "min": None, "max": None, "mean": None})


def exact_quantiles(rows: DataFrame, by: list[str], v: str) -> DataFrame:
    """The interpolated QUANTILES of v in each group, a column each; nulls aren't values.

    A sketch of each group gives bounds between which the wanted ranks lie, or next to which; what lies below and
    above is counted, and only the distinct values between them are sorted: no task or buffer holds a group's
    values.
    """
    known = rows.where(F.col(v).isNotNull())
    points = list(QUANTILES.values())
    margin = 2 / SKETCH  # twice the sketch's error
    edges = [min(1.0, max(0.0, p + d)) for p in points for d in (-margin, margin)]
    heads = known.groupBy(*by).agg(F.count(v).alias("__n"), F.percentile_approx(v, edges, SKETCH).alias("__e"))
    cut = lambda i, p: F.struct(F.lit(i).alias("i"), F.get("__e", F.lit(2 * i)).alias("low"), F.get("__e", F.lit(2 * i + 1)).alias("high"), (F.lit(p) * (F.col("__n") - 1)).alias("place"))
    heads = heads.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], F.array(*[cut(i, p) for i, p in enumerate(points)]).alias("__cuts"))
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(by)]
    cells = known.join(heads, reduce(lambda a, b: a & b, same)) if by else known.crossJoin(F.broadcast(heads))  # one row
    cells = cells.select(*by, v, F.explode("__cuts").alias("__c"))
    side = F.when(F.col(v) < F.col("__c.low"), F.lit(-1)).when(F.col(v) > F.col("__c.high"), F.lit(1)).otherwise(F.lit(0))
    value = F.when(side == 0, F.col(v))
    cells = cells.groupBy(*by, F.col("__c.i").alias("__i"), F.col("__c.place").alias("__place"), side.alias("__side"), value.alias("__value")).agg(F.count(F.lit(1)).alias("__n"), F.min(v).alias("__least"), F.max(v).alias("__largest"))
    upto = F.sum("__n").over(Window.partitionBy(*by, "__i").orderBy("__side", "__value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.withColumn("__upto", upto)

    def at(rank: Column) -> Column:
        """The value of a rank (from 0): of the cell that it's in, or the edge of what lies below or above."""
        first, last = F.col("__upto") - F.col("__n"), F.col("__upto") - 1
        edge = F.when(rank == last, F.col("__largest")).when(rank == first, F.col("__least")).otherwise(F.raise_error(F.lit("a sketch has missed its bounds")).cast("double"))
        inner = F.when(F.col("__side") == 0, F.col("__value")).when(F.col("__side") < 0, F.when(rank == last, F.col("__largest")).otherwise(edge)).otherwise(F.when(rank == first, F.col("__least")).otherwise(edge))
        return F.max(F.when((rank >= first) & (rank <= last), inner))

    found = cells.groupBy(*by, "__i", "__place").agg(at(F.floor("__place")).alias("__a"), at(F.ceil("__place")).alias("__b"))
    share = F.col("__place") - F.floor("__place")
    between = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise((1 - share) * F.col("__a") + share * F.col("__b"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("__i") == i, between)).alias(n) for i, n in enumerate(QUANTILES)])


def metric_stats(df: DataFrame, metric: str, by: list[str] | None = None, *, exact: bool = True) -> DataFrame:
    """row_count, value_count, missing_count, missing_fraction, min, max, mean, stddev (of the population) and interpolated percentiles of the finite values. exact=False takes percentiles from sketches alone, in one pass."""
    v, by = "__v", by or []
    rows = df.select(*by, finite_or_null(F.col(metric)).alias(v))
    points, gone = list(QUANTILES.values()), F.col("row_count") - F.col("value_count")
    sketch = [] if exact else [F.percentile_approx(v, points, SKETCH).alias("__q")]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.count(v).alias("value_count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), *sketch)
    if exact:
        found = exact_quantiles(rows, by, v)
        found = found.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], *QUANTILES)
        same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(by)]
        out = out.join(found, reduce(lambda a, b: a & b, same), "left") if by else out.crossJoin(F.broadcast(found))  # one row each
    quantiles = [F.col(n) if exact else F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(QUANTILES)]
    return out.select(*by, "row_count", "value_count", gone.alias("missing_count"), fraction(gone, F.col("row_count")).alias("missing_fraction"), "min", "max", "mean", "stddev", *quantiles)


def histogram(df: DataFrame, metric: str, bins: int | Callable[[Column], Column] = 20) -> DataFrame:
    """bin, start, end and count of equal-width bins over the finite values, empty bins too. The largest value is in the last bin, whose end it is. One distinct value gives the one bin [value, value]; no value, no bin. bins may be a function of the number of values.

    Two scans: one for the number of values and their range, one for the bins. Neither filters, as a filter would be pushed below
    the metric's expression and make it again for each of its conditions; aggregates leave nulls out.
    """
    if not callable(bins) and bins < 1:
        raise ValueError("a histogram needs a bin")
    rows = df.select(finite_or_null(F.col(metric)).alias("v"))
    edges = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("values")).where("values > 0")
    wanted = bins(F.col("values")) if callable(bins) else F.lit(bins)
    edges = edges.withColumn("n", F.when(F.col("high") > F.col("low"), wanted).otherwise(F.lit(1)).cast("int"))
    edges = edges.withColumn("width", (F.col("high") - F.col("low")) / F.col("n"))
    place = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")), F.col("n") - 1))
    place = F.coalesce(F.when(F.col("v").isNotNull(), place).cast("int"), F.lit(-1))  # never null, or the join below would bring a filter
    counted = rows.crossJoin(F.broadcast(edges)).groupBy(place.alias("bin")).agg(F.count("v").alias("count"))  # edges is one row
    every = edges.select("low", "high", "width", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))
    start = F.col("low") + F.col("bin") * F.col("width")
    end = F.when(F.col("bin") == F.col("n") - 1, F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * F.col("width"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", start.alias("start"), end.alias("end"), F.coalesce("count", F.lit(0)).alias("count"))


def whole(df: DataFrame, spec: DatasetSpec, *, top_n: int = 10, key_limit: int = 25) -> DataFrame:
    """Everything that a profile says about a view, by one scan and one aggregate.

    Each row becomes narrow cells (part, field, value, number), whose groups are combined before the shuffle. The
    parts: `view` (its rows, first and last time), `missing` (important fields), `metric`, `category` and `extra`.
    Heads have no rank: row_count, known_count (rows with a value; of extras: rows whose object has a key),
    distinct_count (values or keys), and min, max and mean of metrics. Ranked rows are the top_n values of each
    category and the key_limit keys of each extra: rank, value, row_count (known_count: the same, 0 for keys);
    equal counts in the values' order. No rows give no rows; a field without values has a head only.
    """
    kinds, at = dict(df.dtypes), df.schema[spec.time_col].dataType
    null = F.lit(None)

    def cell(part: str, i: int, name: str, known: Column, value: Column = null, number: Column = null, time: Column = null) -> Column:
        named = {"part": F.lit(part), "position": F.lit(i), "field": F.lit(name), "value": value.cast("string"), "number": number.cast("double"), "known": known.cast("long"), "at": time.cast(at)}
        return F.struct(*[c.alias(n) for n, c in named.items()])

    def key_cell(i: int, name: str):
        return lambda key: cell("extra", i, name, F.lit(False), key)

    cells = [cell("view", 0, spec.name, F.lit(True), time=F.col(spec.time_col))]
    cells += [cell("missing", i, n, ~missing(F.col(n), kinds[n])) for i, n in enumerate(spec.important_fields)]
    for i, n in enumerate(spec.metric_fields):
        number = finite_or_null(F.col(n))
        cells.append(cell("metric", i, n, number.isNotNull(), number=number))
    for i, n in enumerate(spec.category_fields):
        value = F.col(n).cast("string")
        cells.append(cell("category", i, n, F.coalesce(present(value), F.lit(False)), F.when(present(value), value)))
    lists = []
    for i, n in enumerate(spec.extra_fields):
        keys = F.coalesce(keys_of(df, n), F.array().cast("array<string>"))
        cells.append(cell("extra", i, n, F.size(keys) > 0))
        lists.append(F.transform(F.array_distinct(keys), key_cell(i, n)))
    rows = df.select(F.explode(F.concat(F.array(*cells), *lists)).alias("c")).select("c.*")
    counted = rows.groupBy("part", "position", "field", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("known").alias("known"), F.count("value").alias("texts"), F.min("number").alias("min"), F.max("number").alias("max"), F.avg("number").alias("mean"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    own = (F.col("part") == "category") | (F.col("texts") == 0)  # the keys of an extra are no rows
    heads = counted.groupBy("part", "position", "field").agg(
        F.sum(F.when(own, F.col("n"))).alias("row_count"), F.sum("known").alias("known_count"), F.count_if(F.col("texts") > 0).alias("distinct_count"),
        *[F.max(c).alias(c) for c in ("min", "max", "mean", "first_at", "last_at")],
    )
    place = F.row_number().over(Window.partitionBy("part", "position", "field").orderBy(F.col("n").desc(), "value"))
    # the whole aggregate is named in both branches, so that they share its exchange
    ranked = counted.where(F.col("texts") > 0).withColumn("rank", place).where(F.col("rank") <= max(top_n, key_limit))
    ranked = ranked.where(F.col("rank") <= F.when(F.col("part") == "category", top_n).otherwise(key_limit))
    ranked = ranked.select("part", "position", "field", "rank", "value", F.col("n").alias("row_count"), F.col("known").alias("known_count"), null.cast("long").alias("distinct_count"), "min", "max", "mean", "first_at", "last_at")
    heads = heads.select("part", "position", "field", null.cast("int").alias("rank"), null.cast("string").alias("value"), "row_count", "known_count", "distinct_count", "min", "max", "mean", "first_at", "last_at")
    return heads.unionByName(ranked)


def top_values(df: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """The most frequent values that are neither null nor empty; equal counts in the values' order."""
    value = F.col(name).cast("string")
    return df.where(present(value)).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "value").limit(limit)


def keys_of(df: DataFrame, name: str) -> Column:
    """The keys of a map column or of the object that a JSON text holds; null for anything else."""
    return F.map_keys(F.col(name)) if dict(df.dtypes)[name].startswith("map") else F.json_object_keys(F.col(name))


def extra_key_counts(df: DataFrame, name: str, limit: int = 25) -> DataFrame:
    """The most frequent keys of a JSON column: key, row_count; equal counts in the keys' order."""
    keys = df.select(F.explode(F.array_distinct(keys_of(df, name))).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.col("row_count").desc(), "key").limit(limit)


def extra_key_totals(df: DataFrame, name: str) -> DataFrame:
    """nonempty_row_count (rows whose object has a key) and distinct_key_count."""
    keys = df.select(keys_of(df, name).alias("k")).where(F.size("k") > 0)
    distinct = keys.select(F.explode("k").alias("key")).agg(F.countDistinct("key").alias("distinct_key_count"))
    return keys.agg(F.count(F.lit(1)).alias("nonempty_row_count")).crossJoin(distinct)  # one row each
